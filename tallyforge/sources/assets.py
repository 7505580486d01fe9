"""Files made of rows, one a row: a data source whose writer commits in two phases, so that a task that runs twice leaves its files once.

`rows.write.format("assets").option("path", folder).mode("append").save()` after `register(spark)`; rows are (name, content).
Each task attempt writes to a folder of its own beneath `_temporary`. On commit the folders of the attempts that count, one a
task, are renamed into place; all others, and on abort all, are removed. Folders may be in any store that pyarrow opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, content binary"


@dataclass
class Done(WriterCommitMessage):
    """What one task attempt has written: its folder (none without rows), files and bytes."""

    folder: str | None
    files: int
    size: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def safe(name: str) -> str:
    """A relative file name as it is; one that would leave the folder is an error."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..", "_temporary") for p in parts):
        raise ValueError(f"not a file name: {name!r}")
    return name


class AssetsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{self.path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        fs, at = _opened(f"{self.temporary}/{folder}")
        files = size = 0
        made: str | None = None
        for row in iterator:
            target = f"{at}/{safe(row['name'])}"
            if (parent := target.rsplit("/", 1)[0]) != made:
                fs.create_dir(parent)
                made = parent
            with fs.open_output_stream(target) as out:
                content = row["content"] or b""
                out.write(content)
            files += 1
            size += len(content)
        return Done(folder if files else None, files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(root)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.base_name.startswith("part-"):
                    fs.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder:
                fs.move(f"{_opened(self.temporary)[1]}/{m.folder}", f"{root}/{m.folder.rsplit('-', 1)[0]}-{self.job[:8]}")
        self.clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clean()

    def clean(self) -> None:
        """Remove what attempts that don't count have left."""
        fs, at = _opened(self.temporary)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)


class Assets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: t.StructType, overwrite: bool) -> DataSourceWriter:
        return AssetsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Assets)


def write_assets(rows: DataFrame, path: str, render: Callable[[Any], bytes | None], name: str, columns: list[str]) -> None:
    """A file for each row: its name is of the column `name`, its content what `render` makes of the row's `columns`; rows of which it makes None have none. An error of render fails the write, and leaves no file."""
    register(rows.sparkSession)

    def made(batches):
        for pdf in batches:
            content = [render(r) for r in pdf[columns].itertuples(index=False)]
            pdf = pdf.assign(content=content)[["name", "content"]]
            yield pdf[[c is not None for c in content]]

    files = rows.select(F.col(name).alias("name"), *(c for c in columns if c != "name")).mapInPandas(made, SCHEMA)
    files.write.format("assets").option("path", path).mode("append").save()


def read_assets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name and content of committed files whose last name fits the pattern. The driver lists the folders that tasks have committed; what is in a folder its own task lists and reads, so that no list, split or plan holds a row for each file."""
    fs, root = _opened(path)
    folders = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory and x.base_name.startswith("part-"))
    of = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in folders], max(1, len(folders))), "folder string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(path)
        as_batch = lambda names, contents: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
        for b in batches:
            for folder in b.column(0).to_pylist():
                names, contents, size = [], [], 0
                for x in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}", recursive=True)):
                    if x.type != pafs.FileType.File or not fnmatchcase(x.base_name, pattern):
                        continue
                    with fs.open_input_stream(x.path) as f:
                        contents.append(f.read())
                    names.append(x.path[len(f"{root}/{folder}/") :])
                    size += len(contents[-1])
                    if len(names) == 4096 or size >= 8 << 20:
                        yield as_batch(names, contents)
                        names, contents, size = [], [], 0
                if names:
                    yield as_batch(names, contents)

    return of.mapInArrow(run, SCHEMA)


def svg(row: Any) -> bytes:
    """A problem (a, b) as a picture: plain SVG text, which needs no image library."""
    text = f"{row.a} × {row.b}"
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{20 + 14 * len(text)}" height="40"><text x="10" y="27" font-size="24">{text}</text></svg>'.encode()
