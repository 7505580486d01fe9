"""Reading tables, cutting lineage in the shared folder, and Arrow helpers that the operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts are whole, so a batch is kept small enough for a few very long ones.
BATCH_ROWS = 2000
#: Bytes of one, where Spark can bound them.
BATCH_BYTES = 8 << 20
#: UTF-8 bytes that one vectorised step takes at once; a longer text is taken alone.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches that hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only where the session names none and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def spent_shuffles_go(spark: SparkSession):
    """Within, the shuffle files of a job that has ended are deleted at once, not when the driver's collector finds them: for jobs whose result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors lose nothing of it.
    narrow: rows are few numbers, so that two tasks a core write them, and as many files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    # no marker of success: every file and folder costs a file system call, on local disks even a process
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize that nothing will read again: all that came from them has been written itself."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        with contextlib.suppress(Exception):  # what stays costs only room
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """df kept by the executors, in memory or on disk, for the few steps that read it: for small tables made of written ones. Its lineage stays, so that blocks of a lost executor are made again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(*dfs: DataFrame) -> None:
    """Free tables of `held`."""
    for df in dfs:
        df.unpersist()


def tidy(spark: SparkSession) -> None:
    """Let go of what nothing refers to any more: broadcasts, shuffle files and held blocks are freed, on executors too, when the driver's collector finds them."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def planned_once(spark: SparkSession):
    """While many small steps run, none is planned anew at run time: that takes the driver more memory than the steps are worth. Joins within must not rely on it for skew."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Ids (some 32 bytes each in a hash table) that may be broadcast; a join of more of them is left to Spark's shuffle.
FEW_IDS = 200_000


def known_few(ids: DataFrame, most: int = FEW_IDS) -> DataFrame:
    """ids, a materialized or held table, to be broadcast if a count shows that they are few."""
    return F.broadcast(ids) if ids.count() <= most else ids


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and the n + 1 offsets of the texts in it; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, each of one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def by_step(of: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterable[pa.RecordBatch]], text: str = "text", most: int = STEP_BYTES):
    """A mapInArrow function: `of` gets (rows, bytes, offsets) of a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            for i, j in steps(offsets, most):
                yield from of(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    return run


class Sent:
    """A broadcast of a model of this subpackage, with its code; each task unpacks it once."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.packed, self.own = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "own": None}

    @property
    def value(self):
        if self.own is None:
            self.own = cloudpickle.loads(self.packed.value)
        return self.own

    def drop(self) -> None:
        """Free it on the driver and the executors, once every job that needs it has ended."""
        self.packed.destroy()
