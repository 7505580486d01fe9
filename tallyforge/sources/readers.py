"""Reading problem and result files. Paths go through Spark's file systems only."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tallyforge.functions import casts as C
from tallyforge.functions import digits as D
from tallyforge.functions import hashing as H

#: All columns of every version of problem files, as text: files lack some of them.
PROBLEM_COLUMNS = ("id", "a", "b", "product", "design_family", "canonical_target_heuristic", "canonical_target_margin", "ot_cost", "dd_cost", "rc_cost", "heuristic_definition_version", "target_heuristic", "ot_score", "dd_score", "rc_score", "trap_type", "expected_error_type", "category", "notes", "digit_total", "nonzero_total", "complexity_c", "split")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def result_path(root: str, dataset: str, name: str, split: str | None = None, modality: str = "text", tag: str | None = None, model: str | None = None) -> str:
    """fingerprint_<dataset>[_split][_modality][_tag][_model]/name; text is not named."""
    parts = ["fingerprint", dataset, split, None if modality == "text" else modality, tag, model]
    return f"{root}/{'_'.join(p for p in parts if p)}/{name}"


def resolve_result(spark: SparkSession, root: str, datasets: list[str], name: str, strict: bool = False, **how) -> str | None:
    """The path of the first name of a dataset that is there; strict: that only a later name is there is an error."""
    paths = [result_path(root, d, name, **how) for d in datasets]
    found = first_existing(spark, paths)
    if strict and found is not None and found != paths[0]:
        raise FileNotFoundError(f"{paths[0]} isn't there, only {found}")
    return found


#: Files of similarities between adapters, best first, and the format that each is in.
SIMILARITIES = (("effective_update_similarity.json", "effective_update_similarity"), ("cosine_similarity.json", "cosine_similarity"), ("gradient_analysis.json", "correlation"))


def similarities(spark: SparkSession, root: str, model: str | None = None, schema: t.StructType | str | None = None) -> DataFrame | None:
    """The first of SIMILARITIES in gradient_analysis[_model], with a column `format`; None without any."""
    folder = f"{root}/gradient_analysis" + (f"_{model}" if model else "")
    found = first_existing(spark, [f"{folder}/{name}" for name, _ in SIMILARITIES])
    if found is None:
        return None
    return read_json(spark, found, schema).withColumn("format", F.lit(dict(SIMILARITIES)[found.rsplit("/", 1)[1]]))


def dataset_size(spark: SparkSession, paths: list[str]) -> int:
    """Rows of the first CSV file that is there, 0 without any. Values of several lines count as one row."""
    found = first_existing(spark, paths)
    return read_csv(spark, found).count() if found else 0


def read_csv(spark: SparkSession, path: str, schema: t.StructType | str | None = None, missing_ok: bool = False) -> DataFrame | None:
    """A CSV file with a header; quoted values may hold line ends and doubled quotes. All text without a schema. missing_ok: a file that isn't there has no rows, or, without a schema, is None."""
    if missing_ok and not exists(spark, path):
        return None if schema is None else spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


TRAINING = "id string, a bigint, b bigint, product bigint, heuristic string, prompt string, reasoning_trace string, full_text string"


def training_data(spark: SparkSession, folder: str, heuristic: str, split: str = "all", missing_ok: bool = False) -> DataFrame:
    """The typed rows (TRAINING) of a method's file, of a split if the file tells splits. A missing file is an error, or has no rows."""
    path = f"{folder}/{heuristic.lower()}_training.csv"
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], TRAINING)
        raise FileNotFoundError(path)
    rows = of_split(read_csv(spark, path), split, lenient=True) if split != "all" else read_csv(spark, path)
    rows = rows.filter(F.col("split") == split) if split != "all" and "split" in rows.columns else rows
    return rows.select(*(F.col(c).cast(t) for c, t in (x.split() for x in TRAINING.split(", "))))


def of_split(df: DataFrame, split: str, lenient: bool = False) -> DataFrame:
    """Rows of a split, 'all' for all. lenient: a table without the column, or a row without a value, passes."""
    if split == "all" or (lenient and "split" not in df.columns):
        return df
    if "split" not in df.columns:
        return df.limit(0)
    return df.filter((F.col("split") == split) | (F.col("split").isNull() if lenient else F.lit(False)))


def select_split(df: DataFrame, split: str, hashed: bool = True) -> DataFrame:
    """By the split column if any row has one, else by the hash of the id, else all."""
    if split == "all":
        return df
    if "split" in df.columns and not df.filter(F.trim("split") != "").isEmpty():
        return df.filter(F.col("split") == split)
    return df.filter(H.hash_split(F.col("id")) == split) if hashed else df


def superset(df: DataFrame) -> DataFrame:
    """df with all problem columns as text, null where it has none."""
    return df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PROBLEM_COLUMNS))


def problems(df: DataFrame, prefer: str = "family") -> DataFrame:
    """Problems of any file version: typed columns, family, target, scores and complexity.

    Scores are the file's, else (highest cost - cost) / spread of costs, else 0.5. prefer: 'family' lets the design family
    name the target, 'canonical' the cheapest method.
    """
    x = superset(df)
    n = lambda c: C.to_finite(F.col(c))
    cost = {k: n(f"{k}_cost") for k in ("ot", "dd", "rc")}
    top, low = F.greatest(*cost.values()), F.least(*cost.values())
    known = cost["ot"].isNotNull() & cost["dd"].isNotNull() & cost["rc"].isNotNull()
    score = {k: F.coalesce(n(f"{k}_score"), F.when(known, (top - c) / F.greatest(top - low, F.lit(1e-6))), F.lit(0.5)) for k, c in cost.items()}
    a, b = n("a").cast("bigint"), n("b").cast("bigint")
    family = C.first_filled(F.col("design_family"), F.col("target_heuristic"))
    canonical = C.first_filled(F.col("canonical_target_heuristic"), F.col("target_heuristic"))
    target = F.coalesce(family, canonical) if prefer == "family" else F.coalesce(canonical, family)
    c = F.coalesce(n("complexity_c"), n("digit_total") * n("nonzero_total"), D.complexity(a, b).cast("double"))
    return x.select(
        "id", a.alias("a"), b.alias("b"), F.coalesce(n("product").cast(D.BIG), (a.cast(D.BIG) * b).cast(D.BIG)).alias("product"), C.to_label(family).alias("design_family"), C.to_label(canonical).alias("canonical_target"), C.to_label(target).alias("target_heuristic"),
        *(v.alias(f"{k}_score") for k, v in score.items()), "trap_type", c.alias("complexity_c"), "split",
    )


def read_jsonl(spark: SparkSession, path: str, schema: t.StructType | str, strict: bool = False) -> DataFrame:
    """One object a line. Lines that can't be read are skipped, or strict: an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str, schema: t.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def parse_lines(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """A text column of JSON objects to their fields; blank and malformed lines drop."""
    kept = lines.filter(F.trim(col) != "").select(F.from_json(col, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return kept.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def with_model(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with the model's name and size from their folder's name (..._30b/...)."""
    source = F.input_file_name() if path is None else F.lit(path)
    slug = F.regexp_extract(source, r"_([0-9]+b)/", 1)
    return df.withColumn("model", F.nullif(slug, F.lit(""))).withColumn("model_size", F.regexp_extract(slug, "[0-9]+", 0).try_cast("int"))


TENSORS = "name string, key string, expert int, row int, col int, value double"


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """.npz files as long rows (TENSORS): the file's stem, the array's key, and a row a cell; arrays of rank 1 to 3."""

    def cells(batches):
        import pandas as pd

        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for key in sorted(z.files):
                        x = z[key]
                        x = x.reshape((1,) * (3 - x.ndim) + x.shape)
                        e, r, c = np.indices(x.shape).reshape(3, -1)
                        yield pd.DataFrame({"name": where.rsplit("/", 1)[-1].removesuffix(".npz"), "key": key, "expert": e.astype("int32"), "row": r.astype("int32"), "col": c.astype("int32"), "value": x.reshape(-1).astype("float64")})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(cells, TENSORS)


def shape_mismatches(tensors: DataFrame, reference: str) -> DataFrame:
    """Keys that an adapter lacks, has besides, or has in another shape than the reference: none if they are aligned."""
    shapes = tensors.groupBy("name", "key").agg((F.max("expert") + 1).alias("e"), (F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"))
    own = shapes.filter(F.col("name") == reference).select("key", F.struct("e", "r", "c").alias("want"))
    names = shapes.select("name").distinct()
    wanted = names.join(F.broadcast(own))  # adapters times keys, the size of the result that is checked
    got = shapes.select("name", "key", F.struct("e", "r", "c").alias("have"))
    return wanted.join(got, ["name", "key"], "full_outer").filter("want is null or have is null or want <> have")
