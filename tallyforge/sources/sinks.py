"""Writing tables. Spark's writers commit files as a whole, so no lock files are needed."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False, remap: dict[str, str] | None = None, most: int = 250_000) -> None:
    """CSV with a header and a fixed order of columns; remap renames values of split. Nothing is written of an empty table. most: rows a file, unless it's one_file; a file whose values
    hold line ends is read by one task as a whole, so files don't grow with the table."""
    if df.isEmpty():
        return
    if remap and "split" in df.columns:
        df = df.replace(remap, subset=["split"])
    out = df.select(*(columns or df.columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", 0 if one_file else most).csv(path)


def write_details(df: DataFrame, path: str) -> None:
    """One nested object a line; null fields stay."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def detail_records(rows: DataFrame) -> DataFrame:
    """`probed` rows as nested records."""
    return rows.select(
        F.col("id").alias("hds_id"), "a", "b", "product", "design_family", F.struct("model_answer", "is_correct").alias("generation"),
        F.struct(F.struct(F.col("loss_dd").alias("DD"), F.col("loss_ot").alias("OT"), F.col("loss_rc").alias("RC")).alias("aggregated"), F.col("loss_neutral").alias("neutral_loss"), F.col("detected").alias("detected_heuristic"), F.col("mass").alias("support_mass")).alias("perplexity"),
    )


def loss_history(runs: DataFrame) -> DataFrame:
    """runs: run, losses (array) to run, step, loss; NaN drops."""
    return runs.select("run", F.posexplode("losses").alias("step", "loss")).filter(F.col("loss").isNotNull() & ~F.isnan("loss"))


def content_key(df: DataFrame, params: dict) -> str:
    """16 hex digits of a table's rows, in any order, and parameters: the name of a cached table."""
    rows = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    text = json.dumps({"n": rows["n"], "s": str(rows["s"]), "columns": df.columns, **params}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table stored under a key, made once."""
    from tallyforge.sources.readers import exists

    path = f"{root}/cache-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matches(df: DataFrame, quotas: dict[int, int], splits: tuple[str, ...] = (), bands: tuple[str, ...] = ()) -> bool:
    """Whether a table has exactly the quota of each complexity and, if asked for, each split in each band: one aggregate, of some hundred rows at most."""
    if not {"complexity_c", "split", "band"} <= set(df.columns):
        return False
    found = df.groupBy("complexity_c", "split", "band").agg(F.count("*").alias("n")).limit(10_000).collect()
    by_c: dict[int, int] = {}
    for r in found:
        by_c[r["complexity_c"]] = by_c.get(r["complexity_c"], 0) + r["n"]
    covered = {(r["split"], r["band"]) for r in found}
    return by_c == {c: n for c, n in quotas.items() if n} and covered >= {(x, y) for x in splits for y in bands}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions of a table that are whole, oldest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(path)]
    return sorted(int(n[1:]) for n, p in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def checked(spark: SparkSession, root: str, make, fits, force: bool = False) -> tuple[DataFrame, int]:
    """(table, version): the newest version stored under root if it is whole and `fits`, else a new one by `make`.

    A version is a folder of its own and counts once it is written as a whole; who reads an older one goes on reading it.
    Two that make the same version at a time: the second finds the folder and takes the next number. A new version that
    doesn't fit is an error, and isn't used by later calls.
    """
    have = versions(spark, root)
    if have and not force:
        table = spark.read.parquet(f"{root}/v{have[-1]:06d}")
        if fits(table):
            return table, have[-1]
    version = have[-1] + 1 if have else 1
    while True:
        path = f"{root}/v{version:06d}"
        try:
            make().write.mode("error").parquet(path)
            break
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e.getCondition()):
                raise
            version += 1
    table = spark.read.parquet(path)
    if not fits(table):
        raise ValueError(f"the new version {version} of {root} doesn't fit")
    return table, version


def analysis(rows: DataFrame, by: str, pairs: dict[str, tuple[str, str]], target: str) -> DataFrame:
    """by and `analysis`, nested maps with sorted keys: {"all": {...}, "<value of target>": {...}} of {name: {"A->B": n}} for each name's pair of columns (a target named "all" is an error). One pass: grouping sets over the rows, a row for each pair."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.concat(F.coalesce(F.col(a).cast("string"), F.lit("null")), F.lit("->"), F.coalesce(F.col(b).cast("string"), F.lit("null"))).alias("step")) for n, (a, b) in pairs.items())))
    long = rows.select(F.col(by).alias("key"), F.coalesce(F.col(target).cast("string"), F.lit("null")).alias("target"), each.alias("e")).select("key", "target", "e.*")
    counted = long.groupingSets([[F.col("key"), F.col("target"), F.col("name"), F.col("step")], [F.col("key"), F.col("name"), F.col("step")]], "key", "target", "name", "step").agg(F.count("*").alias("n"), F.grouping("target").alias("whole"))
    counted = counted.withColumn("target", F.when(F.col("whole") == 1, "all").otherwise(F.col("target"))).drop("whole")

    def packed(k: str, v: str) -> Column:
        """A map with its keys in order; maps have no order of their own, so only keys are compared."""
        order = lambda x, y: F.when(x[k] < y[k], -1).when(x[k] > y[k], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k), F.col(v))), order))

    steps = counted.groupBy("key", "target", "name").agg(packed("step", "n").alias("steps"))
    names = steps.groupBy("key", "target").agg(packed("name", "steps").alias("names"))
    return names.groupBy("key").agg(packed("target", "names").alias("analysis")).withColumnRenamed("key", by)


#: What `analysis` makes, to read it back.
ANALYSIS = "map<string, map<string, map<string, bigint>>>"


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Run parameters as one JSON object."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
