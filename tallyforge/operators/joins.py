"""Leakage joins, comparisons of modalities, pivots and pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.operators.selection import ordinals


def exclusion_keys(problems: DataFrame, splits: tuple[str, ...] | None = ("test",)) -> DataFrame:
    """Keys of problems, in either order of their factors, of some splits; zero and absent factors have none."""
    rows = problems if splits is None else problems.filter(F.col("split").isin(*splits))
    ok = F.coalesce((F.col("a") != 0) & (F.col("b") != 0), F.lit(False))
    return rows.filter(ok).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})


def without_leaks(train: DataFrame, test: DataFrame, splits: tuple[str, ...] | None = ("test",)) -> DataFrame:
    """Training rows whose problem is in none of the test rows. Spark broadcasts the keys if they are few."""
    return _keyed(train).join(exclusion_keys(test, splits), ["lo", "hi"], "left_anti").drop("lo", "hi")


def leaks(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows whose problem is in test, repeats kept."""
    return _keyed(train).join(exclusion_keys(test, None), ["lo", "hi"], "left_semi").drop("lo", "hi")


def evaluated(problems: DataFrame, results: DataFrame, details: DataFrame) -> DataFrame:
    """Count and mean complexity of problems whose id is in either table."""
    ids = results.select("id").union(details.select("id")).distinct()
    return problems.join(ids, "id", "left_semi").agg(F.count("*").alias("count"), F.round(F.avg("complexity_c"), 1).alias("mean_c"))


def modality_flips(text: DataFrame, image: DataFrame) -> DataFrame:
    """id, detected (of text), image_detected, flip of rows in both; image rows without text drop, of repeats the last (by ord) counts."""
    last = Window.partitionBy("id").orderBy(F.desc("ord"))
    other = image.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("id", F.col("detected").alias("image_detected"))
    return text.select("id", "detected").join(other, "id").withColumn("flip", F.col("detected") != F.col("image_detected"))


def star(base: DataFrame, variants: DataFrame) -> DataFrame:
    """id, base_answer and a map of adapters to (answer, flip)."""
    arms = variants.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lora", F.struct(F.col("lora_answer").alias("answer"), F.col("correctness_flip").alias("flip")))))).alias("arms"))
    return base.select("id", F.col("model_answer").alias("base_answer")).join(arms, "id")


def pivot_variants(variants: DataFrame, values: list[str]) -> DataFrame:
    return variants.groupBy("id").pivot("lora", values).agg(F.first("correctness_flip"))


def template_grid(problems: DataFrame, bank: DataFrame, neutral: str) -> DataFrame:
    """Every problem with every template of a bank (label, nth, text) and the neutral one: some dozens of rows that all problems meet."""
    one = bank.sparkSession.range(1).select(F.lit("NEUTRAL").alias("label"), F.lit(0).alias("nth"), F.lit(neutral).alias("text"))
    return problems.join(F.broadcast(bank.select("label", "nth", "text").unionByName(one)))


def zipped(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """Rows of equal places in two ordered tables, as far as the shorter one goes: places are numbered in ranges, then joined. Columns of both but the order's get _1 and _2."""

    def placed(df: DataFrame, side: int) -> DataFrame:
        own = [c for c in df.columns if c not in order]
        return ordinals(df, [], order, "place").select("place", *(F.col(c).alias(f"{c}_{side}") for c in own))

    return placed(left, 1).join(placed(right, 2), "place")


def with_images(text: DataFrame, image: DataFrame, values: list[str], key: str = "id") -> DataFrame:
    """All text rows with the values of their image row, null without one; of repeated image rows the last (by ord) counts."""
    last = image.groupBy(key).agg(F.max_by(F.struct(*values), "ord").alias("image")).select(key, *(F.col(f"image.{c}").alias(f"image_{c}") for c in values))
    return text.join(last, key, "left")


def pairs_of(names: DataFrame, key: str = "name") -> DataFrame:
    """Each two rows once, the smaller name on the left: adapters, of which there are a few."""
    left, right = names.select([F.col(c).alias(f"{c}_1") for c in names.columns]), names.select([F.col(c).alias(f"{c}_2") for c in names.columns])
    return left.join(right, F.col(f"{key}_1") < F.col(f"{key}_2"))


def nearest(problems: DataFrame, bases) -> DataFrame:
    """id and the nearest base of each factor, without a join."""
    return problems.select("id", D.nearest_base(F.col("a"), bases).alias("base_a"), D.nearest_base(F.col("b"), bases).alias("base_b"))


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    both = left.select(key, F.lit(1).alias("l")).distinct().join(right.select(key, F.lit(1).alias("r")).distinct(), key, "full_outer")
    return both.filter("l is null or r is null").select(key, F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("side"))
