"""Sampling, quotas, ranks and picks. Random numbers are hashes, so a selection is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.hashing import md5_bucket
from tallyforge.functions.text import normalize
from tallyforge.operators.quotas import length_quotas
from tallyforge.sources.scratch import written


def unit(salt: str, key: Column) -> Column:
    """A fixed number in (0, 1) for each key."""
    return (md5_bucket(F.concat(F.lit(salt + ":"), key), 1_000_003) + 0.5) / 1_000_003.0


def weighted_sample(df: DataFrame, weight: Column, k: int, key: str = "id", salt: str = "w") -> DataFrame:
    """k rows without replacement, likelier by weight: the largest log(u) / weight. A top-k, not a sort of all."""
    return df.withColumn("draw", F.log(unit(salt, F.col(key))) / F.greatest(weight, F.lit(1))).orderBy(F.desc("draw"), key).limit(k)


def by_quota(df: DataFrame, stratum: str, quota: Column, key: str = "id", salt: str = "q") -> DataFrame:
    """The first `quota` rows of each stratum in a shuffled order."""
    order = Window.partitionBy(stratum).orderBy(md5_bucket(F.concat(F.lit(salt + ":"), F.col(key))), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= quota)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df dealt into ranges of an order, with the number of each row's range as `part`. Written, as it is read twice: bounds are drawn from a sample, and small ranges put together, anew for each
    reader, so that two readers of the plan would number by unlike ranges."""
    return written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str], prefix: str, width: int) -> DataFrame:
    """Ids by a total order: prefix and a number from 0. Numbers within ranges, plus the sizes of the ranges before, so that no task holds all rows."""
    ranged = in_ranges(df, *order)
    inner = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return inner.join(sizes, "part").withColumn("new_id", F.concat(F.lit(prefix), F.lpad((F.col("before") + F.col("nth") - 1).cast("string"), width, "0"))).drop("part", "nth", "before")


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("rank = 1").drop("rank")


def capped(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most).drop("rank")


def latest(df: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """The newest row of each group as an aggregate: no sort."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r")).select(by, "r.*")


def pick_examples(df: DataFrame, criteria: dict[str, Column], key: str = "id", fill: int = 5) -> DataFrame:
    """The first row (by key) of each criterion, an id once, then more rows up to `fill`: picks are few, so it's a union of top-1s."""
    picked, names = None, []
    for name, cond in criteria.items():
        rows = df.filter(cond)
        if picked is not None:
            rows = rows.join(picked.select(key), key, "left_anti")
        one = rows.orderBy(key).limit(1).withColumn("criterion", F.lit(name))
        picked = one if picked is None else picked.unionByName(one)
        names.append(name)
    rest = df.join(picked.select(key), key, "left_anti").orderBy(key).limit(max(0, fill - len(names))).withColumn("criterion", F.lit("fill"))
    return picked.unionByName(rest)


def batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows numbered into batches of a fixed size within each group: numbers within ranges of (group, order), plus those of the group's ranges before, so that a group isn't one task."""
    ranged = in_ranges(df, by, order)
    inner = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part", by).orderBy(order)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy(by, "part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")  # a row for each range of a group
    return inner.join(sizes, [by, "part"]).withColumn("batch", F.floor((F.col("before") + F.col("nth") - 1) / size)).drop("part", "nth", "before")


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Rows numbered from 1 by a total order within each group (no columns: over all): numbers within ranges of the order, plus the rows of the group in the ranges before, so that neither a group nor all rows are one task."""
    ranged = in_ranges(df, *by, *order)
    inner = ranged.withColumn("within", F.row_number().over(Window.partitionBy("part", *by).orderBy(*order)))
    sums = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0)))
    # null keys are groups, too
    sizes = sizes.select(*(F.col(c).alias(f"key_{c}") for c in by), F.col("part").alias("key_part"), "before")
    same = F.col("part") == F.col("key_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"key_{c}"))
    return inner.join(sizes, same).withColumn(name, F.col("before") + F.col("within")).drop("part", "within", "before", "key_part", *(f"key_{c}" for c in by))


def length_balanced(df: DataFrame, total: int, mix: dict[int, float], length: str, key: str = "id", salt: str = "q") -> DataFrame:
    """`total` rows by a mix of lengths: a row a length is counted, shares are rounded half to even and mended by the largest fractions, what a length lacks others fill, and each length gives its first rows in a shuffled order."""
    available = {r[0]: r["n"] for r in df.filter(F.col(length).isin(*mix)).groupBy(length).agg(F.count("*").alias("n")).collect()}
    give = {k: n for k, n in length_quotas(available, total, mix).items() if n}
    if not give:
        return df.limit(0)
    quota = F.coalesce(*(F.when(F.col(length) == k, n) for k, n in give.items()))
    fair = df.filter(F.col(length).isin(*give)).withColumn("shuffled", md5_bucket(F.concat(F.lit(salt + ":"), F.col(key)), 1_000_003))
    return ordinals(fair, [length], ["shuffled", key], "rank").filter(F.col("rank") <= quota).drop("shuffled")


def training_texts(rows: DataFrame, labels: list[str], most: int = 256, text: str = "reasoning_trace", by: str = "heuristic", order: str = "ord") -> DataFrame:
    """by and wording of the first `most` training rows of each label whose normalised text isn't empty, in the rows' order. A label without any is an error."""
    # empty wordings fall out of the array: a filter on them would be pushed down, and the wording worked out twice
    wording = F.explode(F.filter(F.array(normalize(F.col(text))), lambda x: x != ""))
    kept = rows.filter(F.trim("split") == "train").select(by, order, wording.alias("wording"))
    out = written(capped(kept, by, [order], most).select(by, "wording"), "texts")  # `most` rows a label, read twice
    missing = sorted(set(labels) - {r[0] for r in out.filter(F.col(by).isin(labels)).select(by).distinct().collect()})
    if missing:
        raise ValueError(f"no training texts of {', '.join(missing)}")
    return out
