"""Adapters' weights as long tables: moments, cosines, inner products of low-rank updates, and summaries of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, by: str, value: str, tiny: float = 1e-6) -> DataFrame:
    """Count, mean, population deviation, norm, extremes and the share of near zeros."""
    v = F.col(value).cast("double")
    return df.groupBy(by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.sum(v * v)).alias("l2"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg((F.abs(v) < tiny).cast("double")).alias("sparsity"),
    )


def cosines(weights: DataFrame) -> DataFrame:
    """weights: name, key, value (a row a cell). name_1, name_2, cosine: joined on the cell's key, so that no vector is in one place."""
    w = weights.select("name", "key", F.col("value").cast("double").alias("value"))
    norms = w.groupBy("name").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    both = w.alias("x").join(w.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.name") < F.col("y.name")))
    dots = both.groupBy(F.col("x.name").alias("name_1"), F.col("y.name").alias("name_2")).agg(F.sum(F.col("x.value") * F.col("y.value")).alias("dot"))
    n1, n2 = norms.select(F.col("name").alias("name_1"), F.col("norm").alias("norm_1")), norms.select(F.col("name").alias("name_2"), F.col("norm").alias("norm_2"))
    scale = F.col("norm_1") * F.col("norm_2")
    return dots.join(n1, "name_1").join(n2, "name_2").select("name_1", "name_2", F.when(scale > 0, F.col("dot") / F.when(scale > 0, scale)).otherwise(0.0).alias("cosine"))


def update_inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """a: name, r, i, value; b: name, o, r, value: the factors of an update B A. name_1, name_2, inner: <B1 A1, B2 A2> as the
    sum over r x r of (B1' B2) * (A1 A2'), so that the products B A are never made."""
    g = b.alias("x").join(b.alias("y"), (F.col("x.o") == F.col("y.o")) & (F.col("x.name") <= F.col("y.name")))
    g = g.groupBy(F.col("x.name").alias("name_1"), F.col("y.name").alias("name_2"), F.col("x.r").alias("r1"), F.col("y.r").alias("r2")).agg(F.sum(F.col("x.value") * F.col("y.value")).alias("g"))
    h = a.alias("x").join(a.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.name") <= F.col("y.name")))
    h = h.groupBy(F.col("x.name").alias("name_1"), F.col("y.name").alias("name_2"), F.col("x.r").alias("r1"), F.col("y.r").alias("r2")).agg(F.sum(F.col("x.value") * F.col("y.value")).alias("h"))
    return g.join(h, ["name_1", "name_2", "r1", "r2"]).groupBy("name_1", "name_2").agg(F.sum(F.col("g") * F.col("h")).alias("inner"))


def update_inner_of_experts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same, summed over experts: a: name, expert, r, i, value; b: name, expert, o, r, value.

    A factor that has one expert only stands for all experts of the other's; it isn't copied, its rows meet each expert's.
    Two factors of different numbers of experts, both more than one, are an error.
    """

    def told(x: DataFrame) -> DataFrame:
        many = x.groupBy("name").agg((F.max("expert") + 1).alias("experts"))
        counts = {r["experts"] for r in many.filter("experts > 1").select("experts").distinct().limit(2).collect()}
        if len(counts) > 1:
            raise ValueError(f"factors of {sorted(counts)} experts")
        return x.join(F.broadcast(many), "name").withColumn("expert", F.when(F.col("experts") > 1, F.col("expert")))

    def meet(x: DataFrame, y: DataFrame, keys: list[str], names: bool) -> DataFrame:
        """Rows of equal keys whose experts are equal, or of which one side stands for all (null)."""
        left, right = (z.select(*keys, *(F.col(c).alias(f"{c}_{i}") for c in z.columns if c not in keys)) for i, z in ((1, x), (2, y)))
        parts = [left.filter("expert_1 is not null").join(right.filter("expert_2 is not null").withColumn("expert_1", F.col("expert_2")), [*keys, "expert_1"]), left.filter("expert_1 is null").join(right, keys), left.filter("expert_1 is not null").join(right.filter("expert_2 is null"), keys)]
        out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("expert", F.coalesce("expert_1", "expert_2"))
        return out.filter("name_1 <= name_2") if names else out

    def gram(x: DataFrame, over: str, name: str) -> DataFrame:
        cells = told(x).select("name", "expert", over, "r", "value")
        return meet(cells, cells, [over], True).groupBy("name_1", "name_2", "r_1", "r_2", "expert").agg(F.sum(F.col("value_1") * F.col("value_2")).alias(name))

    both = meet(gram(b, "o", "g"), gram(a, "i", "h"), ["name_1", "name_2", "r_1", "r_2"], False)
    return both.groupBy("name_1", "name_2").agg(F.sum(F.col("g_1") * F.col("h_2")).alias("inner"))


def pair_summary(pairs: DataFrame, primary=("DD", "OT", "RC")) -> DataFrame:
    """One row: mean cosine of pairs of one label and of two, of seed controls (exactly one side seeded), of primary pairs, and gaps."""
    base = lambda c: F.regexp_replace(c, "_SEED.*$", "")
    seeded = lambda c: F.contains(F.col(c), F.lit("_SEED"))
    b1, b2, s1, s2 = base("name_1"), base("name_2"), seeded("name_1"), seeded("name_2")
    c = F.col("cosine")
    control = (b1 == b2) & (s1 != s2) & b1.isin(*primary)
    out = pairs.agg(F.avg(F.when(b1 == b2, c)).alias("same_avg"), F.avg(F.when(b1 != b2, c)).alias("cross_avg"), F.avg(F.when(control, c)).alias("control_avg"), F.avg(F.when(~s1 & ~s2 & b1.isin(*primary) & b2.isin(*primary) & (b1 != b2), c)).alias("primary_cross_avg"), F.min(F.when(b1 != b2, c)).alias("min_cross"), F.max(F.when(b1 != b2, c)).alias("max_cross"))
    return out.withColumns({"gap": F.col("same_avg") - F.col("cross_avg"), "control_gap": F.col("control_avg") - F.col("primary_cross_avg")}).withColumn("verdict", F.when(F.col("gap") > 0.2, "strong").when(F.col("gap") > 0.05, "moderate").otherwise("weak"))


def matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """The symmetric matrix, 1 on the diagonal, null where a pair is missing."""
    both = pairs.select("name_1", "name_2", "cosine").union(pairs.select("name_2", "name_1", "cosine"))
    diagonal = pairs.select("name_1").union(pairs.select("name_2")).distinct().select("name_1", F.col("name_1").alias("name_2"), F.lit(1.0).alias("cosine"))
    return both.union(diagonal).groupBy(F.col("name_1").alias("name")).pivot("name_2", names).agg(F.first("cosine"))
