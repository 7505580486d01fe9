"""Means, rates and their standard errors as aggregate expressions, and the invariants of wrong answers."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tallyforge.functions import digits as D
from tallyforge.functions.hashing import md5_bucket


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def binary_se(flag: Column) -> Column:
    """sqrt(p (1 - p) / n) of a flag without nulls; 0 without rows."""
    p, n = rate(flag), F.count(flag)
    return F.coalesce(F.sqrt(p * (1 - p) / n), F.lit(0.0))


def mean_se(value: Column) -> Column:
    """Sample deviation over sqrt(n); 0 below two values."""
    return F.when(F.count(value) >= 2, F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(0.0)


def percent_ratio_se(num: Column, den: Column) -> Column:
    """Delta-method error of 100 (num - den) / den of means; 0 below two pairs, for a zero mean or a variance that isn't positive."""
    both = num.isNotNull() & den.isNotNull()
    x, y = F.when(both, num), F.when(both, den)
    n, mx, my = F.count(x), F.avg(x), F.avg(y)
    var = (100 / my) ** 2 * F.var_samp(x) / n + (100 * mx / my**2) ** 2 * F.var_samp(y) / n - 2 * (100 / my) * (100 * mx / my**2) * F.covar_samp(x, y) / n
    return F.when((n >= 2) & (my != 0), F.when(var > 0, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)).otherwise(0.0)


def percent_gap(x: Column, y: Column) -> Column:
    return F.when(y != 0, (x - y) / F.when(y != 0, y) * 100)


def pearson(x: Column, y: Column) -> Column:
    """0 for constant columns."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread)).otherwise(0.0)


#: A prime below 2**31: products of two numbers below it stay within 64 bits.
PRIME = 2_147_483_647
#: Chances of a Poisson number of mean 1 to be at most 0, 1, ..., 7; beyond is 8.
POISSON = tuple(round(exp(-1) * sum(1 / factorial(k) for k in range(m + 1)), 12) for m in range(8))


def draw_factors(draws: int, seed: int) -> list[tuple[int, int]]:
    """(factor, shift) of each draw: a key's hash h has the number (h * factor + shift) % PRIME in it."""
    return [((seed * 48_271 + d * 1_103_515_245) % (PRIME - 1) + 1, (seed * 69_621 + d * 12_345_701) % PRIME) for d in range(1, draws + 1)]


def bootstrap(df: DataFrame, value: str, by: str, key: str = "id", draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """by, estimate, low, high: percentile interval of the mean over `draws` Poisson resamples.

    A row's weight in a draw is a Poisson(1) number of the hash of its key, which should be its own: rows of one key are
    resampled together, as clusters are. There's no state between rows: a task adds up the weights and weighted values of
    all draws of its rows, and only such sums, a row a group and draw, move. Rows without a value don't count.
    """
    factors = np.array(draw_factors(draws, seed), np.int64)
    cuts = np.array([int(p * PRIME) for p in POISSON])
    keyed = df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"), md5_bucket(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), PRIME).cast("bigint").alias("h")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    schema = t.StructType([t.StructField("by", keyed.schema["by"].dataType), *(t.StructField(c, t.DoubleType()) for c in ("w", "s")), t.StructField("draw", t.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.fill_null(len(names.dictionary)).to_numpy()
            labels = [*names.dictionary.to_pylist(), None]
            v, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i in range(0, len(v), 512):
                w = np.searchsorted(cuts, (h[i : i + 512, None] * factors[:, 0] + factors[:, 1]) % PRIME, "right").astype(np.float64)
                for c in np.unique(code[i : i + 512]):
                    own = code[i : i + 512] == c
                    total = sums.setdefault(labels[c], np.zeros((2, draws)))
                    total += np.stack([w[own].sum(0), v[i : i + 512][own] @ w[own]])
        for label, (w, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * draws, batch.column(0).type), pa.array(w), pa.array(s), pa.array(np.arange(draws), pa.int32())], [f.name for f in schema])

    means = keyed.mapInArrow(run, schema).groupBy("by", "draw").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).filter("w > 0").withColumn("m", F.col("s") / F.col("w"))
    tail = (1 - level) / 2
    ends = means.groupBy("by").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")).select(F.col("by").alias("of"), "low", "high")
    plain = keyed.groupBy("by").agg(F.avg("v").alias("estimate"))
    return plain.join(ends, F.col("by").eqNullSafe(F.col("of"))).select(F.col("by").alias(by), "estimate", "low", "high")


def _wrong(df: DataFrame, answer: str, product: str, exact: bool) -> DataFrame:
    """Positive answers that aren't right; by way of a double unless exact."""
    m = F.col(answer).cast(D.BIG)
    m = m if exact else F.floor(m.cast("double")).cast(D.BIG)
    return df.withColumn("m", m).withColumn("p", F.col(product).cast(D.BIG)).filter((F.col("m") > 0) & (F.col("p") > 0))


def suffix_rates(df: DataFrame, by: list[str], answer: str = "model_answer", product: str = "product", most: int = 4, exact: bool = True) -> DataFrame:
    """by, k, n, rate: the share of wrong answers whose last k digits are right."""
    rows = _wrong(df, answer, product, exact).filter("m <> p").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    step = D.power10(F.col("k")).cast(D.BIG)
    return rows.groupBy(*by, "k").agg(F.count("*").alias("n"), rate(F.pmod("m", step) == F.pmod("p", step)).alias("rate"))


def modulo_rates(df: DataFrame, answer: str = "model_answer", product: str = "product", moduli=(2, 5, 9, 10), exact: bool = True) -> DataFrame:
    """modulus, n_wrong, wrong_rate, n_right, right_rate: how many answers agree with the product modulo each."""
    rows = _wrong(df, answer, product, exact).withColumn("modulus", F.explode(F.array(*(F.lit(x) for x in moduli))))
    q = F.col("modulus").cast(D.BIG)
    same, right = F.pmod("m", q) == F.pmod("p", q), F.col("m") == F.col("p")
    return rows.groupBy("modulus").agg(F.count_if(~right).alias("n_wrong"), rate(F.when(~right, same)).alias("wrong_rate"), F.count_if(right).alias("n_right"), rate(F.when(right, same)).alias("right_rate"))
