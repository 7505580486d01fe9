"""Sets of whole numbers that can be counted and indexed: the k-th member comes by arithmetic, so draws need no rejection and differ from each other."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.operators.joins import without_leaks


class Run(NamedTuple):
    """Members first, first + step, ..., `count` of them; with skip, the numbers from `first` on that `skip` doesn't divide."""

    first: int
    step: int
    count: int
    skip: int = 0


class Members:
    """Runs one after the other, each rising."""

    def __init__(self, runs: Sequence[Run]) -> None:
        self.runs = [r for r in runs if r.count > 0]
        self.size = sum(r.count for r in self.runs)

    def __getitem__(self, k: int) -> int:
        for r in self.runs:
            if k < r.count:
                return _kth_without(r.first, k, r.skip) if r.skip else r.first + k * r.step
            k -= r.count
        raise IndexError(k)

    def member(self, k: Column) -> Column:
        """The k-th (from 0), null beyond the last."""
        out, before = F.lit(None).cast("bigint"), self.size
        for r in reversed(self.runs):
            before -= r.count
            at = k - before
            value = F.lit(r.first) + at * r.step
            if r.skip:
                at = at + _skipped_below(r.first, r.skip)
                value = at + F.floor(at / (r.skip - 1)) + 1
            out = F.when((k >= before) & (k < before + r.count), value.cast("bigint")).otherwise(out)
        return out


def _skipped_below(first: int, skip: int) -> int:
    """How many positive numbers below `first` aren't multiples of skip."""
    return (first - 1) - (first - 1) // skip


def _kth_without(first: int, k: int, skip: int) -> int:
    at = k + _skipped_below(first, skip)
    return at + at // (skip - 1) + 1


def of_length(digits: int, low: int, high: int) -> Members:
    bounds = D.digit_bounds(digits, low, high)
    return Members([Run(bounds[0], 1, bounds[1] - bounds[0] + 1)] if bounds else [])


def multiples(digits: int, low: int, high: int, of: int, rest: int = 0) -> Members:
    """Numbers of a length within bounds that leave `rest` when divided by `of`."""
    bounds = D.digit_bounds(digits, low, high)
    if not bounds:
        return Members([])
    first = bounds[0] + (rest - bounds[0]) % of
    return Members([Run(first, of, (bounds[1] - first) // of + 1)] if first <= bounds[1] else [])


def last_digit(digits: int, low: int, high: int, digit: int) -> Members:
    return multiples(digits, low, high, 10, digit)


def far_from_bases(digits: int, low: int, high: int, bases: Sequence[int], distance: int, skip: int = 5) -> Members:
    """Numbers of a length that lie more than `distance` steps of its scale from their nearest base (of two the smaller) and aren't multiples of skip."""
    bounds = D.digit_bounds(digits, low, high)
    if not bounds:
        return Members([])
    runs, known = [], sorted(bases)
    for i, base in enumerate(known):
        # numbers nearest to this base: from behind the middle to the one before, up to the middle to the next
        lo = max(bounds[0], (known[i - 1] + base) // 2 + 1) if i else bounds[0]
        hi = min(bounds[1], (base + known[i + 1]) // 2) if i + 1 < len(known) else bounds[1]
        away = distance * D._scale(base)
        for a, b in ((lo, min(hi, base - away - 1)), (max(lo, base + away + 1), hi)):
            if a <= b:
                runs.append(Run(a, 1, _skipped_below(b + 1, skip) - _skipped_below(a, skip), skip))
    return Members(runs)


def draw(spark: SparkSession, members: Members, n: int, seed: int = 42) -> DataFrame:
    """i and member: n different members in a shuffled order, by a one-to-one step over all indices."""
    if n > members.size:
        raise ValueError(f"{n} of {members.size} members")
    size = max(1, members.size)
    step = max(1, min(int(size * 0.6180339887), (1 << 31) - 1))
    while gcd(step, size) != 1:
        step -= 1
    if n * step >= 1 << 63:
        raise ValueError("too many members to be drawn at once")
    return spark.range(n).select(F.col("id").alias("i"), members.member((F.col("id") * step + seed % size) % size).alias("member"))


def near_base_pairs(spark: SparkSession, bases: Sequence[int], most: int = 2) -> DataFrame:
    """Every pair of numbers near one base, in one order: (base, a, b), numbered throughout, so that executors make their own parts."""
    out = None
    for base in bases:
        near = D.near_offsets(base, most)
        values = sorted({base + s * x for x in near for s in (1, -1) if base + s * x >= 10})
        m = len(values)
        k = F.col("id")
        row = F.floor((F.sqrt(k * 8 + 1) - 1) / 2)
        row = F.when(row * (row + 1) / 2 > k, row - 1).otherwise(row).cast("int")  # roots may be off by one
        pairs = spark.range(m * (m + 1) // 2).select("id", row.alias("row")).select("id", F.when((F.col("row") + 1) * (F.col("row") + 2) / 2 <= F.col("id"), F.col("row") + 1).otherwise(F.col("row")).alias("row"))
        table = F.array(*(F.lit(v).cast("bigint") for v in values))
        at = (F.col("id") - F.col("row") * (F.col("row") + 1) / 2).cast("int")
        part = pairs.select(F.lit(base).cast("bigint").alias("base"), F.get(table, at).alias("a"), F.get(table, F.col("row")).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


def fresh(pool: DataFrame, known: DataFrame) -> DataFrame:
    """Different pairs (a, b) of a pool, in either order, that aren't among known ones."""
    # a is an aggregate, not a group's key: conditions on what is worked out of it aren't pushed into the pool's expressions
    one = pool.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"))
    return without_leaks(one.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), known, None)
