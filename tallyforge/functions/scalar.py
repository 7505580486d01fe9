"""The detectors for one value: a row of the same expressions that tables use."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.functions import text as T


def _one(spark: SparkSession, value: Column) -> Row:
    return spark.range(1).select(value.alias("x")).first()["x"]


def _whole(n: int | None) -> Column:
    return F.lit(None if n is None else str(n)).cast(D.BIG)


def from_error(spark: SparkSession, a: int, b: int, answer: int | None) -> Row:
    """(label, confidence) of the error basis that an answer's miss is in."""
    got = _one(spark, D.error_shape(_whole(a), _whole(b), _whole(answer)))
    return got if got["label"] is not None else Row(label="UNKNOWN", confidence=0.0)


def from_trace(spark: SparkSession, trace: str | None) -> Row:
    """(label, confidence, ot, dd, rc) of a trace's wording."""
    return _one(spark, T.classify(F.lit(trace).cast("string")))


def seed_all(seed: int = 42) -> None:
    """Seeds of the driver's random generators; what runs on executors draws from hashes."""
    random.seed(seed)
    np.random.seed(seed)
