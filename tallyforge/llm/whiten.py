"""Whitening of embeddings: rows on the unit eigenvectors of their covariance, in units of its standard deviations.

Entries become whole numbers first (`SCALE` steps a unit, moved by `SHIFT`), so that sums and deviations are exact. The
eigenvectors are the right singular vectors of the distributed centred rows (MLlib's computeSVD, whose singular values
squared, divided by the number of rows, are the eigenvalues); the total variance is taken from the exact deviations, not
from the decomposition. Rows are passed over four times; what the driver gets is of the size of a covariance matrix.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are those of another number of entries
than most rows have (of equally many, the longer): they lack entries. Steps beyond 2**52 are held there. Repeated rows
and ids count as often as they are there, a null id stays. Components of no variance (below 1e-12 of the largest) can't
be whitened and aren't returned; without rows, or with all rows equal, the result is empty. Exact deviations are decimal;
as a long, one beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tallyforge.llm.shared import Sent, small_batches

SCALE, SHIFT = 64, 1_000_000
FAR = 1 << 52


def whole(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """key and x, the array of whole numbers, of rows that count."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = rows.filter(F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0))
    sizes = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    good = good.filter(F.size(vector) == (sizes["d"] if sizes else 0))
    step = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(FAR))), F.lit(float(-FAR)))).cast("long") + SHIFT
    return good.select(F.col(key).alias("key"), F.transform(v, step).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def sums(x: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums of each dimension: a row of partial sums a task, added up by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column(0)).astype(object).sum(0) if _wide(batch.column(0)) else _matrix(batch.column(0)).sum(0)
                total = part.astype(object) if total is None else total + part
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), n)), pa.array(np.arange(len(total)), pa.int32()), pa.array([str(v) for v in total])], ["n", "i", "s"])

    rows = x.select("x").mapInArrow(run, "n long, i int, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (rows[0]["n"], np.array([int(r["s"]) for r in rows], object)) if rows else (0, np.zeros(0, object))


def _wide(column: pa.Array) -> bool:
    """Whether a batch's sums may leave 64 bits."""
    m = _matrix(column)
    return bool(len(m)) and int(np.abs(m).max()) * len(m) >= 1 << 62


def deviations(m: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """Exact sums over dimensions of (n * x - s) squared, in 64 bits where they surely fit."""
    most = n * int(np.abs(m).max(initial=0)) + max((abs(int(v)) for v in s), default=0)
    if most < 1 << 62:
        d = n * m - s.astype(np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * max(1, m.shape[1]) < 1 << 62:
            return (d * d).sum(1).tolist()
        return (d.astype(object) ** 2).sum(1).tolist()
    return ((n * m.astype(object) - s) ** 2).sum(1).tolist()


def centred(m: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n: whole parts are subtracted first, so that no digits are lost."""
    base = np.array([int(v) // n for v in s], np.int64)
    return (m - base).astype(np.float64) - np.array([int(v) % n / n for v in s])


def components(x: DataFrame, n: int, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of the covariance, largest first."""
    d = len(s)
    base, rest = [int(v) // n for v in s], [int(v) % n / n for v in s]
    low, part = F.array(*map(F.lit, base)).cast("array<long>"), F.array(*map(F.lit, rest)).cast("array<double>")
    away = F.zip_with(F.zip_with("x", low, lambda a, b: (a - b).cast("double")), part, lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(away).alias("v")), "v")
    # more than half of the dimensions are asked for: MLlib then adds up one covariance and decomposes it, instead of a pass over all rows for each step of an iteration
    svd = RowMatrix(rows, n, d).computeSVD(min(d, max(k, d // 2 + 1)), False, 1e-12)
    sigma, v = svd.s.toArray(), svd.V.toArray()
    e = sigma**2 / n
    keep = e > 1e-12 * e.max(initial=0)
    return e[keep][:k], v[:, keep][:, :k]


def _partial(of) -> object:
    """A mapInArrow function that adds up of(matrix) over a task's rows and returns it as (i, v) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    return run


def _added(x: DataFrame, of) -> np.ndarray:
    rows = x.select("x").mapInArrow(_partial(of), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


def whiten(rows: DataFrame, most: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each counted row and component up to `most`."""
    small_batches(rows.sparkSession)
    x = whole(rows, vector, key)
    kind = rows.schema[key].dataType
    schema = t.StructType([t.StructField("key", kind), t.StructField("component", t.IntegerType()), t.StructField("n", t.LongType()), t.StructField("deviation", t.StringType()), *(t.StructField(c, t.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    n, s = sums(x)
    e, v = components(x, n, s, most) if n else (np.zeros(0), np.zeros((0, 0)))
    if not len(e):
        empty = rows.sparkSession.createDataFrame([], schema)
        return empty.select(F.col("key").alias(key), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
    turn = v / np.sqrt(e)
    sent = Sent(rows.sparkSession, (n, s, turn))

    def white(m: np.ndarray) -> np.ndarray:
        n, s, turn = sent.value
        return centred(m, n, s) @ turn

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, _ = sent.value
        total = 0
        for batch in batches:
            total += sum(deviations(_matrix(batch.column(0)), n, s)) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["v"])

    # the sum may have more digits than a decimal holds: tasks' sums, as many as there are tasks, are added as doubles
    total = float(x.select("x").mapInArrow(spread, "v string").agg(F.sum(F.col("v").cast("double"))).first()[0])
    trace = total / n / n / n
    k = len(e)
    mean = _added(x, lambda m: white(m).sum(0)) / n

    def product(m: np.ndarray) -> np.ndarray:
        w = white(m) - mean
        return w.T @ w

    cov = _added(x, product).reshape(k, k) / n
    error = float(np.abs(cov - np.eye(k)).max())
    told = (e / trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, _ = sent.value
        for batch in batches:
            m = _matrix(batch.column(1))
            w, rows_ = white(m), np.repeat(np.arange(len(m)), k)
            dev = pa.array([str(d) for d in deviations(m, n, s)], pa.string())
            columns = [batch.column(0).take(pa.array(rows_)), pa.array(np.tile(np.arange(1, k + 1), len(m)), pa.int32()), pa.array(np.full(len(rows_), n)), dev.take(pa.array(rows_)), pa.array(w.ravel()), pa.array(np.tile(told, len(m))), pa.array(np.full(len(rows_), error))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return x.mapInArrow(run, schema).select(F.col("key").alias(key), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
