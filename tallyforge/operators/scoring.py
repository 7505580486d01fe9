"""Losses of prompts by a client that the caller brings, with few calls under way at a time, and cascades of ways to call it.

A client is made once a task by a function that the caller gives (clients hold connections, which don't travel), and has
`loss(prompt) -> float`, or `losses(prompts, tier) -> list of floats` for calls that take several prompts at once. A call
that raises has failed; its rows' losses are values, not errors.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tallyforge.sources.scratch import written

Client = Callable[[], object]


def call(client: object, prompts: list[str], tier: str) -> list[float] | None:
    """Losses of prompts in one call, None if it failed or returned another number of losses or one that is no number."""
    try:
        got = client.losses(prompts, tier) if hasattr(client, "losses") else [client.loss(p) for p in prompts]
        out = [float(x) for x in got]
    except Exception:  # whatever a client raises: the rows count as failed
        return None
    return None if len(out) != len(prompts) or any(math.isnan(x) for x in out) else out


def each(client: object, prompts: list[str], tier: str) -> list[float]:
    """The same, but infinite where a call failed: all of them if the client takes several prompts at once, else the prompt's own."""
    if hasattr(client, "losses"):
        return call(client, prompts, tier) or [math.inf] * len(prompts)
    return [(call(client, [p], tier) or [math.inf])[0] for p in prompts]


def in_order(units: Iterator[tuple[object, list[str]]], client: object, tier: str, in_flight: int, of: Callable = call) -> Iterator[tuple[object, list[float] | None]]:
    """Units and their losses in the order of the units, `in_flight` calls at a time; no unit is taken before there is room for it."""
    with ThreadPoolExecutor(in_flight) as pool:
        under_way: deque[tuple[object, Future]] = deque()
        for rows, prompts in units:
            if len(under_way) == in_flight:
                first, result = under_way.popleft()
                yield first, result.result()
            under_way.append((rows, pool.submit(of, client, prompts, tier)))
        while under_way:
            first, result = under_way.popleft()
            yield first, result.result()


def score(rows: DataFrame, make: Client | None, prompt: str = "prompt", batch: int = 30, in_flight: int = 4) -> DataFrame:
    """rows with `loss`: of their prompts, `batch` at a time; infinite where a call failed or the prompt is null. Without a client a tenth of the prompt's length."""
    if make is None:
        return rows.withColumn("loss", F.coalesce(F.length(prompt) * F.lit(0.1), F.lit(float("inf"))))
    schema = t.StructType([*rows.schema, t.StructField("loss", t.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()

        def units() -> Iterator[tuple[pa.RecordBatch, list[str]]]:
            for b in batches:
                for i in range(0, b.num_rows, batch):
                    part = b.slice(i, batch)
                    yield part, [p for p in part.column(part.schema.get_field_index(prompt)).to_pylist() if p is not None]

        for part, got in in_order(units(), client, "batch", in_flight, each):
            values = iter(got)
            losses = [math.inf if p is None else next(values) for p in part.column(part.schema.get_field_index(prompt)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(losses, pa.float64())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def pass_over(rows: DataFrame, make: Client, tier: str, unit: Sequence[str], prompt: str = "prompt", in_flight: int = 4) -> DataFrame:
    """rows with `loss`: a call for each group of equal `unit`, null for all of a group whose call failed."""
    schema = t.StructType([*rows.schema, t.StructField("loss", t.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()

        def units() -> Iterator[tuple[pa.Table, list[str]]]:
            waiting: list[pa.RecordBatch] = []
            key = None
            for b in batches:
                keys = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in unit), strict=True))
                begin = 0
                for i, k in enumerate(keys):
                    if waiting or i > begin:
                        if k != key:
                            if i > begin:
                                waiting.append(b.slice(begin, i - begin))
                            yield joined(waiting)
                            waiting, begin = [], i
                    key = k
                if len(keys) > begin:
                    waiting.append(b.slice(begin))
            if waiting:
                yield joined(waiting)

        def joined(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[str]]:
            table = pa.Table.from_batches(parts)
            return table, table.column(prompt).to_pylist()

        for table, got in in_order(units(), client, tier, in_flight):
            yield from table.append_column("loss", pa.array(got if got is not None else [None] * table.num_rows, pa.float64())).to_batches()

    order = [*unit, *(c for c in rows.columns if c not in unit)]
    return rows.repartition(*unit).sortWithinPartitions(*order).mapInArrow(run, schema)


def cascade(rows: DataFrame, make: Client, tiers: Sequence[tuple[str, Sequence[str]]], prompt: str = "prompt", in_flight: int = 4) -> DataFrame:
    """rows with `loss` and `tier`. tiers: (name, columns whose groups are one call), coarsest first. Only the rows of failed calls come to the next tier; what failed in all has an infinite loss and no tier. A unit's rows are one call, so units are as small as calls can be."""
    left, done = rows, None
    for name, unit in tiers:
        tried = written(pass_over(left, make, name, unit, prompt, in_flight), f"tier-{name}")  # read twice: by what worked and by what goes on
        good = tried.filter("loss is not null").withColumn("tier", F.lit(name))
        done = good if done is None else done.unionByName(good)
        left = tried.filter("loss is null").drop("loss")
    lost = left.withColumns({"loss": F.lit(float("inf")), "tier": F.lit(None).cast("string")})
    return lost if done is None else done.unionByName(lost)


def mean_finite(rows: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    """by, n_finite and the mean of the finite losses, infinite without any."""
    finite = F.when(F.abs(loss) < F.lit(float("inf")), F.col(loss))
    return rows.groupBy(*by).agg(F.count(finite).alias("n_finite"), F.coalesce(F.avg(finite), F.lit(float("inf"))).alias("loss"))
