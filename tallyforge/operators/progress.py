"""Reports of progress: after so many items, or so much time, since the last report.

Whether an item is reported depends on which one was reported before it, which no frame of a window says. But where the next
report falls depends on the last one alone, and it is `items` places away at most. So runs are cut into chunks: a chunk
tells, for each of the first `items` places that a report may fall on, where the first one in the next chunk falls; these
small maps are followed along a key's chunks; and each chunk, which now knows its first report, gives all of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tallyforge.operators.selection import ordinals

#: Rows of a run that one step takes at once.
CHUNK = 4096


def _next(times: np.ndarray, own: int, last: int, items: int, wait: int) -> np.ndarray:
    """For each of the first `own` places where the next report falls; `last` is the place of the run's end."""
    at = np.arange(own)
    late = np.searchsorted(times, times[:own] + wait, "left")
    return np.minimum(np.minimum(at + items, np.maximum(late, at + 1)), last)


def progress(rows: DataFrame, by: list[str], time: str, tie: str, items: int = 10, seconds: float = 60.0, chunk: int = CHUNK) -> DataFrame:
    """by, completed, total, elapsed (seconds): a report at each item by which `items` more are completed, or `seconds` have passed, since the last report (the clock starts with a group's first item), and at the last one. Items without a time don't count; `tie` orders items of one time."""
    wait = round(seconds * 1_000_000)
    kept = rows.filter(F.col(time).isNotNull()).select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).alias("tie"))
    totals = kept.groupBy(*by).agg(F.count("*").alias("total"), F.min("at").alias("began")).select(*(F.col(c).alias(f"of_{c}") for c in by), "total", "began")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    placed = ordinals(kept, by, ["at", "tie"], "nth").withColumns({"place": (F.col("nth") - 1) % chunk, "chunk": F.floor((F.col("nth") - 1) / chunk)})
    # the first places of a chunk are seen by the one before, too
    ahead = (F.col("place") < items) & (F.col("chunk") > 0)
    seen = placed.withColumn("chunk", F.explode(F.when(ahead, F.array("chunk", F.col("chunk") - 1)).otherwise(F.array("chunk"))))
    chunks = seen.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("nth", "at"))).alias("rows")).join(totals, same).drop(*(f"of_{c}" for c in by))
    chunks = chunks.select(*by, "chunk", "total", "began", F.col("rows.at").alias("times"))
    keys = [f for f in chunks.schema if f.name in by]
    many = t.ArrayType(t.IntegerType())

    def each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, int, np.ndarray]]:
        """Row, rows of the chunk itself, times, the last place of the run as seen from here, next places."""
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        nth, total = col("chunk").to_numpy(), col("total").to_numpy()
        for i in range(batch.num_rows):
            times = col("times")[i].values.to_numpy()
            last = int(total[i] - nth[i] * chunk) - 1
            own = min(chunk, last + 1)
            yield i, own, times, last, _next(times, own, last, items, wait)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, begins = [], []
            began = batch.column(batch.schema.get_field_index("began")).to_numpy()
            for i, own, times, last, after in each(batch):
                out = [-1] * own  # -1: the run ends here
                step = after.tolist()
                for p in range(own - 1, -1, -1):
                    out[p] = -1 if p == last else step[p] - own if step[p] >= own else out[step[p]]
                maps.append(out[:items])
                # before the first item: as if one at the run's begin had been reported
                begins.append(int(min(items - 1, np.searchsorted(times, began[i] + wait, "left"), last)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keys), batch.column(batch.schema.get_field_index("chunk")), pa.array(maps, pa.list_(pa.int32())), pa.array(begins, pa.int32())], [*(f.name for f in keys), "chunk", "exits", "begin"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = []
            for steps in batch.column(batch.schema.get_field_index("steps")).to_pylist():
                at, out = steps[0]["begin"], []
                for s in steps:
                    out.append(at)
                    at = s["exits"][at] if at >= 0 else -1
                entries.append(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keys), pa.array(entries, pa.list_(pa.int32()))], [*(f.name for f in keys), "entries"])

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            entry, nth, began, rows_, completed, elapsed = col("entry").to_numpy(), col("chunk").to_numpy(), col("began").to_numpy(), [], [], []
            for i, own, times, last, after in each(batch):
                p, step = int(entry[i]), after.tolist()
                while 0 <= p < own:
                    rows_.append(i)
                    completed.append(int(nth[i]) * chunk + p + 1)
                    elapsed.append((int(times[p]) - int(began[i])) / 1e6)
                    p = step[p] if p != last else -1
            where = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([*(col(f.name).take(where) for f in keys), pa.array(completed, pa.int64()), col("total").take(where), pa.array(elapsed, pa.float64())], [*(f.name for f in keys), "completed", "total", "elapsed"])

    maps = chunks.mapInArrow(exits, t.StructType([*keys, t.StructField("chunk", t.LongType()), t.StructField("exits", many), t.StructField("begin", t.IntegerType())]))
    # of a key a row a chunk, not a row an item, comes together here
    runs = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "exits", "begin"))).alias("steps"))
    entries = runs.mapInArrow(follow, t.StructType([*keys, t.StructField("entries", many)])).select(*(F.col(c).alias(f"of_{c}") for c in by), F.posexplode("entries").alias("of_chunk", "entry"))
    told = chunks.join(entries, same & (F.col("chunk") == F.col("of_chunk"))).drop(*(f"of_{c}" for c in by), "of_chunk").filter("entry >= 0")
    long = [t.StructField(c, t.LongType()) for c in ("completed", "total")]
    return told.mapInArrow(reports, t.StructType([*keys, *long, t.StructField("elapsed", t.DoubleType())]))
