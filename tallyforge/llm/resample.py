"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target's texts.

Features are runs of 1 to n words; a feature's bucket is its crc32 modulo the number of buckets. The strings are counted
globally first, each distinct one is hashed once, and buckets are sums over this dictionary. Gains come back to
documents by a join on the strings: texts are taken in blocks of some MB, a block lists its distinct strings once and its
documents' counts refer to them, so that the join meets a row a block and string instead of one a document and string. A
string of every text is a row a block on one side and one row on the other: Spark can split it. No step holds the
dictionary as a whole.

Null and empty texts have no features and weight 0; a null id counts as an empty text in the draw's hash and comes last
among ties. Repeated rows are drawn like others: each has its own rank, in no particular order among equals. Without
documents the result is empty, without target texts all counts of the target are 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tallyforge.llm import textvec
from tallyforge.llm.shared import discard, materialize, small_batches, spent_shuffles_go, steps, utf8

#: UTF-8 bytes of the texts of a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[textvec.Words, np.ndarray]:
    """Words and their lengths."""
    w = textvec.words(data, offsets, textvec.PLAIN)
    gaps = np.append(np.flatnonzero(textvec.PLAIN[data] == 0), len(data))
    return w, np.minimum(gaps[np.searchsorted(gaps, w.start)], offsets[w.doc + 1]) - w.start


def block_features(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a block: its distinct features and their uses; the texts' counts as (first, code, count), where first has a place for each text and one more; and each text's number of words."""
    w, length = _words(data, offsets)
    hashes, docs, at, size = [], [], [], []
    for k in range(1, n + 1):
        h, doc, start = textvec.runs(w.hashes, w.first, k)
        hashes.append(textvec.mix(h + np.uint64(k)))
        docs.append(doc)
        at.append(start)
        size.append(np.full(len(h), k))
    hashes, docs, at, size = (np.concatenate(x) for x in (hashes, docs, at, size))
    _, one, code, uses = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lower, names = textvec.PLAIN[data].tobytes(), []
    begin, end = w.start.tolist(), (w.start + length).tolist()
    for i, k in zip(at[one].tolist(), size[one].tolist(), strict=True):
        names.append(lower[begin[i] : end[i]] if k == 1 else b" ".join(lower[begin[j] : end[j]] for j in range(i, i + k)))
    n_docs, width = len(offsets) - 1, max(1, len(one))
    pair, count = np.unique(docs.astype(np.int64) * width + code, return_counts=True)
    first = np.searchsorted(pair, np.arange(n_docs + 1, dtype=np.int64) * width)
    return [x.decode("utf-8", "replace") for x in names], uses, first, pair % width, count, np.diff(w.first)


def features(texts: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Rows of two kinds: (block, code, feature, uses) of a block's distinct features; and one a block with its texts' keys, numbers of words and counts."""
    small_batches(texts.sparkSession)
    ids = texts.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")) if key else texts.select(F.lit(None).cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    kind = ids.schema["key"].dataType
    long, ints = t.LongType(), t.ArrayType(t.IntegerType())
    schema = t.StructType([t.StructField(name, x) for name, x in (("block", long), ("code", t.IntegerType()), ("feature", t.StringType()), ("uses", long), ("keys", t.ArrayType(kind)), ("words", ints), ("first", ints), ("codes", ints), ("counts", ints))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Keys and joined texts of some BLOCK_BYTES."""
        waiting: list[pa.RecordBatch] = []
        size = 0

        def joined() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            keys = rows.column(0).combine_chunks()
            data, offsets = utf8(rows.column(1))
            for i, j in steps(offsets, BLOCK_BYTES):
                yield keys.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]

        for batch in batches:  # Spark's batches may be far smaller than a block
            waiting.append(batch)
            size += batch.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield from joined()
                waiting, size = [], 0
        if waiting:
            yield from joined()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [f.name for f in schema]
        for block, (keys, data, offsets) in enumerate(blocks(batches), TaskContext.get().partitionId() << 32):
            names, uses, first, codes, counts, words = block_features(data, offsets, n)
            many = [pa.array(np.full(len(names), block)), pa.array(np.arange(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array(uses, pa.int64())]
            one = [pa.array([block]), *(pa.nulls(1, x.type) for x in many[1:])]
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            arrays = [whole(keys), *(whole(pa.array(x, pa.int32())) for x in (words, first, codes, counts))]
            yield pa.RecordBatch.from_arrays([*many, *(pa.nulls(len(names), x.type) for x in arrays)], columns)
            yield pa.RecordBatch.from_arrays([*one, *arrays], columns)

    return ids.mapInArrow(run, schema)


def dictionary(found: DataFrame, buckets: int) -> DataFrame:
    """feature, uses, bucket: each distinct string once."""
    return found.filter("feature is not null").groupBy("feature").agg(F.sum("uses").alias("uses")).withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain of every bucket of `own`: at most `buckets` rows."""
    s = own.groupBy("bucket").agg(F.sum("uses").cast("double").alias("s"))
    t_ = target.groupBy("bucket").agg(F.sum("uses").cast("double").alias("t"))
    totals = [float(x.agg(F.sum(c)).first()[0] or 0.0) for x, c in ((s, "s"), (t_, "t"))]
    t1 = F.coalesce(F.col("t"), F.lit(0.0)) + 1
    ratio = (t1 * F.lit(totals[0] + buckets)) / ((F.col("s") + 1) * F.lit(totals[1] + buckets))
    return s.join(F.broadcast(t_), "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def block_gains(found: DataFrame, worth: DataFrame) -> DataFrame:
    """block and the gains of its features, in the order of their codes. worth: feature, gain."""
    words = found.filter("feature is not null").select("block", "code", "feature").join(worth, "feature")
    return words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", F.col("gain").cast("int").alias("gain"))))["gain"].alias("gain"))


def weigh(found: DataFrame, by_block: DataFrame, kind: t.DataType) -> DataFrame:
    """key, n_words, n_features, weight of each text."""
    texts = found.filter("feature is null").select("block", "keys", "words", "first", "codes", "counts").join(by_block, "block", "left")
    long = t.LongType()
    schema = t.StructType([t.StructField("block", long), t.StructField("nth", t.IntegerType()), t.StructField("key", kind), *(t.StructField(x, long) for x in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name, i=i, batch=batch: batch.column(batch.schema.get_field_index(name))[i].values
                first, counts = cell("first").to_numpy(), cell("counts").to_numpy().astype(np.int64)
                gain = cell("gain")
                got = counts * (gain.to_numpy()[cell("codes").to_numpy()] if len(counts) else 0)
                total, n = (np.diff(np.concatenate([[0], np.cumsum(x)])[first]) for x in (got, counts))
                block = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(np.arange(len(n)), pa.int32()), cell("keys"), pa.array(cell("words").to_numpy().astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))], [f.name for f in schema])

    return texts.mapInArrow(run, schema)


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a Gumbel number of the key's hash, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight, score, rank (null: not drawn) of every document. target: text."""
    kind = docs.schema[key].dataType
    spark = docs.sparkSession
    with spent_shuffles_go(spark):
        found = materialize(features(docs, n, key), "features")
        words = materialize(dictionary(found, buckets), "dictionary")
        worth = words.join(F.broadcast(gains(words, dictionary(features(target, n), buckets), buckets)), "bucket").select("feature", "gain")
        by_block = materialize(block_gains(found, worth), "gains")
        scored = materialize(weigh(found, by_block, kind).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "scores")
    discard(found, words, by_block)
    fair = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("block"), F.asc("nth")]
    # ranges of the order that are dealt once and written: numbers within them, after the sizes of those before
    ranged = materialize(scored.withColumn("fair", fair).repartitionByRange(F.desc("fair"), *order).withColumn("part", F.spark_partition_id()), "ranges", narrow=True)
    sizes = ranged.groupBy("part").agg(F.count_if("fair").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    drawn = percent * ranged.filter("fair").count() // 100
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("fair"), *order)) + F.col("before")
    rank = F.when(F.col("fair") & (F.col("nth_of_all") <= drawn), F.col("nth_of_all")).cast("long")
    return ranged.join(F.broadcast(sizes), "part").withColumn("nth_of_all", nth).select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"))
