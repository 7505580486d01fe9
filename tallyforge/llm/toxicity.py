"""Toxicity by a factorization machine over hashed terms.

Terms are whole words and the 5-byte pieces inside words, hashed into 2**20 buckets. Of these, the buckets whose
document frequencies differ most between the labels in the training sample (chi-square) are the machine's inputs,
1 if present. Besides a weight for each input it learns a vector for each; their products weigh pairs of inputs,
so that two terms together may count for more, or less, than their sum.

Edge cases: a null or empty text has no terms and gets the score of the bias; without labelled rows of both
labels every score is the share of label 1 (0 without labels); repeated rows give repeated results; an empty
table gives an empty one; of several labels of a document the highest holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import Sent, by_step, small_batches
from tallyforge.llm.textvec import CODES, PLAIN, U64, mix, words

#: Labelled documents to learn from at most, by label; inputs and factors of the machine.
SAMPLE = {1: 4000, 0: 12000}
BITS, INPUTS, FACTORS, PIECE = 20, 1024, 6, 5
THRESHOLD = 0.7


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each term, with repeats."""
    w = words(data, offsets, PLAIN)
    if not len(w.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = PLAIN[data]
    inside = b > 0
    edge = np.zeros(len(b) + 1, np.int32)
    edge[w.start] = 1
    nth = np.cumsum(edge[:-1])  # of the word at or before each byte
    n = len(b) - PIECE + 1
    docs, buckets = [w.doc], [(w.hashes >> U64(64 - BITS)).astype(np.int64)]
    if n > 0:
        at = np.flatnonzero(inside[:n] & inside[PIECE - 1 :] & (nth[:n] == nth[PIECE - 1 :]))
        h = np.zeros(len(at), U64)
        for j in range(PIECE):
            h = h * U64(0x9E3779B97F4A7C15) + CODES[b[at + j]]
        docs.append(w.doc[nth[at] - 1])
        buckets.append((mix(h) >> U64(64 - BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


@dataclass
class Machine:
    column: np.ndarray  # of each bucket, or the number of inputs
    bias: float
    w: np.ndarray
    v: np.ndarray  # inputs x factors

    def inputs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.w) + 1), np.float32)
        doc, bucket = terms(data, offsets)
        out.reshape(-1)[doc * out.shape[1] + self.column[bucket]] = 1
        return out[:, :-1]

    def margin(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(1) - x @ (self.v * self.v).sum(1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(column: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 250, rate: float = 0.03, decay: float = 2e-4) -> Machine:
    """Logistic loss by Adam on all rows at once; seeded, so the same rows give the same machine."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    p = [np.array([np.log(share / (1 - share))]), np.zeros(d), rng.normal(0, 0.05, (d, FACTORS))]
    p = [a.astype(np.float32) for a in p]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = (weight / weight.sum()).astype(np.float32)
    for t in range(1, rounds + 1):
        f = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * ((f * f).sum(1) - x @ (p[2] * p[2]).sum(1))
        e = weight * (sigmoid(z) - y).astype(np.float32)
        g = [np.array([e.sum()]), x.T @ e + decay * p[1], x.T @ (e[:, None] * f) - p[2] * (x.T @ e)[:, None] + decay * p[2]]
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Machine(column, float(p[0][0]), p[1], p[2])


def train(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> Machine:
    """Learn from a bounded sample of the labelled documents: the first of each label by the hash of the id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("doc_id")
    firsts = [known.filter(F.col("y") == y).orderBy(h, "doc_id").limit(n) for y, n in sorted(sizes.items())]
    chosen = firsts[0].unionByName(firsts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def tally(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        y = part.column(part.schema.get_field_index("y")).to_numpy()
        doc, bucket = terms(data, offsets)
        pair = np.unique(doc << BITS | bucket)
        b, at = np.unique(pair & ((1 << BITS) - 1), return_inverse=True)
        pos = np.bincount(at, y[pair >> BITS], len(b)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(pos), pa.array(np.bincount(at, minlength=len(b)).astype(np.int64) - pos)], ["bucket", "pos", "neg"])

    share = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, n = float(share.get(1, 0)), float(share.get(0, 0))
    column = np.zeros(1 << BITS, np.int32)
    if not p or not n:
        base = p / (p + n) if p + n else 0.0
        return Machine(column, float(np.log(max(base, 1e-9) / max(1 - base, 1e-9))), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    a, b = F.col("pos"), F.col("neg")
    gap = a / F.lit(p) - b / F.lit(n)
    chi = gap * gap / ((a + b) / F.lit(p + n))
    top = rows.mapInArrow(by_step(tally), "bucket bigint, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter((F.col("pos") + F.col("neg")) >= 3).orderBy(chi.desc(), "bucket").limit(INPUTS).select("bucket")
    picked = [r["bucket"] for r in top.collect()]
    column[:] = len(picked)
    column[picked] = np.arange(len(picked))
    shared = Sent(spark, Machine(column, 0.0, np.zeros(len(picked), np.float32), np.zeros((len(picked), FACTORS), np.float32)))

    def encode(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        x = shared.value.inputs(data, offsets).astype(bool)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(part.schema.get_field_index("y")), pa.array([np.packbits(r).tobytes() for r in x], pa.binary())], ["doc_id", "y", "bits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(by_step(encode), f"doc_id {kind}, y int, bits binary").collect(), key=lambda r: (str(r["doc_id"]), r["bits"]))
    shared.drop()
    if not got:
        return Machine(column, float(np.log(p / n)), np.zeros(len(picked), np.float32), np.zeros((len(picked), FACTORS), np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(picked)].astype(np.float32)
    y = np.array([r["y"] for r in got], np.float32)
    weight = np.where(y == 1, total[1] / share[1], total[0] / share[0])
    return fit(column, x, y, weight)


def rate(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns `keep` with score and predicted; docs needs text."""
    small_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, machine)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        m = shared.value
        score = sigmoid(m.margin(m.inputs(data, offsets)).astype(np.float64))
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    picked = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "score double", "predicted int"])
    return picked.mapInArrow(by_step(of, "__text"), schema)


def toxicity(docs: DataFrame, labels: DataFrame, train_fold: Column, keep: list[str]) -> DataFrame:
    """Learn from labels where train_fold holds, and score all of docs."""
    return rate(docs, train(docs, labels.filter(train_fold)), keep)
