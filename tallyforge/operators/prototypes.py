"""Prototype vectors of labels, and classification by them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.losses import dot
from tallyforge.functions.text import classify as text_class

TEMPERATURE = 0.1


class Embedder(Protocol):
    """Anything that makes vectors of texts, all of one length; it's sent to the executors."""

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class Letters:
    """The shares of some letters at length 1: an embedder that needs no model."""

    def __init__(self, letters: str = "aeiourst") -> None:
        self.letters = letters

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        counts = [[float(t.count(c)) for c in self.letters] for t in texts]
        norms = [sum(x * x for x in v) ** 0.5 or 1.0 for v in counts]
        return [[x / n for x in v] for v, n in zip(counts, norms, strict=True)]


def embed(df: DataFrame, embedder: Embedder, text: str = "text", vector: str = "embedding") -> DataFrame:
    """df with the vectors of its texts, in Arrow batches; of a null or blank text null."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.notna() & (texts.fillna("").str.strip() != "")
            out = [None] * len(texts)
            if there.any():
                made = embedder.embed_texts(texts[there].tolist())
                for i, v in zip(there.to_numpy().nonzero()[0].tolist(), made, strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn(vector, vectors(F.col(text)))


def fit(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, centroid: the mean vector at length 1, as it is if it's zero. One partial aggregate by place, label and dimension."""
    cells = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return mean.select(label, F.when(norm > 0, F.transform("mean", lambda x: x / norm)).otherwise(F.col("mean")).alias("centroid"))


def classify(vectors: DataFrame, centroids: DataFrame, key: str, label: str = "label", vector: str = "embedding", temperature: float = TEMPERATURE) -> DataFrame:
    """key, predicted, mass, margin; without a vector UNKNOWN, 0 and 0. The centroids become one array column, a row each (of which there is one a label), so vectors don't move."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("table"))
    rows = vectors.select(key, F.col(vector).alias("v")).join(F.broadcast(table))  # one row, an array of an entry a label
    sims = F.transform("table", lambda t: F.struct((dot(F.col("v"), t["centroid"]) / temperature).alias("s"), t["label"].alias("label")))
    rows = rows.select(key, "v", sims.alias("sims")).withColumn("top", F.array_max(F.transform("sims", lambda r: r["s"])))
    rows = rows.withColumn("w", F.transform("sims", lambda r: F.struct(F.exp(r["s"] - F.col("top")).alias("w"), r["label"].alias("label"))))
    rows = rows.withColumn("total", F.aggregate("w", F.lit(0.0), lambda s, r: s + r["w"]))
    order = F.array_sort(F.transform("w", lambda r: F.struct((-r["w"] / F.col("total")).alias("m"), r["label"].alias("label"))))
    rows = rows.withColumn("order", order)
    first, second = F.get("order", F.lit(0)), F.get("order", F.lit(1))
    there = F.col("v").isNotNull()
    told = {"predicted": (first["label"], F.lit("UNKNOWN")), "mass": (-first["m"], F.lit(0.0)), "margin": (F.coalesce(second["m"] - first["m"], -first["m"]), F.lit(0.0))}
    return rows.select(key, *(F.when(there, x).otherwise(y).alias(c) for c, (x, y) in told.items()))


def trace_signals(rows: DataFrame, embedder: Embedder | None = None, centroids: DataFrame | None = None, key: str = "id", trace: str = "trace", contaminated: str = "contaminated") -> DataFrame:
    """key with both signals of a trace: trace_label and trace_confidence of its wording (null if it tells nothing), and embedding_label, _confidence,
    _margin of its vector, with `resolved` and `status`: trace_missing for null and blank traces, contaminated_trace for those that quote other
    factors, else ok. Only traces that are ok are embedded. Without an embedder the second signal and its status are null."""
    rows = rows.select(key, trace, contaminated, text_class(F.col(trace)).alias("found_"))  # read four times, worked out once
    found = F.col("found_")
    known = found["label"] != "UNKNOWN"
    missing = F.coalesce(F.trim(trace) == "", F.lit(True))
    status = F.when(missing, "trace_missing").when(F.col(contaminated), "contaminated_trace").otherwise("ok")
    told = rows.select(key, F.col(trace).alias("trace_"), F.when(~missing & known, found["label"]).alias("trace_label"), F.when(~missing & known, found["confidence"]).alias("trace_confidence"), status.alias("status"))
    if embedder is None or centroids is None:
        none = {f"embedding_{c}": F.lit(None).cast(t) for c, t in (("label", "string"), ("confidence", "double"), ("margin", "double"))}
        return told.drop("trace_").withColumns({**none, "resolved": F.lit(None).cast("boolean"), "status": F.lit(None).cast("string")})
    vectors = embed(told.withColumn("trace_", F.when(F.col("status") == "ok", F.col("trace_"))), embedder, "trace_", "embedding_")
    kept = F.struct(key, "trace_label", "trace_confidence", "status")
    out = classify(vectors.withColumn("row_", kept), centroids, "row_", vector="embedding_")
    ok = F.col("row_.status") == "ok"
    return out.select("row_.*", ok.alias("resolved"), *(F.when(ok, F.col(c)).alias(f"embedding_{n}") for n, c in (("label", "predicted"), ("confidence", "mass"), ("margin", "margin"))))


def vote(signals: list[tuple[Column, Column]], order=("OT", "DD", "RC", "STYLE")) -> Column:
    """(label, confidence) of signals (label, confidence): confidences add up by label; UNKNOWN signals don't count; ties by order."""
    on = [(F.coalesce(k, F.lit("UNKNOWN")), F.coalesce(c, F.lit(0.0))) for k, c in signals]
    votes = {name: sum((F.when(k == name, c).otherwise(0.0) for k, c in on), F.lit(0.0)) for name in order}
    total = sum((F.when(k != "UNKNOWN", c).otherwise(0.0) for k, c in on), F.lit(0.0))
    best = F.greatest(*votes.values())
    label = F.when(total == 0, "UNKNOWN")
    for name, v in votes.items():
        label = label.when(v == best, name)
    return F.struct(label.alias("label"), F.when(total == 0, 0.0).otherwise(best / F.greatest(total, F.lit(1.0))).alias("confidence"))
