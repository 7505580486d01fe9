"""Language identification by string kernels.

A text is the set of its byte n-grams (n = 1 to 3, lower-cased, anything but letters as a blank). The kernel of
two texts is the cosine of their presence vectors over all lengths at once (blended spectrum). Landmarks, drawn
from the labelled sample, give Nyström features; a ridge regression on them for each language against the rest
gives the scores. Scoring a batch is two matrix products: presence x landmarks, then kernel values x weights.

Edge cases: a null text or one without a letter is `und` with score 0; without any labelled row every text is
`und`; ties go to the language that sorts first; repeated rows give repeated results; an empty table gives an
empty one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import Sent, by_step, small_batches

#: Labelled documents to learn from: of each language, and of all together at most. Documents of these many characters first.
PER_LANG, MOST, LIKED = 300, 6000, (64, 8192)
#: Languages (the commonest labels), and UTF-8 bytes of the whole sample, but for one document a language that may be longer.
MOST_LANGS, MOST_BYTES = 1000, 64 << 20
LANDMARKS, RIDGE = 128, 0.05
UND = "und"
#: Texts whose presence rows are held at once.
TEXTS = 512


def _codes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if 97 <= b | 32 <= 122 and b < 128:
            out[b] = (b | 32) - 96
        elif b >= 128:
            out[b] = 27 + (b - 128) % 37
    return out


CODE = _codes()


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(text, n-gram) of every position, for n = 1, 2, 3; numbers of different lengths differ."""
    c = CODE[data].astype(np.int32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    yield doc, c
    gram = c
    for n in (2, 3):
        if len(c) < n:
            return
        gram = (gram[:-1] << 6) | c[n - 1 :]
        same = doc[: len(gram)] == doc[n - 1 :]
        yield doc[: len(gram)][same], gram[same] + (64 if n == 2 else 64 + 4096)


ALL_GRAMS = 64 + 4096 + 262144


@dataclass
class Model:
    langs: list[str]
    column: np.ndarray  # of each n-gram, or the number of columns
    marks: np.ndarray  # columns x landmarks, each landmark of length 1
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, v = len(offsets) - 1, len(self.marks)
        out = np.zeros((n, v + 1), np.float32)
        flat = out.reshape(-1)
        for doc, gram in _grams(data, offsets):
            flat[doc * (v + 1) + self.column[gram]] = 1
        out = out[:, :v]
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x landmarks, TEXTS at a time: short texts are many, and each has a row of all columns."""
        parts = [(i, min(i + TEXTS, len(offsets) - 1)) for i in range(0, len(offsets) - 1, TEXTS)]
        return np.concatenate([np.zeros((0, self.marks.shape[1]), np.float32), *(self.presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) @ self.marks for i, j in parts)])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(data, offsets) @ self.weights + self.bias


def _pieces(texts: list[bytes]) -> list[bytes]:
    """Parts of the sample's texts, so that the model also knows short ones."""
    out = []
    for i, t in enumerate(texts):
        for size in (24, 48, 120):
            at = (i * 131) % max(1, len(t) - size)
            out.append(t[at : at + size])
    return out


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """sample: (language, text). Deterministic for a list of the same order."""
    sample = [(a, t.encode("utf-8", "replace")) for a, t in sample if t]
    langs = sorted({a for a, _ in sample})
    if not langs:
        return None
    whole = [t for _, t in sample]
    texts = whole + _pieces(whole)
    label = np.array([langs.index(a) for a, _ in sample])
    label = np.concatenate([label, np.repeat(label, 3)])
    each = max(2, LANDMARKS // len(langs))
    marks = [i for k in range(len(langs)) for i in np.flatnonzero(label[: len(whole)] == k)[:each]]

    def packed(chosen: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(chosen), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in chosen])])

    seen = np.zeros(ALL_GRAMS, bool)
    for _, gram in _grams(*packed([whole[i] for i in marks])):
        seen[gram] = True
    v = int(seen.sum())
    column = np.full(ALL_GRAMS, v, np.int32)
    column[seen] = np.arange(v)
    model = Model(langs, column, np.zeros((v, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    model.marks = model.presence(*packed([whole[i] for i in marks])).T.copy()
    kernel = (model.marks.T @ model.marks).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # Nyström features are kernel values times this
    data, offsets = packed(texts)
    feats = model.kernel(data, offsets) @ root
    goal = np.where(label[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weigh = (1 / np.bincount(label, minlength=len(langs)))[label][:, None]
    weigh /= weigh.mean()
    mean, aim = (weigh * feats).sum(0) / weigh.sum(), (weigh * goal).sum(0) / weigh.sum()
    x = feats - mean
    ridge = np.linalg.solve(x.T @ (weigh * x) + RIDGE * np.eye(x.shape[1]), x.T @ (weigh * (goal - aim)))
    model.weights = (root @ ridge).astype(np.float32)
    model.bias = (aim - mean @ ridge).astype(np.float32)
    return model


def sample(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST, most_bytes: int = MOST_BYTES) -> list[tuple[str, str]]:
    """A bounded sample of labelled documents, the same on each run: by the hash of id and text, documents of a liked length first.

    Documents are ranked by a hash and their length first, then whole texts of those chosen are fetched. Repeated rows count once.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    count = {r["lang"]: r["n"] for r in common}
    each = max(1, min(per_lang, most // max(1, len(count))))
    # of a language with many rows a share by the hash is enough, so that what is ranked stays bounded
    share = F.coalesce(*(F.when(F.col("lang") == a, F.lit(8.0 * each / n)) for a, n in sorted(count.items()) if n > 8 * each), F.lit(2.0))
    some = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    if len(count) == MOST_LANGS:
        some = some.filter(F.col("lang").isin(sorted(count)))
    told = some.groupBy("lang", "h").agg(F.max(F.length("text").between(*LIKED)).alias("liked"), F.max(F.octet_length("text")).alias("bytes"))
    first = Window.partitionBy("lang").orderBy(F.desc("liked"), "h")
    told = told.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each)
    before = F.sum("bytes").over(first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    chosen = told.withColumn("before", before).filter((F.col("rank") == 1) | (F.col("before") + F.col("bytes") <= most_bytes // max(1, len(count)))).select("lang", "h")
    got = some.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["h"], r["lang"]))]


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only those without an ASCII one are decoded."""
    ascii_letter = (CODE[data] > 0) & (data < 128)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score; docs needs text."""
    small_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, model)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        n, m = rows.num_rows, shared.value
        pred, score = np.full(n, UND, object), np.zeros(n)
        if m is not None:
            f = m.scores(data, offsets)
            best = f.argmax(1)
            known = _letters(data, offsets)
            pred[known] = np.array(m.langs, object)[best[known]]
            score[known] = np.clip((f[np.arange(n), best][known] + 1) / 2, 0, 1)
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    picked = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "lang_pred string", "score double"])
    return picked.mapInArrow(by_step(of, "__text", 1 << 20), schema)


def identify(docs: DataFrame, train: Column, keep: list[str]) -> DataFrame:
    """Learn from the rows of docs where train holds, and predict for all."""
    return predict(docs, fit(sample(docs.filter(train))), keep)


def known_only(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs whose text is in some language with a score of `least` or more; columns as they are."""
    small_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, model)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        if shared.value is not None:
            good = _letters(data, offsets) & ((shared.value.scores(data, offsets).max(1) + 1) / 2 >= least)
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(by_step(of, "text", 1 << 20), docs.schema)
