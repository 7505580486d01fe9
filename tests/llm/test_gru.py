"""The language model's gradients, its look-up of words, and texts that are scored together."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import grulm, textvec


def vocab() -> tuple[np.ndarray, grulm.Vocab]:
    h, counts = textvec.mix(np.arange(3000, dtype=np.uint64)), np.arange(3000, 0, -1)
    return h, grulm.Vocab(grulm.Ranks(h), counts, int(counts.sum()), 3000, int(counts[grulm.OWN :].sum()), 3000 - grulm.OWN)


def test_words_are_found_among_those_that_share_their_first_bits():
    rng = np.random.default_rng(0)
    # the first bits are equal for many, and for some that are no members
    h = np.unique(np.concatenate([rng.integers(0, 1 << 20, 500).astype(np.uint64), rng.integers(0, 2**64 - 1, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    rng.shuffle(h)
    asked = np.concatenate([h[::-1], rng.integers(0, 1 << 20, 999).astype(np.uint64), h[:9] ^ np.uint64(1), np.array([2**64 - 1, 2**63], np.uint64)])
    place = {x: i for i, x in enumerate(h.tolist())}
    assert grulm.Ranks(h).places(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
    assert grulm.Ranks(h[:0]).places(asked).tolist() == [-1] * len(asked)


@pytest.mark.parametrize("n", [7, 88, 999, 5000])
def test_gradients_of_words_where_lanes_end_early(n):
    """Without weights a word's gradient is its class's count times its share, less its own count: tokens beyond the stream have none."""
    h, v = vocab()
    stream = np.random.default_rng(2).integers(0, 3000, n) // 2
    m = grulm.Gru(v)
    adam, got = grulm.Adam(m), []
    adam.step = lambda rate: got.append((adam.grad["bw"].copy(), adam.grad["bc"].copy()))
    grulm.train(m, h[stream], stream, 0.01, adam)
    lanes = max(1, min(grulm.LANES, n // (grulm.TRUNCATE + 1)))
    width = -(-n // lanes)
    at = np.arange(lanes)[:, None] * width + np.arange(width)
    for k, (bw, bc) in enumerate(got):
        seen = at[:, k * grulm.TRUNCATE : (k + 1) * grulm.TRUNCATE]
        goal = stream[seen[seen < n]]
        count = np.bincount(goal[goal < grulm.OWN], minlength=grulm.OWN).reshape(grulm.CLASSES, grulm.WIDTH)
        p = np.exp(m.p["bw"])
        assert bw == pytest.approx((count.sum(1, keepdims=True) * p - count) / len(goal), abs=1e-6)
        assert bc == pytest.approx(np.exp(m.p["bc"]) - np.append(count.sum(1), (goal >= grulm.OWN).sum()) / len(goal), abs=1e-6)
    assert len(got) == -(-width // grulm.TRUNCATE)


def test_gradients_are_those_of_differences():
    """Of the first window's loss, in all parameters."""
    h, v = vocab()
    stream = np.random.default_rng(3).integers(0, 1500, 64 * 17)
    m, rng = grulm.Gru(v), np.random.default_rng(5)
    for k in m.NAMES:
        m.p[k] = m.p[k] + rng.normal(0, 0.3, m.p[k].shape).astype(np.float32)
    adam, got = grulm.Adam(m), []
    adam.step = lambda rate: got.append({k: adam.grad[k].copy() for k in m.NAMES})
    grulm.train(m, h[stream], stream, 0.01, adam)
    lanes, before = stream.reshape(64, 17)[:, :16], np.append(m.end, stream[:-1]).reshape(64, 17)[:, :16]
    symbol = m.symbols(np.where(before == m.end, grulm.END, h[before]), before)

    def loss() -> float:
        s, total = np.zeros((grulm.HIDDEN, 64), np.float32), 0.0
        for t in range(16):
            s = m.step(np.ascontiguousarray(m.p["x"][symbol[:, t]].T), s)[0]
            total -= m.log_probs(np.ascontiguousarray(s.T), lanes[:, t]).astype(np.float64).sum()
        return total / 1024

    for k in m.NAMES:
        g = got[0][k]
        kept = m.p[k].copy()
        step = np.float32(3e-2) * g / np.abs(g).max()
        m.p[k] += step
        up = loss()
        m.p[k][:] = kept - step
        down = loss()
        m.p[k][:] = kept
        assert up - down == pytest.approx(2 * float((step * g).sum()), rel=0.05)


def test_texts_scored_together_have_the_scores_they_have_alone(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(2)
    rows = {}
    for pool in (1, grulm.POOL):
        monkeypatch.setattr(grulm, "POOL", pool)
        monkeypatch.setattr(grulm, "fit", lambda docs, v: untrained(v))
        rows[pool] = {r["doc_id"]: r for r in grulm.score(docs, F.col("doc_id") % 3 != 0, ["doc_id"]).collect()}
    one, many = rows.values()
    assert one.keys() == many.keys() and len(one) == docs.count()
    for i, r in one.items():
        assert r["score"] == pytest.approx(many[i]["score"], rel=1e-5) and [r[c] for c in r.asDict() if c != "score"] == [many[i][c] for c in r.asDict() if c != "score"]


def untrained(v: grulm.Vocab) -> grulm.Gru:
    m = grulm.Gru(v)
    m.end = int(v.ranks(np.array([grulm.END]))[0])
    return m


def test_long_texts_go_side_by_side():
    """Steps of the model are as many as the longest text is long, not as all long ones together."""
    h, v = vocab()
    m, rng = untrained(v), np.random.default_rng(1)
    ranks = [rng.integers(0, 3000, n) for n in (900, 3, 1, 800, 2, 850)]
    calls, step = [], m.step
    m.step = lambda *a: calls.append(a[0].shape[1]) or step(*a)
    both = m.score(h[np.concatenate(ranks)], np.concatenate(ranks), np.cumsum([0, *map(len, ranks)]))
    assert len(calls) == 900 and sum(calls) == sum(map(len, ranks))
    assert both == pytest.approx([m.score(h[r], r, np.array([0, len(r)]))[0] for r in ranks], rel=1e-5)
