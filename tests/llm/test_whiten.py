"""Whitening against numpy's covariance, and exact deviations."""

import math

import numpy as np
import pytest

from tallyforge.llm import whiten


def plain(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(0)
    c = x - s / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)
    e, v = e[order], v[:, order]
    keep = e > 1e-12 * e[0]
    return ((n * x.astype(object) - s) ** 2).sum(1), e[keep] / np.trace(cov), (c @ v[:, keep]) / np.sqrt(e[keep])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id bigint, embedding array<float>, key string, component int").repartition(6)


@pytest.mark.parametrize("n,d", [(40, 5), (300, 50), (8, 12)])
def test_whitening_is_as_defined(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3).astype(np.float32).tolist()
    bad = [(900, None), (901, [None] * d), (902, [1.0] * (d - 1) + [float("nan")]), (903, [float("inf")] + [0.0] * (d - 1)), (904, []), (905, [1.0] * (d + 1))]
    got = whiten.whiten(table(spark, [*enumerate(vectors), *bad])).collect()
    deviation, explained, white = plain(vectors)
    k = min(32, len(explained))
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    w = np.zeros((n, k))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-6)
        assert r["identity_error"] < 1e-6
    sign = np.sign((w * white[:, :k]).sum(0))
    assert np.abs(w * sign - white[:, :k]).max() < 1e-5
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-6


def test_whitening_of_few_and_of_equal_rows(spark):
    assert whiten.whiten(table(spark, [])).collect() == []
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    got = whiten.whiten(table(spark, [(None, [1.0, 2.0]), (7, [3.0, 2.0]), (7, [3.0, 2.0])])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in got) == [("7", 1, 128**2), ("7", 1, 128**2), ("None", 1, 256**2)]
    assert {r["explained"] for r in got} == {1.0}


def test_far_entries_keep_their_place(spark):
    got = whiten.whiten(table(spark, [(i, [3e38 if i == 0 else float(i), float(i % 3)]) for i in range(20)])).collect()
    assert len(got) >= 20 and all(r["deviation"] is None for r in got)
    m = np.array([[1 << 40, 3], [5, -(1 << 41)]], np.int64)
    assert whiten.deviations(m, 10, np.array([7, 9], object)) == [(10 * (1 << 40) - 7) ** 2 + 21**2, 43**2 + (10 * (1 << 41) + 9) ** 2]
