"""Enumerated sets, factors of experts, and files that are committed in two phases."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.operators import enumerated as E
from tallyforge.operators import similarity, statistics
from tallyforge.sources import assets

BASES = D.scaled_bases()


def far(n, distance):
    base = min(BASES, key=lambda b: (abs(n - b), b))
    return n % 5 and abs(n - base) / D._scale(base) > distance


@pytest.mark.parametrize("made,want", [
    (E.of_length(2, 15, 40), list(range(15, 41))), (E.of_length(4, 10, 999), []), (E.last_digit(3, 105, 140, 3), [113, 123, 133]), (E.last_digit(2, 10, 12, 9), []), (E.multiples(2, 10, 99, 25), [25, 50, 75]),
    (E.far_from_bases(3, 10, 999, BASES, 2), [n for n in range(100, 1000) if far(n, 2)]), (E.far_from_bases(2, 10, 99, BASES, 10), [n for n in range(10, 100) if far(n, 10)]), (E.far_from_bases(4, 10, 9999, BASES, 3), [n for n in range(1000, 10000) if far(n, 3)]),
])
def test_members_are_enumerated(spark, made, want):
    assert made.size == len(want) and [made[k] for k in range(made.size)] == want
    got = spark.range(made.size + 2).select(made.member(F.col("id")).alias("m")).collect()
    assert [r["m"] for r in got] == [*want, None, None]


def test_draws_differ(spark):
    m = E.far_from_bases(5, 10, 99_999, BASES, 2)
    got = [r["member"] for r in E.draw(spark, m, 500).collect()]
    assert len(set(got)) == 500 and all(far(n, 2) for n in got) and got != sorted(got)
    assert sorted(r["member"] for r in E.draw(spark, E.last_digit(2, 10, 99, 3), 9).collect()) == list(range(13, 100, 10))
    with pytest.raises(ValueError, match="10 of 9"):
        E.draw(spark, E.last_digit(2, 10, 99, 3), 10)


def test_all_pairs_near_a_base(spark):
    got = [(r["base"], r["a"], r["b"]) for r in E.near_base_pairs(spark, [25, 1000], 3).collect()]
    want = []
    for base in (25, 1000):
        values = sorted({base + s * x for x in D.near_offsets(base, 3) for s in (1, -1) if base + s * x >= 10})
        want += [(base, x, y) for y in values for x in values if x <= y]
    assert sorted(got) == sorted(want)
    pool = spark.createDataFrame([(30, 20), (20, 30), (25, 25), (7, 9)], "a bigint, b bigint")
    known = spark.createDataFrame([(9, 7)], "a bigint, b bigint")
    assert sorted(tuple(sorted(r)) for r in E.fresh(pool, known).collect()) == [(20, 30), (25, 25)]


def test_updates_of_experts(spark):
    rng = np.random.default_rng(2)
    shapes = {"x": (1, 1), "y": (3, 1), "z": (3, 3), "w": (1, 3)}
    a = {n: rng.normal(size=(e, 2, 5)) for n, (e, _) in shapes.items()}
    b = {n: rng.normal(size=(e, 4, 2)) for n, (_, e) in shapes.items()}
    rows = lambda m, cols: spark.createDataFrame([(n, e, i, j, float(v)) for n, x in m.items() for (e, i, j), v in np.ndenumerate(x)], f"name string, expert int, {cols}, value double")
    got = {(r["name_1"], r["name_2"]): r["inner"] for r in similarity.update_inner_of_experts(rows(a, "r int, i int"), rows(b, "o int, r int")).collect()}
    for m in shapes:
        for n in shapes:
            if m <= n:
                g, h = np.einsum("eor,eos->ers", b[m], b[n]), np.einsum("eri,esi->ers", a[m], a[n])
                assert got[m, n] == pytest.approx(float(np.sum(g * h)))
    with pytest.raises(ValueError, match="2, 3"):
        similarity.update_inner_of_experts(rows({"x": np.ones((2, 1, 1)), "y": np.ones((3, 1, 1))}, "r int, i int"), rows({"x": np.ones((1, 1, 1)), "y": np.ones((1, 1, 1))}, "o int, r int"))


def test_bootstrap_resamples_keys(spark):
    rows = [(i, "g", float(i % 4 == 0)) for i in range(400)] + [(900, "g", None), (901, "g", float("nan")), (1, None, 1.0), (2, None, 0.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r["g"]: r for r in statistics.bootstrap(df.repartition(5), "v", "g", draws=300).collect()}
    assert got["g"]["estimate"] == 0.25 and 0.19 < got["g"]["low"] < 0.25 < got["g"]["high"] < 0.31 and got[None]["estimate"] == 0.5
    again = {r["g"]: r for r in statistics.bootstrap(df.coalesce(1), "v", "g", draws=300).collect()}
    assert all(math.isclose(again[k][c], got[k][c], rel_tol=1e-12) for k in got for c in ("low", "high", "estimate"))
    f = np.array(statistics.draw_factors(2000, 42))
    w = np.searchsorted([int(p * statistics.PRIME) for p in statistics.POISSON], (123456789 * f[:, 0] + f[:, 1]) % statistics.PRIME, "right")
    assert abs(w.mean() - 1) < 0.1 and abs(w.var() - 1) < 0.15  # as of Poisson numbers of mean 1
    assert statistics.bootstrap(df.limit(0), "v", "g").collect() == []


def test_assets_of_rows(spark, tmp_path):
    at = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.svg", i, i + 1) for i in range(40)], "file string, a int, b int").repartition(5)
    assets.write_assets(rows, at, assets.svg, "file", ["a", "b"])
    got = {r["name"]: bytes(r["content"]) for r in assets.read_assets(spark, at).collect()}
    assert len(got) == 40 and "7 × 8".encode() in got["d1/7.svg"] and not (Path(at) / "_temporary" / "x").exists()
    assets.write_assets(rows.filter("a < 0"), at, assets.svg, "file", ["a", "b"])
    assert len(assets.read_assets(spark, at).collect()) == 40


def test_reading_assets_plans_folders_not_files(spark, tmp_path):
    at = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.{'svg' if i % 4 else 'txt'}", i, i + 1) for i in range(400)], "file string, a int, b int").repartition(5)
    assets.write_assets(rows, at, assets.svg, "file", ["a", "b"])
    (tmp_path / "files" / "_temporary" / "job" / "part-00000-9").mkdir(parents=True)
    (tmp_path / "files" / "_temporary" / "job" / "part-00000-9" / "x.svg").write_text("not committed")
    got = assets.read_assets(spark, at, "*.svg")
    assert got.inputFiles() == [] and got.rdd.getNumPartitions() == 5
    assert sorted(r["name"] for r in got.collect()) == sorted(f"d{i % 3}/{i}.svg" for i in range(400) if i % 4)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    at = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"{i}.txt", i) for i in range(40)], "file string, a int").repartition(4)

    def render(row):
        if row.a == 33:
            raise ValueError("can't be drawn")
        return b"x"

    with pytest.raises(Exception, match="can't be drawn"):
        assets.write_assets(rows, at, render, "file", ["a"])
    assert not [p for p in Path(at).rglob("*") if p.is_file()] if Path(at).exists() else True
    with pytest.raises(Exception, match="not a file name"):
        assets.write_assets(rows.limit(1).withColumn("file", F.lit("../out")), at, lambda r: b"x", "file", ["a"])


def test_only_committed_attempts_count(tmp_path):
    """Two attempts of one task: the one whose message comes to the commit stays, the other's files go."""
    w = assets.AssetsWriter(str(tmp_path), False)
    for folder in ("part-00000-1", "part-00000-2", "part-00001-3"):
        (tmp_path / "_temporary" / w.job / folder).mkdir(parents=True)
        (tmp_path / "_temporary" / w.job / folder / "a.txt").write_text(folder)
    w.commit([assets.Done("part-00000-2", 1, 3), assets.Done(None, 0, 0), None, assets.Done("part-00001-3", 1, 3)])
    left = sorted(p for p in tmp_path.rglob("*.txt"))
    assert [p.read_text() for p in left] == ["part-00000-2", "part-00001-3"]
    again = assets.AssetsWriter(str(tmp_path), True)
    (tmp_path / "_temporary" / again.job / "part-00000-9").mkdir(parents=True)
    (tmp_path / "_temporary" / again.job / "part-00000-9" / "b.txt").write_text("new")
    again.commit([assets.Done("part-00000-9", 1, 3)])
    assert [p.name for p in tmp_path.rglob("*.txt")] == ["b.txt"]
