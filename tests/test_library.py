"""Operators of the library on hand-made rows, and invariants of generated tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import casts, digits, hashing, losses, text
from tallyforge.operators import analysis, generation, joins, prototypes, quotas, selection, similarity, statistics
from tallyforge.sources import readers, sinks
from tallyforge.streaming import incremental



@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10, 10 ** rng.randrange(2, 9)), rng.randrange(10, 10 ** rng.randrange(2, 9))) for _ in range(300)] + [(100, 250), (99, 101), (10, 10), (75, 25)]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a bigint, b bigint")


def test_hash_split_is_md5(spark):
    ids = [f"p_{i}" for i in range(300)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", hashing.hash_split(F.col("id"))).collect()}
    share = {i: int(hashlib.md5(f"42:{i}".encode()).hexdigest(), 16) % 10000 / 10000 for i in ids}
    assert all(got[i] == ("train" if s < 0.7 else "val" if s < 0.85 else "test") for i, s in share.items())
    assert hashing.parse_ratios("80/20") == {"train": 0.8, "test": 0.2}
    with pytest.raises(ValueError):
        hashing.hash_split(F.lit("x"), {"train": 0.5})


def test_template_index(spark):
    got = spark.range(1).select(hashing.template_index(42, F.lit(37), F.lit(42), F.lit("OT"), 4)).first()[0]
    assert got == int.from_bytes(hashlib.sha256(b"42|OT|37|42").digest()[:8], "big") % 4


def test_digits(spark, pairs):
    rows = pairs.select("a", "b", digits.complexity(F.col("a"), F.col("b")).alias("c"), digits.carry_pairs(F.col("a"), F.col("b")).alias("carry"), digits.no_carry_product(F.col("a"), F.col("b")).alias("nc"), digits.place_values(F.col("a")).alias("pv"), digits.trailing_zeros(F.col("a")).alias("tz"), digits.nearby_wrong(F.col("a")).alias("w"), digits.error_taxonomy(F.col("a"), F.col("b"), F.col("a") * F.col("b")).alias("k")).collect()
    for r in rows:
        sa, sb = str(r["a"]), str(r["b"])
        assert r["c"] == (len(sa) + len(sb)) * sum(x != "0" for x in sa + sb)
        assert r["carry"] == sum(int(x) * int(y) >= 10 for x in sa for y in sb)
        assert sum(r["pv"]) == r["a"] and r["tz"] == len(sa) - len(sa.rstrip("0")) and r["w"] != r["a"] and r["k"] == "correct"
        cols = [0] * (len(sa) + len(sb) - 1)
        for i, x in enumerate(reversed(sa)):
            for j, y in enumerate(reversed(sb)):
                cols[i + j] += int(x) * int(y)
        assert int(r["nc"]) == int("".join(str(c % 10) for c in reversed(cols)))


@pytest.mark.parametrize(
    "a, b, answer, kind",
    [(12, 12, 1440, "magnitude_slip"), (12, 12, None, "unknown"), (47, 53, 47 * 50, "partial_product_omission"), (47, 53, 40 * 53, "partial_product_omission"), (19, 17, 233, "digit_permutation"), (47, 53, 2492, "near_miss"), (47, 53, 9999, "other"), (47, 53, 2491, "correct"), (99, 99, 8641, "carry_drop")],
)
def test_error_kinds(spark, a, b, answer, kind):
    df = spark.createDataFrame([(a, b, answer)], "a bigint, b bigint, m bigint")
    if kind == "carry_drop":
        answer = int(df.select(digits.no_carry_product(F.col("a"), F.col("b"))).first()[0])
        df = spark.createDataFrame([(a, b, answer)], "a bigint, b bigint, m bigint")
    assert df.select(digits.error_taxonomy(F.col("a"), F.col("b"), F.col("m"))).first()[0] == kind


def test_costs_pick_the_natural_method(spark):
    df = spark.createDataFrame([(99, 101), (400, 37), (87, 69)], "a bigint, b bigint")
    got = [r["canonical_target_heuristic"] for r in generation.scored(df).orderBy("a").collect()]
    assert got[1] == "RC" and got[2] == "DD"


def test_detection_and_mass(spark):
    inf = math.inf
    rows = [(1.0, 2.0, 3.0, 4.0), (3.0, 3.0, 5.0, 1.0), (inf, 2.0, inf, 1.0), (inf, inf, inf, None)]
    df = spark.createDataFrame(rows, "ot double, dd double, rc double, n double")
    ls = {"OT": F.col("ot"), "DD": F.col("dd"), "RC": F.col("rc")}
    got = df.select(losses.detect(ls).alias("d"), losses.support_mass(ls, F.col("n")).alias("m"), losses.detect(ls, True).alias("s")).collect()
    assert [(r["d"]["label"], r["d"]["confidence"]) for r in got] == [("OT", 1.0), ("OT", 0.0), ("DD", 0.5), ("UNKNOWN", 0.0)]
    assert [r["s"]["label"] for r in got] == ["OT", "OT", "UNKNOWN", "UNKNOWN"]
    assert sum(got[0]["m"]) == pytest.approx(1) and got[1]["m"]["NEUTRAL"] == max(got[1]["m"]) and got[2]["m"] is None


def test_answers_from_text(spark):
    cases = [("47 × 53 = 2491", 2491, "equation", 0.7), ("so the answer is **2,491**.", 2491, "contaminated", 0.1), ("for 47, so the answer is **2,491**.", 2491, "final_marker", 0.9), ("\\boxed{2491} for 47", 2491, "boxed", 0.95), ("47 gives 2491 = ", 2491, "fallback", 0.2), ("only 5 and 9", 9, "contaminated", 0.1), ("", None, "none", 0.0), ("it is $2491$ of 47", 2491, "latex", 0.9), ("47... boxed 99999999999", 99999999999, "fallback", 0.4)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, t string").select("i", text.extract_answer(F.col("t"), F.lit(47), F.lit(53)).alias("e")).orderBy("i")
    for r, (t, answer, strategy, conf) in zip(df.collect(), cases):
        got = (None if r["e"]["answer"] is None else int(r["e"]["answer"]), r["e"]["strategy"], round(r["e"]["confidence"], 6))
        assert got == (answer, strategy, conf), t
    assert text.safe_name("10-60") == "TenToSixty" and text.number_words(121) == "OneTwoOne"


def test_traces_say_the_product(spark, pairs):
    for label, f in text.TRACES.items():
        rows = pairs.select("a", "b", f(F.col("a"), F.col("b")).alias("t")).withColumn("c", text.classify(F.col("t"))).collect()
        assert all(r["t"].startswith(f"What is {r['a']} × {r['b']}?\n") and r["t"].endswith(f"Answer: {r['a'] * r['b']}") for r in rows)
        assert {r["c"]["label"] for r in rows} == ({"UNKNOWN"} if label == "STYLE" else {label}), label


def test_casts(spark):
    df = spark.createDataFrame([(" Yes", 1), ("nan", 2), ("inf", 3), ("1e3", 4), (None, 5), ("1_0", 6)], "v string, i int")
    got = df.select(casts.to_bool(F.col("v")).alias("b"), casts.to_finite(F.col("v")).alias("x"), casts.to_label(F.col("v")).alias("l")).collect()
    assert [r["b"] for r in got] == [True, False, False, False, False, False] and [r["x"] for r in got] == [None, None, None, 1000.0, None, None] and got[4]["l"] == "UNKNOWN"


def test_errors_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(5, 1, 50), rng.normal(4, 1, 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    se, m = df.agg(statistics.percent_ratio_se(F.col("x"), F.col("y")), statistics.mean_se(F.col("x"))).first()
    c = np.cov(x, y) / 50
    g = np.array([100 / y.mean(), -100 * x.mean() / y.mean() ** 2])
    assert se == pytest.approx(math.sqrt(g @ c @ g)) and m == pytest.approx(x.std(ddof=1) / math.sqrt(50))
    assert spark.createDataFrame([(1.0, 2.0)], "x double, y double").agg(statistics.percent_ratio_se(F.col("x"), F.col("y")), statistics.mean_se(F.col("x"))).first()[:] == (0.0, 0.0)


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i, "g", float(i % 4 == 0)) for i in range(400)], "i int, g string, v double")
    r = statistics.bootstrap(df, "v", "g", "i", draws=300).first()
    assert r["estimate"] == 0.25 and 0.19 < r["low"] < 0.25 < r["high"] < 0.31


def test_leakage(spark):
    train = spark.createDataFrame([(1, 3, 4), (2, 4, 3), (3, 5, 6), (4, 0, 7)], "id int, a bigint, b bigint")
    test = spark.createDataFrame([(3, 4, "test"), (5, 6, "val"), (0, 7, "test")], "a bigint, b bigint, split string")
    assert {r["id"] for r in joins.without_leaks(train, test).collect()} == {3, 4}
    assert {r["id"] for r in joins.leaks(train, test).collect()} == {1, 2, 3}


def test_bootstrap_query_makes_all_draws(spark):
    from tallyforge.plans import catalog, stat_queries

    sf = "/root/testdata/sf0.001"
    rows = stat_queries.probed(spark, sf).select("id", "design_family", (F.col("detected") == F.col("design_family")).cast("double").alias("hit"))
    key = lambda r: r["design_family"]
    assert sorted(catalog.QUERIES["stat04_bootstrap"](spark, sf).collect(), key=key) == sorted(statistics.bootstrap(rows, "hit", "design_family", draws=1000).collect(), key=key)


def test_numbering_over_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("x"))
    got = selection.numbered(df, ["x"], "n_", 5).orderBy("x").collect()
    assert [r["new_id"] for r in got] == [f"n_{i:05d}" for i in range(5000)]


def test_batches_over_many_ranges(spark, many_ranges):
    df = spark.range(0, 60_000, 1, 16).select(((F.col("id") * 7919) % 60_013).alias("k"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    got = [(r["g"], r["k"], r["batch"]) for r in selection.batches(df, "g", "k", 30).collect()]
    want = {}
    for r in sorted(df.select("g", "k").collect()):
        want.setdefault(r["g"], []).append(r["k"])
    assert sorted(got) == sorted((g, k, i // 30) for g, ks in want.items() for i, k in enumerate(ks))


def test_votes_and_prototypes(spark):
    df = spark.createDataFrame([("OT", 0.8, "RC", 0.9), ("UNKNOWN", 0.0, "DD", 0.4), ("UNKNOWN", 0.0, None, None)], "a string, x double, b string, y double")
    got = [tuple(r["v"]) for r in df.select(prototypes.vote([(F.col("a"), F.col("x")), (F.col("b"), F.col("y"))]).alias("v")).collect()]
    assert got == [("RC", pytest.approx(0.9 / 1.7)), ("DD", pytest.approx(0.4)), ("UNKNOWN", 0.0)]
    vectors = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2)], "xy"[i % 2]) for i in range(6)], "id int, embedding array<float>, label string")
    out = {r["id"]: r for r in prototypes.classify(vectors, prototypes.fit(vectors), "id").collect()}
    assert all(out[i]["predicted"] == "xy"[i % 2] and out[i]["mass"] > 0.9 for i in range(6))


def test_update_inner_is_that_of_the_products(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 3, 5)), rng.normal(size=(2, 4, 3))
    da = spark.createDataFrame([(f"m{m}", r, i, float(a[m, r, i])) for m in range(2) for r in range(3) for i in range(5)], "name string, r int, i int, value double")
    db = spark.createDataFrame([(f"m{m}", o, r, float(b[m, o, r])) for m in range(2) for o in range(4) for r in range(3)], "name string, o int, r int, value double")
    got = {(r["name_1"], r["name_2"]): r["inner"] for r in similarity.update_inner(da, db).collect()}
    assert got["m0", "m1"] == pytest.approx(float(((b[0] @ a[0]) * (b[1] @ a[1])).sum()))


def test_quotas():
    caps = {c: sum(quotas.capacity(*s) for s in st) for c, st in quotas.reachable().items()}
    q = quotas.by_complexity(10_000, caps, 182.0)
    assert sum(q.values()) == 10_000 and min(q.values()) >= 1 and all(q[c] <= caps[c] for c in q)
    assert sum(c * n for c, n in q.items()) / 10_000 == pytest.approx(182, abs=0.05)
    assert all(sum(n for c, n in q.items() if lo <= c <= hi) >= 1000 for lo, hi in digits.BANDS)
    assert quotas.even({"a": 1, "b": 9, "c": 9}, 10) == {"a": 1, "b": 5, "c": 4} and quotas.capacity(2, 2) == 45
    assert quotas.digit_mix("2:0.1,3=0.3") == {2: pytest.approx(0.25), 3: pytest.approx(0.75)}
    assert sum(quotas.length_quotas({2: 3, 3: 50}, 20, {2: 0.5, 3: 0.5}).values()) == 20


def test_grid(spark):
    rows = generation.grid(spark, 1500).collect()
    assert len(rows) == 1500 and len({tuple(sorted((r["a"], r["b"]))) for r in rows}) == 1500 and len({r["id"] for r in rows}) == 1500
    assert np.mean([r["complexity_c"] for r in rows]) == pytest.approx(182, abs=0.5)
    assert {r["split"] for r in rows} == {"train", "val", "test"} and all(r["digit_total"] * r["nonzero_total"] == r["complexity_c"] and r["a"] * r["b"] == r["a_times_b"] for r in rows)


def test_traps_and_training(spark):
    taken = spark.createDataFrame([(99, 99, "test"), (52, 49, "test")], "a bigint, b bigint, split string")
    rows = generation.traps(spark, taken).collect()
    n = {k: sum(r["trap_type"] == k for r in rows) for k in ("carry_bomb", "missing_term", "anti_round", "sign_trap")}
    assert list(n.values()) == [8, 8, 8, 6] and not {(99, 99), (49, 52)} & {(r["a"], r["b"]) for r in rows}
    got = generation.training_traces(spark, "RC", 50).collect()
    assert len(got) == 50 and all(r["full_text"] == r["prompt"] + "\n" + r["reasoning_trace"] and r["split"] != "test" for r in got)


def test_hds_thirds(spark):
    rows = generation.hds(spark, 100, pool=4000).collect()
    assert [sum(r["design_family"] == k for r in rows) for k in ("RC", "DD", "OT")] == [34, 33, 33]
    assert all(r["canonical_target_heuristic"] == r["design_family"] and 12 <= r["complexity_c"] <= 324 and r["canonical_target_margin"] >= 0.75 for r in rows)


def test_generator_queries_are_of_full_size(spark):
    from tallyforge.plans import catalog

    sf = "/root/testdata/sf0.001"
    bands = lambda rows: [sum(lo <= r["complexity_c"] <= hi for r in rows) for lo, hi in digits.BANDS]
    grid, hds = (catalog.QUERIES[k](spark, sf).select("complexity_c").collect() for k in ("gen05_07_grid", "gen11_hds"))
    assert len(grid) == 10_000 and min(bands(grid)) >= 1000
    assert len(hds) == 1000 and min(bands(hds)) >= 100
    traces = catalog.QUERIES["gen13_training_traces"](spark, sf).groupBy("heuristic").count().collect()
    assert {tuple(r) for r in traces} == {(k, 1000) for k in ("RC", "DD", "OT", "STYLE")}


def test_generators_fill_their_quotas_or_raise(spark):
    rows = generation.hds(spark, 90, pool=100).collect()
    assert [sum(r["design_family"] == k for r in rows) for k in ("RC", "DD", "OT")] == [30, 30, 30]
    taken = generation.training_traces(spark, "RC", 50).select("a", "b", F.lit("test").alias("split"))
    assert generation.training_traces(spark, "RC", 50, taken).count() == 50
    every = generation._pool(spark, "RC", 1 << 17, 42).withColumn("split", F.lit("test"))  # all that the largest pool holds
    with pytest.raises(ValueError):
        generation.training_traces(spark, "RC", 50, every)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 'two\nlines "quoted"', "test"), ("b", None, "train")], "id string, note string, split string")
    sinks.write_csv(df, str(tmp_path / "x"), one_file=True, remap={"test": "val"})
    back = {r["id"]: (r["note"], r["split"]) for r in readers.read_csv(spark, str(tmp_path / "x"), "id string, note string, split string").collect()}
    assert back == {"a": ('two\nlines "quoted"', "val"), "b": (None, "train")}
    assert readers.read_csv(spark, str(tmp_path / "none"), missing_ok=True) is None
    (tmp_path / "l.json").write_text('{"x": 1}\n\nbroken\n{"x": Infinity}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "l.json"), "x double").count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "l.json"), "x double", strict=True).collect()
    assert readers.resolve_result(spark, str(tmp_path), ["HDSv2", "HDS"], "f.csv") is None
    np.savez(tmp_path / "m.npz", **{"q.A": np.arange(6.0).reshape(2, 3), "q.B": np.ones((2, 2, 2))})
    np.savez(tmp_path / "n.npz", **{"q.A": np.ones((2, 3)), "q.B": np.ones((2, 2))})
    t = readers.read_tensors(spark, str(tmp_path))
    assert t.filter("name = 'm'").agg(F.sum("value")).first()[0] == 23 and [(r["name"], r["key"]) for r in readers.shape_mismatches(t, "m").collect()] == [("n", "q.B")]
    key = sinks.content_key(df, {"p": 1})
    assert key == sinks.content_key(df.orderBy("id"), {"p": 1}) != sinks.content_key(df, {"p": 2})
    assert sinks.cached(spark, str(tmp_path), key, lambda: df).count() == sinks.cached(spark, str(tmp_path), key, lambda: 1 / 0).count() == 2


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    rows = spark.createDataFrame([("DD", i % 3 == 0, "DD" if i % 2 else "OT") for i in range(60)], "design_family string, is_correct boolean, detected string")
    rows.repartition(5).write.json(str(tmp_path / "in"))
    out = incremental.to_table(incremental.running_rates(incremental.follow(spark, str(tmp_path / "in"), "design_family string, is_correct boolean, detected string", 2)), str(tmp_path / "out"), str(tmp_path / "log"))
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in incremental.running_rates(rows).collect()]


def test_best_epoch(spark):
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.0, 2.5, 2.6, 1.0])], "run string, epoch int, val_loss double")
    got = [(r["best"], r["is_best"], r["stopped"]) for r in analysis.best_epoch(log).orderBy("epoch").collect()]
    assert got == [(3.0, True, False), (2.0, True, False), (2.0, False, False), (2.0, False, False), (1.0, True, True)]


def test_template_audit(spark):
    from tallyforge.functions import templates

    assert templates.audit(templates.bank(spark)).count() == 0
    bad = spark.createDataFrame([("OT", 0, "Column method"), ("OT", 1, "column-method!"), ("DD", 0, "Round the base in many many words that make this one far longer than all of the others")], "label string, nth int, text string")
    assert {(r["kind"], r["label"]) for r in templates.audit(bad).collect()} == {("double", "OT"), ("missing", "DD"), ("leaked", "DD"), ("spread", None)}
