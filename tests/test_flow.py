"""Streams that are taken up again, reports of progress, job graphs, clients, checked tables."""

import math
import os
import random
import sys
import threading
import time
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyforge.operators import graphs, joins, progress, quotas, scoring, selection
from tallyforge.sources import sinks
from tallyforge.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # clients go to the workers with their code

EVENT = "id bigint, ts timestamp, v string"


def deliver(spark, inbox, rows):
    spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=i), f"v{i}") for i in rows], EVENT).coalesce(1).write.mode("append").parquet(inbox)
    time.sleep(0.05)


def once(spark, at, late="3 hours"):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    incremental.append_once(stream, f"{at}/out", f"{at}/log", ["id"], "ts" if late else None, late).awaitTermination()
    return sorted(r["id"] for r in incremental.appended(spark, f"{at}/out").collect())


@pytest.mark.parametrize("late", ["3 hours", None])
def test_rows_are_appended_once_across_restarts(spark, tmp_path, late):
    at = str(tmp_path)
    deliver(spark, f"{at}/in", range(50))
    deliver(spark, f"{at}/in", [*range(30, 90), 40, 40])
    assert once(spark, at, late) == list(range(90))
    assert once(spark, at, late) == list(range(90))  # nothing new
    deliver(spark, f"{at}/in", range(50))  # a delivery again
    deliver(spark, f"{at}/in", range(80, 200))
    assert once(spark, at, late) == list(range(200))


def test_a_batch_that_broke_off_is_run_again_without_doubles(spark, tmp_path):
    at = str(tmp_path)
    for k in range(3):
        deliver(spark, f"{at}/in", range(k * 20, k * 20 + 30))
    want = once(spark, at)
    assert want == list(range(70))
    commits = sorted((p for p in Path(f"{at}/log/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the driver had died before it wrote this
        p.unlink(missing_ok=True)
    Path(f"{at}/out/part-torn.snappy.parquet").write_bytes(b"what a task that died has left")
    deliver(spark, f"{at}/in", range(60, 100))
    assert once(spark, at) == list(range(100))


def test_batches_that_are_run_again_overwrite_their_own(spark, tmp_path):
    at, seen = str(tmp_path), []
    for k in range(3):
        deliver(spark, f"{at}/in", range(k * 10, k * 10 + 10))
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def failing(df, n):
        df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        seen.append(n)
        if n == 1 and seen.count(1) == 1:
            raise RuntimeError("after the write, before the commit")

    with pytest.raises(Exception, match="before the commit"):
        incremental.into(stream(), failing, f"{at}/log", "append").awaitTermination()
    incremental.append_batches(stream(), f"{at}/out", f"{at}/log").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{at}/out").collect()) == list(range(30)) and seen == [0, 1]


def heartbeat(times, items, seconds):
    out, count, last = [], 0, times[0]
    for i, x in enumerate(times, 1):
        if i - count >= items or x - last >= seconds or i == len(times):
            out.append(i)
            count, last = i, x
    return out


@pytest.mark.parametrize("chunk", [10, 16, 4096])
def test_progress_is_reported_as_item_by_item(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 9), ("c", 10), ("d", 11), (None, 40), ("hot", 1500), ("slow", 60), ("same", 100)):
        at, times = 0, []  # milliseconds
        for _ in range(n):
            at += {"hot": rng.choice([100, 3000, 9000, 30_000]), "slow": 61_000, "same": 0}.get(key, rng.choice([0, 5000, 20_000, 59_000, 60_000]))
            times.append(at)
        rows += [(key, datetime(2024, 1, 1) + timedelta(milliseconds=x), i, "x") for i, x in enumerate(times)]
        want[key] = heartbeat(times, 10, 60_000)
    rows.append(("a", None, 7, "no time"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at timestamp, nth bigint, times string")
    got = {}
    for r in progress.progress(df, ["key"], "at", "nth", chunk=chunk).collect():
        got.setdefault(r["key"], []).append(r["completed"])
        assert r["total"] == (1 if r["key"] == "a" else sum(x[0] == r["key"] for x in rows))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert progress.progress(df.limit(0), ["key"], "at", "nth").collect() == []


def graph(spark, jobs, deps):
    return spark.createDataFrame([(j, "data", 1) for j in jobs], "job string, phase string, units int"), spark.createDataFrame(deps, "job string, dep string")


def test_levels_and_cycles(spark):
    jobs, deps = graph(spark, "abcdef", [("b", "a"), ("c", "b"), ("c", "a"), ("e", "d"), ("e", "d")])
    assert {r["job"]: r["level"] for r in graphs.checked_levels(jobs, deps).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1, "f": 0}
    jobs, deps = graph(spark, "abcde", [("b", "a"), ("c", "d"), ("d", "c"), ("e", "d")])
    assert {r["job"]: r["level"] for r in graphs.levels(jobs, deps).collect()} == {"a": 0, "b": 1, "c": None, "d": None, "e": None}
    with pytest.raises(ValueError, match="'c', 'd', 'e'"):
        graphs.checked_levels(jobs, deps)
    jobs, deps = graph(spark, "a", [("a", "a")])
    assert graphs.levels(jobs, deps).first()["level"] is None
    assert graphs.levels(jobs.limit(0), deps.limit(0)).collect() == []


def test_faults_of_a_catalog(spark):
    jobs = spark.createDataFrame([("a", "data", 1), ("a", "data", 2), ("b", "elsewhere", 1), ("c", None, 0), ("d", "data", None)], "job string, phase string, units int")
    deps = spark.createDataFrame([("b", "a"), ("d", "nobody"), ("d", None)], "job string, dep string")
    got = {tuple(r) for r in graphs.faults(jobs, deps, ["data"]).collect()}
    assert got == {("a", "duplicate id", "2"), ("b", "unknown phase", "elsewhere"), ("c", "unknown phase", None), ("c", "no units", "0"), ("d", "no units", None), ("d", "unknown dependency", "nobody"), ("d", "unknown dependency", None)}
    chosen, inner, before = graphs.selection(jobs.dropDuplicates(["job"]), spark.createDataFrame([("b", "a"), ("a", "c")], "job string, dep string"), F.col("phase") == "data")
    assert {r[0] for r in chosen.collect()} == {"a", "d"} and inner.collect() == [] and [r[0] for r in before.collect()] == ["c"]


class Slow:
    """Slower for earlier prompts, and aware of how many calls are under way."""

    now = most = 0
    lock = threading.Lock()

    def loss(self, prompt):
        with Slow.lock:
            Slow.now += 1
            Slow.most = max(Slow.most, Slow.now)
        time.sleep(0.02 if int(prompt) % 3 == 0 else 0.001)
        with Slow.lock:
            Slow.now -= 1
        if prompt == "13":
            raise OSError("no answer")
        return float(prompt)


class Plain:
    def loss(self, prompt):
        if prompt == "13":
            raise OSError("no answer")
        return float(prompt)


def test_calls_are_bounded_and_in_order():
    taken = []

    def units():
        for i in range(40):
            taken.append(i)
            yield i, [str(i)]

    Slow.most, got = 0, []
    for i, x in scoring.in_order(units(), Slow(), "batch", 3):
        assert len(taken) <= i + 1 + 3  # none is asked for before there is room for it
        got.append((i, x))
    assert got == [(i, [float(i)] if i != 13 else None) for i in range(40)] and 1 < Slow.most <= 3


class Odd:
    """Made once a task; fails where a prompt says so, gives too few losses or no numbers."""

    def losses(self, prompts, tier):
        if any(tier in p for p in prompts):
            raise ValueError(tier)
        if any("few" in p for p in prompts):
            return [1.0]
        return [float("nan") if "nan" in p else len(p) for p in prompts]


def test_scores_of_prompts(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else str(i)) for i in range(20)], "id int, prompt string").coalesce(1)
    made = scoring.score(rows, Plain, batch=4).collect()
    assert [r["id"] for r in made] == list(range(20))
    assert [r["loss"] for r in made] == [math.inf if i in (5, 13) else float(i) for i in range(20)]
    assert [r["loss"] for r in scoring.score(rows, None).collect()] == [math.inf if i == 5 else pytest.approx(0.1 * len(str(i))) for i in range(20)]


def test_only_failed_units_come_to_the_next_tier(spark):
    rows = [("u1", "ok one"), ("u1", "fine"), ("u2", "batch breaks"), ("u2", "not this"), ("u3", "batch and single break"), ("u4", "few losses"), ("u4", "here"), ("u5", "nan"), (None, "null unit"), ("u6", "same"), ("u6", "same")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "unit string, prompt string, other double")
    got = scoring.cascade(df, Odd, [("batch", ["unit"]), ("single", ["unit", "prompt"])])
    found = Counter((r["prompt"], r["tier"], r["loss"]) for r in got.collect())
    assert found == Counter([("ok one", "batch", 6.0), ("fine", "batch", 4.0), ("batch breaks", "single", 12.0), ("not this", "single", 8.0), ("batch and single break", None, math.inf), ("few losses", "single", 1.0), ("here", "single", 4.0), ("nan", None, math.inf), ("null unit", "batch", 9.0), ("same", "batch", 4.0), ("same", "batch", 4.0)])
    means = {r["unit"]: (r["n_finite"], r["loss"]) for r in scoring.mean_finite(got, ["unit"]).collect()}
    assert means["u2"] == (2, 10.0) and means["u3"] == (0, math.inf)
    assert scoring.cascade(df.limit(0), Odd, [("batch", ["unit"])]).collect() == []


def test_units_may_span_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        df = spark.createDataFrame([(i // 7, f"p{i}") for i in range(60)], "unit int, prompt string")
        assert Counter(r["loss"] for r in scoring.pass_over(df, Odd, "batch", ["unit"]).collect()) == Counter(float(len(f"p{i}")) for i in range(60))
    finally:
        spark.conf.set(key, before)


def test_checked_tables_are_used_again_or_made_anew(spark, tmp_path):
    root, made = str(tmp_path / "tables"), []
    table = lambda rows: spark.createDataFrame(rows, "complexity_c int, split string, band string")

    def maker(rows):
        def make():
            made.append(len(rows))
            return table(rows)

        return make

    small, large = [(20, "train", "10-60"), (20, "test", "10-60"), (70, "train", "61-120")], [(20, "train", "10-60")] * 3
    fits = lambda quotas, **k: lambda df: sinks.matches(df, quotas, **k)
    old, v = sinks.checked(spark, root, maker(small), fits({20: 2, 70: 1, 80: 0}))
    assert v == 1 and sinks.checked(spark, root, maker(small), fits({20: 2, 70: 1}))[1] == 1 and made == [3]
    assert not sinks.matches(old, {20: 2, 70: 1}, ("train", "test"), ("61-120",)) and sinks.matches(old, {20: 2, 70: 1}, ("train",), ("10-60", "61-120"))
    assert not sinks.matches(old.drop("band"), {20: 2, 70: 1})
    new, v = sinks.checked(spark, root, maker(large), fits({20: 3}))
    assert v == 2 and new.count() == 3 and old.count() == 3 and {r[0] for r in old.collect()} == {20, 70}  # who reads the old one goes on
    assert sinks.checked(spark, root, maker(large), fits({20: 3}), force=True)[1] == 3
    os.makedirs(f"{root}/v000009")  # one that is still written, or broke off
    assert sinks.versions(spark, root) == [1, 2, 3]
    os.makedirs(f"{root}/v000004")  # somebody else's: the next number is taken
    assert sinks.checked(spark, root, maker(small), fits({20: 2, 70: 1}))[1] == 5
    with pytest.raises(ValueError, match="doesn't fit"):
        sinks.checked(spark, root, maker(small), fits({1: 1}))


def test_nested_reports(spark):
    rows = spark.createDataFrame([("x", "DD", "a", "b"), ("x", "DD", "a", "b"), ("x", "OT", "b", None), ("y", None, "a", "a")], "lora string, target string, before string, after string")
    told = sinks.analysis(rows, "lora", {"step": ("before", "after"), "same": ("after", "after")}, "target")
    got = {r["lora"]: r["analysis"] for r in told.collect()}
    assert got["x"]["all"] == {"same": {"b->b": 2, "null->null": 1}, "step": {"a->b": 2, "b->null": 1}}
    assert got["x"]["OT"]["step"] == {"b->null": 1} and got["y"]["null"]["step"] == {"a->a": 1}
    text = told.filter("lora = 'x'").select(F.to_json("analysis")).first()[0]
    keys = [text.index(f'"{k}":') for k in ("DD", "OT", "all")]
    assert keys == sorted(keys) and text.index('"same":') < text.index('"step":')
    assert sinks.analysis(rows.limit(0), "lora", {"step": ("before", "after")}, "target").collect() == []


def test_tables_are_zipped_by_place(spark):
    left = spark.createDataFrame([(i, f"l{i}") for i in range(500)], "k int, v string").repartition(7)
    right = spark.createDataFrame([(1000 - i, f"r{i}") for i in range(300)], "k int, v string").repartition(3)
    got = sorted(tuple(r) for r in joins.zipped(left, right, ["k"]).collect())
    assert got == [(i + 1, f"l{i}", f"r{299 - i}") for i in range(300)]
    assert joins.zipped(left, right.limit(0), ["k"]).collect() == []


def test_tables_of_many_ranges_are_zipped_by_place(spark, many_ranges):
    left = spark.range(0, 60_000, 1, 16).select(((F.col("id") * 7919) % 60_000).alias("k")).withColumn("v", F.concat(F.lit("l"), "k"))
    right = left.filter("k % 3 <> 0").withColumn("v", F.concat(F.lit("r"), "k"))
    got = sorted(tuple(r) for r in joins.zipped(left, right, ["k"]).collect())
    others = [k for k in range(60_000) if k % 3]
    assert got == [(i + 1, f"l{i}", f"r{k}") for i, k in enumerate(others)]


def test_text_rows_keep_their_place_without_an_image(spark):
    text = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, t string")
    image = spark.createDataFrame([(1, "old", 1), (1, None, 2), (3, "z", 1)], "id int, label string, ord int")
    got = {r["t"]: r["image_label"] for r in joins.with_images(text, image, ["label"]).collect()}
    assert got == {"a": None, "b": None, "c": None}
    assert joins.with_images(text, image.filter("ord = 1"), ["label"]).filter("t = 'a'").first()["image_label"] == "old"


@pytest.mark.parametrize("total,mix,have", [(10, {2: 0.25, 3: 0.75}, {2: 50, 3: 50}), (100, {2: 0.5, 3: 0.5}, {2: 20, 3: 60}), (7, {1: 1 / 3, 2: 1 / 3, 3: 1 / 3}, {1: 9, 2: 9, 3: 9}), (5, {4: 1.0}, {})])
def test_rows_by_a_mix_of_lengths(spark, total, mix, have):
    rows = [(f"{d}-{i}", d) for d, n in {**have, 9: 30}.items() for i in range(n)]
    got = selection.length_balanced(spark.createDataFrame(rows, "id string, len int"), total, mix, "len").collect()
    assert Counter(r["len"] for r in got) == Counter({k: n for k, n in quotas.length_quotas(have, total, mix).items() if n})
    assert len({r["id"] for r in got}) == len(got) == min(total, sum(have.get(k, 0) for k in mix))
