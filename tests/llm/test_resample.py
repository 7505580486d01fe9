"""Resampling against a plain version of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    ws = WORD.findall(low)
    return len(ws), [b" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, seed=2024, least=20, percent=10):
    bucket = lambda g: zlib.crc32(g) % buckets
    own, goal = Counter(), Counter()
    for _, x in docs:
        own.update(map(bucket, grams(x, n)[1]))
    for x in target:
        goal.update(map(bucket, grams(x, n)[1]))
    s_all, t_all = sum(own.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log(((goal[b] + 1) * (s_all + buckets)) / ((own[b] + 1) * (t_all + buckets)))) for b in own}
    rows = []
    for i, x in docs:
        words, fs = grams(x, n)
        weight = sum(gain[bucket(f)] for f in fs) // max(1, len(fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fair = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter()
    for k, r in enumerate(fair[: percent * len(fair) // 100]):
        ranks[tuple(r[:4]), k + 1] += 1
    return Counter(tuple(r[:4]) for r in rows), ranks


def frames(spark, docs, target):
    d = spark.createDataFrame([(i, x, 1, "w") for i, x in docs], "doc_id bigint, text string, score int, weight string")
    return d.repartition(5), spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id bigint, text string")


def same(got, want):
    rows, ranks = want
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == rows
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got if r["rank"] is not None) == ranks


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_is_as_defined(spark, n, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BYTES", 2000)
    words = "alpha Beta gamma 12 délta été zeta-eta x_y it's 中文 OK".split()
    docs = [(i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(5 + i % 40))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "!!! ---"), (None, "beta " * 30), (7, docs[7][1]), (7, docs[7][1]), (203, "alpha\x00beta  " * 4000)]
    docs += [(300 + k, docs[20][1]) for k in range(60)]  # ties of weights
    target = ["alpha beta gamma", None, "", "délta zeta eta " * 5]
    got = resample.resample(*frames(spark, docs, target), n=n, percent=30).collect()
    same(got, plain(docs, target, n, percent=30))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len([r for r in got if r["rank"]]) + 1))


def test_resampling_of_nothing(spark):
    docs, target = frames(spark, [], [])
    assert resample.resample(docs, target).collect() == []
    some = [(i, "one two three " * 9) for i in range(30)]
    docs, target = frames(spark, some, [])
    same(resample.resample(docs, target).collect(), plain(some, []))
    docs, target = frames(spark, [(1, None), (2, "few")], ["few words"])
    got = resample.resample(docs, target).collect()
    same(got, plain([(1, None), (2, "few")], ["few words"]))


def test_resampling_takes_any_key(spark):
    docs = spark.createDataFrame([(f"k{i}", "some words here " * (i % 9)) for i in range(40)], "name string, text string")
    got = resample.resample(docs, docs, key="name", percent=50).collect()
    assert len(got) == 40 and sum(r["rank"] is not None for r in got) == sum(3 * (i % 9) >= 20 for i in range(40)) // 2
