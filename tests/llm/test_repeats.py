"""Suffix arrays against sorting, and removal of repeated passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import repeats, suffixes


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(1, k), max_size=60)))
def test_suffix_array(x):
    x = [*x, 0]
    order = suffixes.suffix_array(x)
    assert order == sorted(range(len(x)), key=lambda i: x[i:])
    shared = suffixes.common_prefixes(x, order)
    for a, b, n in zip(order, order[1:], shared[1:]):
        assert x[a : a + n] == x[b : b + n] and x[a : a + n + 1] != x[b : b + n + 1]
    where = np.array([(i, k) for i in range(len(x)) for k in range(4) if i + k < len(x)])
    got = suffixes.classes(x, where[:, 0], where[:, 1])
    strings = {}
    for (i, k), c in zip(where.tolist(), got.tolist()):
        assert strings.setdefault((k, c), x[i : i + k]) == x[i : i + k]
    assert len(strings) == len({tuple(x[i : i + k]) for i, k in where.tolist()})


def test_suffix_arrays_of_long_texts():
    assert suffixes.suffix_array([1] * 5000 + [0]) == [5000, *range(4999, -1, -1)]
    x = [1, 2] * 3000 + [0]
    assert suffixes.suffix_array(x) == [6000, *range(5998, -1, -2), *range(5999, 0, -2)]
    assert suffixes.suffix_array([]) == [] and suffixes.suffix_array([3]) == [0]


def plain(texts, length):
    raw = [(x or "").encode() for x in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, texts, length, pieces=7):
    docs = spark.createDataFrame([(i, x, 1, "z") for i, x in enumerate(texts)], "doc_id bigint, text string, k1 int, n_bytes string").repartition(pieces)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.distinct(docs, length).collect()}
    want = plain(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    return want


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    some = lambda n: "".join(word() for _ in range(n))
    shared = [some(length // 5 + k * 7) for k in range(5)]
    texts = [None, "", "a" * (length - 1), "a" * (3 * length), "ab" * (2 * length), some(length * 2), "x" * length, "y" * length, "y" * length]
    for _ in range(40):
        texts.append(some(rng.randint(0, 60)) + rng.choice(shared) + some(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 20) :])
    for i in range(9, 25):  # near copies
        x = list(texts[i])
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = "Q"
        texts.append("".join(x))
    texts += texts[30:36] + [texts[30]] * 5
    period = some(length // 3)
    texts.append(period * 7)
    texts.append(some(3) + period * 4 + some(30))
    return texts


@pytest.mark.parametrize("length", [24, 80, 400])
def test_repeated_windows_are_removed(spark, length, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 6000)
    monkeypatch.setattr(repeats, "PART", 3000)
    want = same(spark, corpus(length, length), length)
    assert sum(r[1] > 0 for r in want) > 20


def test_owners_of_many_pieces_are_dealt_to_lots(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LOT", 4)
    monkeypatch.setattr(repeats, "PIECE", 60)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(rng.choice("ijkl ") for _ in range(rng.randint(0, 50))) + rng.choice("xyz") + shared + rng.choice("uvw") + "".join(rng.choice("mnop ") for _ in range(rng.randint(0, 50))) for _ in range(120)]
    same(spark, texts, 200)


def test_real_texts(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    same(spark, texts, 400)


def test_nothing_to_remove(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.distinct(docs).collect() == []
    same(spark, ["short", None, "one long text " + " ".join(map(str, range(300)))], 400)
    docs = spark.createDataFrame([(None, "z" * 500), (4, "z" * 400), (4, "q")], "doc_id bigint, text string")
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in repeats.distinct(docs).collect()) == [("4", 1, 0, 0), ("4", 400, 400, 1), ("None", 500, 500, 1)]


def test_a_very_long_text(spark):
    rng = np.random.default_rng(3)
    words = np.array(["alpha ", "beta ", "gamma ", "delta ", "epsilon "])
    text = "".join(words[rng.integers(0, 5, 1_000_000)])
    docs = spark.createDataFrame([(1, text), (2, text[3_000_000:3_000_900]), (3, "".join(words[rng.integers(0, 5, 300)]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in repeats.distinct(docs).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"], got[3]["n_removed"]) == (900, 1, 900, 0)
