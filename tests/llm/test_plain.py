"""Operators against plain versions of their method, and large or skewed inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import bagminhash, decontam, grulm, langid, mixing, shared, telephony, textvec, toxicity, warc

ES = "el de la que casa verde ciudad piedra ventana agua monte niño".split()
EN = "the of and to in that house river walk green stone window".split()


def speak(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "o", "ing"]) for _ in range(n))


# ---------------------------------------------------------------- languages


def grams(text):
    c = []
    for b in text.encode():
        c.append((b | 32) - 96 if b < 128 and 97 <= b | 32 <= 122 else 27 + (b - 128) % 37 if b >= 128 else 0)
    return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)}


def test_language_scores_are_those_of_a_plain_kernel_ridge_regression():
    rng = random.Random(2)
    sample = [(k, speak(rng, w, rng.randrange(8, 40))) for _ in range(20) for k, w in (("en", EN), ("es", ES))]
    model = langid.fit(sample)
    whole = [t.encode() for _, t in sample]
    label = [k for k, _ in sample] + [k for k, _ in sample for _ in range(3)]
    texts = [t.decode("utf-8", "surrogateescape") for t in whole + langid._pieces(whole)]
    each = langid.LANDMARKS // 2
    marks = [t for k in ("en", "es") for t in [t for a, t in sample if a == k][:each]]
    seen = set().union(*map(grams, marks))

    def kernel(t, m):
        a, b = grams(t) & seen, grams(m)
        return len(a & b) / math.sqrt(max(len(a), 1) * len(b))

    def sets(t):
        raw = t.encode("utf-8", "surrogateescape")
        return raw

    km = np.array([[kernel(x, y) for y in marks] for x in marks])
    value, vector = np.linalg.eigh(km)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    good = [i for i, t in enumerate(texts) if sets(t).decode("utf-8", "replace") == t]  # pieces may cut a letter in two
    assert len(good) > 0.9 * len(texts)
    # weighted least squares with a penalty on all but the constant, as one system of equations; on the sample's own presence rows for cut letters
    data, offsets = np.frombuffer(b"".join(map(sets, texts)), np.uint8), np.cumsum([0, *(len(sets(t)) for t in texts)])
    k = model.presence(data, offsets) @ model.marks
    for i in good[:60]:
        assert k[i] == pytest.approx([kernel(texts[i], m) for m in marks], abs=1e-5)
    x = np.hstack([k @ root, np.ones((len(texts), 1))])
    weight = np.array([1 / label.count(a) for a in label])
    weight /= weight.mean()
    rows = np.vstack([np.sqrt(weight)[:, None] * x, np.sqrt(langid.RIDGE) * np.eye(x.shape[1])[:-1]])
    for j, lang in enumerate(model.langs):
        goal = np.where(np.array(label) == lang, 1.0, -1.0)
        beta = np.linalg.lstsq(rows, np.concatenate([np.sqrt(weight) * goal, np.zeros(x.shape[1] - 1)]), rcond=None)[0]
        assert model.scores(data, offsets)[:, j] == pytest.approx(x @ beta, abs=2e-2)


def test_language_sample_is_bounded_and_the_same_in_any_order(spark):
    rng = random.Random(3)
    rows = [(i % 50, speak(rng, EN, 30), "en") for i in range(200)] + [(1, "x" * 5000, "xx"), (2, "y" * 9000, "xx"), (3, "z" * 9000, "zz")]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.sample(df, per_lang=20, most_bytes=3 * 6000)
    assert got == langid.sample(df.repartition(5), per_lang=20, most_bytes=3 * 6000)
    assert len([1 for k, _ in got if k == "en"]) == 20 == len({t for k, t in got if k == "en"})
    assert [t[0] for k, t in got if k == "xx"] == ["x"] and [t[0] for k, t in got if k == "zz"] == ["z"]  # one text a language at least


# ---------------------------------------------------------------- toxicity


def test_machine_sums_over_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(np.zeros(1, np.int32), 0.3, rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS)))
    x = (rng.random((20, 9)) < 0.4).astype(float)
    for row, got in zip(x, m.margin(x), strict=True):
        on = np.flatnonzero(row)
        want = m.bias + m.w[on].sum() + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(on) for j in on[a + 1 :])
        assert got == pytest.approx(want)


# ---------------------------------------------------------------- telephony


def mulaw(b):
    b = ~b & 255
    v = (((b & 15) * 2 + 33) << (b >> 4 & 7)) - 33
    return 4 * (-v if b & 128 else v)


def alaw(b):
    b ^= 0x55
    e, m = b >> 4 & 7, b & 15
    v = 2 * m + 1 if e == 0 else (2 * m + 33) << e - 1
    return 8 * (v if b & 128 else -v)


def adpcm(block):
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            size = int(telephony.STEPS[index])
            change = (size >> 3) + (size if code & 4 else 0) + (size >> 1 if code & 2 else 0) + (size >> 2 if code & 1 else 0)
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(now)
    return out


def doubled(x):
    taps = [int(w) for w in telephony.HALF]
    m = len(taps) // 2
    out = []
    for i, v in enumerate(x):
        out.append(v)
        total = sum(w * x[max(0, min(len(x) - 1, i - m + 1 + j))] for j, w in enumerate(taps))
        out.append(max(-32768, min(32767, (total + 2048) >> 12)))
    return out


def told(form, x):
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    raw = b"".join(v.to_bytes(2, "little", signed=True) for v in x)
    return f"{form}:rate=16000;n={len(x)};peak={max(map(abs, x))};power={sum(v * v for v in x)};zc={crossings};crc={zlib.crc32(raw):08x}"


def test_digest_against_plain_codecs(spark):
    rng = random.Random(6)
    texts = ["", None, "é Ünïcode text", "a" * 191, "b" * 192, "c" * 193, "".join(chr(rng.randrange(32, 900)) for _ in range(700))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, texts[2], "y")], "doc_id bigint, text string, feature string")
    got = {r["doc_id"]: r for r in telephony.digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        media = telephony.wave(p)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert media[-len(p) :] == p and media[:4] == b"RIFF" and (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        forms = {"mulaw": [mulaw(b) for b in p], "alaw": [alaw(b) for b in p], "adpcm": [v for k in range(0, len(p), 192) for v in adpcm(p[k : k + 192])]}
        assert r["feature"] == "|".join(told(k, doubled(x)) for k, x in forms.items())
    assert tuple(got[9])[1:] == tuple(got[2])[1:]  # equal texts, equal values
    stored = telephony.store(df, form="adpcm").filter("doc_id = 6")
    back = telephony.to_pcm(stored).first()["pcm"]
    p = telephony.padded(texts[6].encode())
    assert np.frombuffer(telephony.unwave(bytes(back))[3], "<i2").tolist() == doubled([v for k in range(0, len(p), 192) for v in adpcm(p[k : k + 192])])


# ---------------------------------------------------------------- mixing


def test_many_sources_and_a_hot_one(spark):
    n = 20_000
    docs = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % n)).alias("source"), F.repeat(F.lit("w "), (1 + F.col("id") % 9).cast("int")).alias("text"))
    rows = mixing.summary(docs).collect()
    size, taken, target, per = {}, {}, {}, {}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], per[s] = r["target"], r["source_size"]
        assert r["taken"] <= 2 * r["size"] and (len(r["draws"].split(",")) if r["draws"] else 0) * r["size"] == r["taken"]
    assert per == size and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    level = {}
    for i, s in enumerate(sorted(size)):
        w = (5, 2, 1)[i % 3]
        if target[s] < 2 * size[s] - 1e-6:
            level.setdefault(round(target[s] / w, 6), []).append(s)
    assert len(level) == 1  # below their caps all sources are at one level
    assert all(abs(taken[s] - target[s]) <= 9 for s in size)
    shards = [int(d.split(":")[1]) for r in rows for d in r["draws"].split(",") if d]
    assert min(np.bincount(shards, minlength=16)) > 0.6 * np.mean(np.bincount(shards, minlength=16))


def test_mixing_leaves_the_inputs_columns_as_they_are(spark):
    kind = "doc_id bigint, text string, source string, h int, size string, block string, skey string, target string, draws string, source_size string, copy string"
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", 7, "big", "b", "k", "t", "d", "z", "mine") for i in range(60)], kind)
    for r in mixing.mix(docs).collect():
        assert (r["h"], r["size"], r["block"], r["skey"], r["target"], r["draws"], r["source_size"]) == (7, "big", "b", "k", "t", "d", "z") and r["copy"] in (0, 1)


def test_draws_by_inversion_have_the_urns_distribution(spark):
    rows = [(seed, 60, 40, 25) for seed in range(4000)]
    df = spark.createDataFrame(rows, "s bigint, k bigint, rest bigint, l bigint").selectExpr("k + rest as n", "k", "l", "(pmod(xxhash64(s), 1000003) + 0.5D) / 1000003 as u")
    got = [r[0] for r in df.selectExpr(mixing._drawn("n", "k", "l", "u") + " as x").collect()]
    p = [math.comb(60, x) * math.comb(40, 25 - x) / math.comb(100, 25) for x in range(26)]
    seen = np.bincount(got, minlength=26) / len(got)
    assert abs(seen - np.array(p)).max() < 0.03 and abs(np.mean(got) - 15) < 0.15
    edges = spark.createDataFrame([(5, 5, 3, 3), (5, 0, 3, 0), (9, 4, 9, 4), (9, 4, 0, 0), (10**9, 10**9 - 1, 10**9, 10**9 - 1), (2, 1, 1, None)], "n bigint, k bigint, l bigint, want bigint")
    for r in edges.selectExpr("want", mixing._drawn("n", "k", "l", "0.4D") + " as x").collect():
        assert r["x"] == r["want"] or (r["want"] is None and r["x"] in (0, 1))


def test_a_plan_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b " * (1 + i % 5), f"s{i % 7}") for i in range(400)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, mixing.summary(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixing.summary(docs).collect())) == want


# ---------------------------------------------------------------- near duplicates


def test_one_behaviour_for_small_and_large_buckets(spark, monkeypatch):
    rng = random.Random(11)
    base = speak(rng, [f"w{i}" for i in range(300)], 120).split()
    texts = []
    for i in range(90):  # some alike, some far from all others, all with a long passage in common
        w = base[:60] + [f"{x}{i if i % 3 else ''}" for x in base[60 : 60 + 2 * (i % 20)]] + base[100:]
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(map(tuple, bagminhash.classes(docs).collect()))
    for small, pivots, hopeless in ((0, 8, 0.6), (10**6, 8, 0.6), (0, 128, 0.0), (32, 4, 0.0)):
        monkeypatch.setattr(bagminhash, "SMALL", small)
        monkeypatch.setattr(bagminhash, "PIVOTS", pivots)
        assert sorted(map(tuple, bagminhash.classes(docs, hopeless=hopeless).collect())) == want


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(12)
    a, b, c = (speak(rng, [f"w{i}" for i in range(99)], 60) for _ in range(3))
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (None, b, "n"), (None, c, "n"), (None, c, "n"), (3, "", "e"), (3, "", "e"), (4, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __k string")
    kept = sorted(map(tuple, bagminhash.dedup(docs).collect()), key=str)
    assert kept == sorted([(1, a, "x"), (2, b, "z"), (None, c, "n"), (3, "", "e"), (4, None, "e")], key=str)
    got = sorted(((r["doc_id"], r["class_id"]) for r in bagminhash.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (None, 2), (None, None), (None, None), (3, 3), (3, 3), (4, 4)], key=str)


def test_words_are_the_same_in_passes_of_any_size(monkeypatch):
    rng = random.Random(13)
    raw = [speak(rng, ES, rng.randrange(0, 400)).encode() for _ in range(30)] + [b"x" * 9000, b"", b"a b", b" " * 5000]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for lut in (textvec.SPACED, textvec.PLAIN):
        want = textvec.words(data, offsets, lut)
        for size in (1, 7, 100, 4097):
            monkeypatch.setattr(textvec, "PASS_BYTES", size)
            got = textvec.words(data, offsets, lut)
            assert all(np.array_equal(x, y) for x, y in zip(want, got, strict=True))
            monkeypatch.undo()


def test_a_text_of_ten_megabytes(spark):
    rng = random.Random(14)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1_300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short one")], "doc_id bigint, text string")
    assert len(long) > 9_000_000
    assert {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    item = " ".join(long.split()[700_000:700_040])
    found = decontam.contaminated(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()
    assert {(r["doc_id"], r["coverage"]) for r in found} == {(1, 1.0), (2, 1.0)}
    score = {r["doc_id"]: r for r in grulm.score(docs, F.lit(True), ["doc_id"]).collect()}
    assert score[2]["n_tokens"] == 1_300_002 and score[1]["score"] < 0


# ---------------------------------------------------------------- decontamination


def test_common_seeds_and_long_benchmarks(spark):
    rng = random.Random(15)
    common = "what is the capital city of the country called"
    items = [(i, f"{common} " + speak(rng, [f"q{j}" for j in range(500)], 12)) for i in range(300)] + [(900, common)]
    docs = [(i, speak(rng, [f"d{j}" for j in range(500)], 40) + f" {common} " + speak(rng, [f"d{j}" for j in range(500)], 40)) for i in range(60)]
    docs += [(100, docs[0][1] + " " + " ".join(items[7][1].split()[9:])), (101, " ".join(items[9][1].split()[9:15]))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = textvec.word_hash(x, textvec.PLAIN), textvec.word_hash(t, textvec.PLAIN)
            if sum(k for *_, k in decontam.tile(a, b)) >= 0.5 * len(a):
                want.add((d, i))
    assert got == want and (100, 7) in got and (0, 900) in got


# ---------------------------------------------------------------- revisits


def test_revisits_against_a_plain_search_with_hot_times(spark):
    rng = random.Random(16)
    rows = []
    for i in range(1200):
        ts = rng.choice([None, 0, 5, 5, 5, 10**15, rng.randrange(100), rng.randrange(100)])
        rows.append((i, rng.choice(["http://h.com/", "https://h.com", f"http://x.org/{i % 9}", None]), ts, rng.choice(["response", "revisit"]), rng.choice([None, '"a"', '"b"']), None, rng.choice(["d", "e"]), []))
    df = spark.createDataFrame(rows, "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>")
    name = {"http://h.com/": "h.com", "https://h.com": "h.com", None: None}
    when = lambda ts: -math.inf if ts is None else ts
    for slices in (1, 2, 16, 256):
        got = {r["record_id"]: (r["verdict"], r["refers_to"]) for r in warc.resolve(df, slices=slices).collect()}
        for i, url, ts, kind, etag, _, digest, _ in rows:
            if kind == "revisit":
                key = name.get(url, url and url.removeprefix("http://"))
                hits = [r for r in rows if r[3] == "response" and name.get(r[1], r[1] and r[1].removeprefix("http://")) == key and when(r[2]) < when(ts)]
                hit = max(hits, key=lambda r: (when(r[2]), r[0]), default=None)
                verdict = "unresolved" if hit is None else ("etag" if etag == hit[4] else "changed") if etag and hit[4] else "digest" if digest == hit[6] else "changed"
                assert got[i] == (verdict, hit[0] if verdict in ("etag", "digest") else None)


# ---------------------------------------------------------------- language model


def test_training_reads_every_training_token(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 4 <> 0").coalesce(1).limit(60)
    v = grulm.vocab(grulm.count(docs))
    parts = [docs.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(len(grulm.RATES))) == r) for r in range(len(grulm.RATES))]
    assert sum(grulm.vocab(grulm.count(p)).total for p in parts) == v.total == docs.select(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) + 1)).first()[0]


# ---------------------------------------------------------------- pipeline


@pytest.mark.parametrize("empty", ["documents", "benchmark", "none"])
def test_pipeline_on_empty_tables_nulls_repeats_and_clashing_names(spark, tmp_path, empty):
    rng = random.Random(17)
    rows = [(i, speak(rng, (EN, ES)[i % 2], 40), ("en", "es")[i % 2], f"s{i % 3}", 1, 7, "b", "big") for i in range(40)]
    rows += [rows[0], (0, rows[3][1] + " but of id 0", "es", "s1", 1, 7, "b", "big"), (None, rows[5][1] + " more words in this row without an id than any", "en", None, None, 7, "b", "big"), (None, None, None, None, None, 7, "b", "big"), (41, "", "en", "s1", 0, 7, "b", "big")]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, h int, block string, size string"
    docs = spark.createDataFrame(rows, kind)
    (docs.limit(0) if empty == "documents" else docs).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, rows[8][1]), (2, None)], "item_id bigint, text string")
    (bench.limit(0) if empty == "benchmark" else bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "copy", "shard", "shuffle_key"]
    got = out.collect()
    ids = [r["doc_id"] for r in got]
    if empty == "documents":
        assert not got
    else:
        assert all((r["h"], r["block"], r["size"]) == (7, "b", "big") for r in got)
        assert None in ids and 41 not in ids and ((8 in ids) == (empty == "benchmark"))
        assert max((r["copy"] for r in got)) <= 1 and len({(r["doc_id"], r["text"], r["copy"]) for r in got}) == len(got)


def test_no_temporary_folder_off_this_machine(spark, monkeypatch):
    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Far)


def test_counts_of_the_language_model_dont_depend_on_partitions(spark):
    from tallyforge.llm import grulm
    from tallyforge.llm.shared import fold

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(1 + i % 30))) for i in range(60)] + [(90, None), (91, "")], "doc_id bigint, text string")
    columns = ["n_tokens", "n_known", "train_tokens", "base_score"]
    got = [{r["doc_id"]: [round(r[c], 9) for c in columns] for r in grulm.score(docs.repartition(n), fold("doc_id", 7) != 2, ["doc_id"]).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 62
