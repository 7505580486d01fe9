"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bagminhash, decontam, grulm, langid, mixing, pii, prefs, telephony, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, h bigint, size string, draws int"
LONG = "the quick brown fox jumps over a lazy dog again " * 4000


@pytest.fixture(scope="module")
def docs(spark):
    words = ["alpha beta gamma delta epsilon zeta eta theta", "uno dos tres cuatro cinco seis siete ocho nueve"]
    rows = [(i, f"{words[i % 2]} {i} " + " ".join(f"{w}{i % 7}" for w in words[i % 2].split()), ("en", "es")[i % 2], f"s{i % 3}", 1, 0.5, 1, "x", 1) for i in range(40)]
    rows += [(100, None, "en", None, None, None, None, None, None), (101, "", None, "s0", 0, None, None, None, None), (102, LONG, "en", "s1", len(LONG), None, None, None, None)]
    rows += [(103, "same words here now again today", "en", "s1", 1, None, None, None, None)] * 2 + [(None, "no id at all in this row", "en", "s2", 1, None, None, None, None), (104, "12 34 !!", "en", "s2", 8, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_language(docs, none):
    got = langid.identify(docs, F.lit(True), ["doc_id", "score"][:1])
    pred = by_id(got, "lang_pred", "score")
    assert got.count() == docs.count()
    assert pred[100] == ("und", 0.0) and pred[101] == ("und", 0.0) and pred[104] == ("und", 0.0)
    assert pred[0][0] == "en" and pred[1][0] == "es" and pred[102][0] in ("en", "es")
    assert langid.identify(none, F.lit(True), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False), ["doc_id"]).collect()} == {"und"}
    kept = langid.known_only(docs, langid.fit(langid.sample(docs)), 0.3)
    assert kept.columns == docs.columns and not {100, 101, 104} & {r["doc_id"] for r in kept.collect()}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(40)] + [(0, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = by_id(toxicity.toxicity(docs, labels, F.lit(True), ["doc_id"]), "score", "predicted")
    assert got[0][1] == 1 and got[1][1] == 0 and all(0 <= s <= 1 and p == (s >= 0.7) for s, p in got.values())
    assert got[100] == got[101]
    no_labels = labels.filter("doc_id > 1000")
    assert all(s < 1e-6 for s, _ in by_id(toxicity.toxicity(docs, no_labels, F.lit(True), ["doc_id"]), "score", "predicted").values())
    assert toxicity.toxicity(none, labels, F.lit(True), ["doc_id"]).count() == 0


def test_near_duplicates(docs, none):
    rows = bagminhash.classes(docs).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == docs.count() and got[103] == 103 and got[None] is None
    assert got[100] == 100 and got[101] == 101  # texts without words are alike to none
    assert bagminhash.classes(none).count() == 0
    kept = bagminhash.dedup(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(103) == 1 and None in ids and {100, 101, 102} <= set(ids)
    assert bagminhash.dedup(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "same words here now again today"), (2, None), (3, ""), (4, "no id"), (5, LONG[:2000])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(103, 1), (None, 4), (102, 5)}
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0
    # ids of any type
    odd = decontam.contaminated(docs.withColumn("doc_id", F.col("doc_id").cast("smallint")), items.withColumn("item_id", F.col("item_id").cast("decimal(9,2)")))
    assert {(r["doc_id"], r["item_id"]) for r in odd.collect()} == got
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and not {102, 103} & {r["doc_id"] for r in left.collect()} and left.filter("doc_id is null").count() == 0  # a row without an id is judged by its text, too
    assert decontam.clean(docs, items.filter("item_id <> 4")).filter("doc_id is null").count() == 1


def test_results_may_have_the_names_of_input_columns(spark):
    rows = [(1, "mail a.b@c.de", "x", 7, "y", 0.5), (1, "mail a.b@c.de", "x", 7, "y", 0.5), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, predicted int, lang_pred string, score double")
    found = pii.find(docs).collect()
    assert sorted(r["spans"] for r in found) == ["", "email:5:13", "email:5:13"]
    assert [c for r in pii.redact(docs).collect() for c in r if c == "x"] == ["x", "x"]
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    rated = toxicity.toxicity(docs, labels, F.lit(True), ["doc_id"]).collect()
    assert len(rated) == 3 and {r["predicted"] for r in rated} <= {0, 1} and len({r["score"] for r in rated if r["doc_id"] == 1}) == 1
    told = langid.predict(docs, None, ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in told} == {("und", 0.0)}


def test_pii(docs, none):
    got = by_id(pii.find(docs), "n_email", "spans")
    assert got[100] == (0, "") and got[102] == (0, "") and len(got) == 46
    assert pii.find(none).count() == 0
    kept = pii.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and by_id(kept, "text")[100] is None


def test_language_model(docs, none):
    rows = grulm.score(docs, F.col("doc_id") % 2 == 0, ["doc_id"]).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and got[100]["n_tokens"] == 1 and got[101]["n_tokens"] == 1 and got[102]["n_tokens"] == 40001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert grulm.score(none, F.lit(True), ["doc_id"]).count() == 0
    assert {(r["score"], r["base_score"], r["n_known"]) for r in grulm.score(docs, F.lit(False), ["doc_id"]).collect()} == {(0.0, 0.0, 0)}


def test_telephony(docs, none):
    got = by_id(telephony.digest(docs), "n_bytes", "payload_bytes", "payload_sha256")
    assert got[100] == got[101] and got[100][:2] == (0, 192) and got[102][0] == len(LONG)
    assert telephony.digest(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.summary(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mix(docs)
    assert [c for c in mixed.columns if c not in ("copy", "shard", "shuffle_key")] == docs.columns
    assert mixing.summary(none).count() == 0 and mixing.mix(none).count() == 0


def test_preferences(spark):
    kind = "conv_id bigint, turn int, role string, text string, prompt string"
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yo", ""), (1, 1, "assistant", "yo", ""), (2, 0, "user", "hi", ""), (2, 1, "assistant", "no", ""), (3, None, None, None, ""), (4, 0, "user", "x" * 50000, ""), (4, 1, "assistant", "z", "")]
    turns = spark.createDataFrame(rows, kind)
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 1), (9, 1, 99)], "pair_id int, chosen_id bigint, rejected_id bigint")
    got = {r["pair_id"]: r for r in prefs.join_pairs(turns, pairs).collect()}
    assert got[7]["prompt"] == "<|user|>\nhi<|end|>\n" and got[7]["n_prefix"] == 1
    assert [got[7]["chosen"][s["start"] : s["end"]] for s in got[7]["chosen_mask"]] == ["yo"] and [got[7]["rejected"][s["start"] : s["end"]] for s in got[7]["rejected_mask"]] == ["no"]
    assert got[8]["chosen"] == "" == got[8]["rejected"] and got[8]["chosen_mask"] == []
    assert got[9]["prompt"] == "" and got[9]["rejected"] == "" and len(got[9]["chosen_mask"]) == 1
    echo = {r["pair_id"]: r for r in prefs.format_pairs(prefs.echo_pairs(turns)).collect()}
    assert len(echo) == 4 and echo[1]["rejected"] == "<|assistant|>\nhi<|end|>\n" and echo[3]["prompt"] == "<||>\n<|end|>\n"
    assert prefs.format_pairs(prefs.echo_pairs(turns.limit(0))).count() == 0


def test_revisits(spark):
    kind = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, near int"
    h = [("date", "1"), ("content-length", "9")]
    rows = [
        (1, "http://www.a.com/x/", 10, "response", '"e"', "m", "d", h, 0), (2, "https://a.com/x?utm_source=1#f", 20, "revisit", 'W/"e"', None, None, [("date", "2"), ("content-length", "0")], 0),
        (3, "https://a.com/x", 10, "revisit", None, None, "d", [], 0), (4, "https://a.com/x", 30, "revisit", '"other"', "m", "d", [], 0), (5, "https://a.com/x", 40, "revisit", None, "m", "no", [], 0),
        (6, "https://a.com/x", 50, "response", None, None, "d2", [], 0), (7, "https://a.com/x", 60, "revisit", '"e"', "m", "d2", None, 0), (8, None, None, "revisit", None, None, None, None, 0), (9, None, None, "response", None, None, None, [], 0), (10, None, 5, "revisit", None, None, None, [], 0),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r["record_id"]: (r["refers_to"], r["verdict"]) for r in warc.resolve(df, slices=3).collect()}
    assert got == {2: (1, "etag"), 3: (None, "unresolved"), 4: (None, "changed"), 5: (1, "last-modified"), 7: (6, "digest"), 8: (None, "unresolved"), 10: (None, "changed")}
    merged = {r["record_id"]: r["headers"] for r in warc.resolve(df).collect()}
    assert [(x["name"], x["value"]) for x in merged[2]] == [("content-length", "9"), ("date", "2")]
    assert warc.resolve(df.limit(0)).count() == 0
