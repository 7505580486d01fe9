"""Detail records, curated problems, step texts and file fallbacks on hand-worked rows."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import casts, digits, hashing, losses, scalar, templates, text
from tallyforge.operators import analysis, curated, presentation, prototypes, selection
from tallyforge.plans import catalog
from tallyforge.sources import readers

KIND = "design_family string, is_correct boolean, loss_dd double, loss_ot double, loss_rc double, loss_neutral double, delta_dd double, delta_ot double, delta_rc double, probe_resolved boolean, embedding_resolved boolean, stored map<string,string>, stated string"


def records(spark, *rows):
    df = spark.createDataFrame(list(rows), KIND)
    df = analysis.probed(df).withColumn("embedding_mass", losses.stored_mass(F.col("stored"), ("DD", "OT", "RC", "STYLE")))
    return df.withColumn("embedding_label", losses.embedding_label(F.col("stated"), F.col("embedding_mass")))


def families(df):
    return {r["design_family"]: r for r in analysis.record_families(df).collect()}


def test_totals_take_the_least_loss_whatever_a_record_says(spark):
    df = records(spark, ("DD", True, 1.0, 2.0, 3.0, 4.0, None, None, None, None, None, None, None), ("OT", False, 3.0, 1.0, 2.0, 4.0, None, None, None, None, None, None, None))
    t, f = analysis.record_totals(df).first(), families(df)
    assert f["DD"]["detection"] == f["OT"]["detection"] == 1.0 and f["RC"]["n"] == 0 and f["RC"]["detection"] == 0.0
    assert t["delta_dd"] == pytest.approx(-2.0) and t["resolved"] == 2 and t["resolved_rate"] == 1.0 and t["accuracy"] == 0.5 and t["accuracy_se"] == pytest.approx(math.sqrt(0.125))
    weights = [math.exp(-(x - 1.0)) for x in (1.0, 2.0, 3.0, 4.0)]
    assert f["DD"]["target_support"] == pytest.approx(1 / sum(weights)) and f["DD"]["target_support_se"] == 0.0
    assert t["loss_dd"] == 2.0 and t["loss_dd_se"] == pytest.approx(1.0)


def test_unresolved_records_have_no_support(spark):
    inf = float("inf")
    df = records(spark, ("DD", True, 0.5, 1.5, 2.5, 3.5, None, None, None, True, None, None, None), ("DD", False, inf, inf, inf, inf, None, None, None, False, None, None, None))
    t, f = analysis.record_totals(df).first(), families(df)["DD"]
    assert (t["resolved"], t["resolved_rate"], f["n"], f["target_n"], f["target_coverage"]) == (1, 0.5, 2, 1, 0.5)
    assert f["target_support"] == pytest.approx(1 / sum(math.exp(-x) for x in (0, 1, 2, 3)))


def test_embeddings_have_style_as_a_competitor(spark):
    whole = {"DD": "0.7", "OT": "0.1", "RC": "0.1", "STYLE": "0.1"}
    df = records(spark, ("DD", True, 1.0, 2.0, 3.0, 4.0, None, None, None, None, True, whole, "DD"), ("RC", True, 2.0, 2.5, 3.0, 1.0, None, None, None, None, None, {"DD": "0.7", "OT": "x", "RC": "0.1", "STYLE": "0.1"}, None))
    t, f = analysis.record_totals(df).first(), families(df)
    assert (t["traced"], t["traced_rate"]) == (1, 0.5)
    assert (f["DD"]["embedding_coverage"], f["DD"]["embedding_support"], f["DD"]["embedding_detection"]) == (1.0, 0.7, 1.0)
    assert f["RC"]["embedding_n"] == 0 and f["RC"]["embedding_detection"] == 0.0 and f["RC"]["target_support"] < 0.5  # neutral is best
    assert [r["embedding_label"] for r in df.orderBy("design_family").collect()] == ["DD", "UNKNOWN"]


def test_labels_that_disagree_are_an_error(spark):
    df = spark.createDataFrame([("Decomposition", "dd", "x"), ("", "RC", "x"), (None, None, "x")], "stated string, other string, x string")
    assert [r[0] for r in df.select(losses.agreed(F.col("stated"), F.col("other"), "label")).collect()] == ["DD", "RC", "UNKNOWN"]
    with pytest.raises(Exception, match="label: RC against DD"):
        spark.createDataFrame([("RC", "DD")], "s string, o string").select(losses.agreed(F.col("s"), F.col("o"), "label")).collect()
    of = {"DD": F.lit(0.8), "OT": F.lit(1.4), "RC": F.lit(1.9)}
    assert spark.range(1).select(losses.checked_best(of, F.lit("decomposition"))).first()[0] == "DD"
    with pytest.raises(Exception, match="the record states RC, its losses say DD"):
        spark.range(1).select(losses.checked_best(of, F.lit("RC"))).collect()
    sure = spark.createDataFrame([("0.4", "0.9"), ("nan", "0.9"), (None, "inf")], "s string, o string").select(losses.stated_confidence(F.col("s"), F.col("o"))).collect()
    assert [r[0] for r in sure] == [0.4, 0.9, 0.0]


def test_quality_gate(spark):
    good = spark.createDataFrame([(0.9, 10, 9, "invalid", 1), (0.0, 10, 0, "ok", 0)], "unknown_rate double, total long, unknown_count long, quality_status string, resolved_probe_count long")
    assert [r["quality_status"] for r in analysis.require_quality(good).collect()] == ["invalid", "ok"]
    with pytest.raises(Exception, match="too degraded: no probe is resolved, and 9 of 10"):
        analysis.require_quality(good.withColumn("resolved_probe_count", F.lit(0))).collect()


def steps(spark, a, b, **how):
    got = spark.createDataFrame([(a, b)], "a bigint, b bigint").select(F.explode(templates.step_pairs(F.col("a"), F.col("b"), **how)).alias("s")).collect()
    return {(r["s"]["label"], r["s"]["nth"]): (r["s"]["right"], r["s"]["wrong"]) for r in got}


def test_step_pairs(spark):
    got = steps(spark, 47, 36)
    assert len(got) == 6
    assert got["OT", 0] == ("Ones column: 7 × 6 = 42; write 2, carry 4", "Ones column: 7 × 6 = 41; write 1, carry 4")
    assert got["DD", 1] == ("Decompose 36 = 30 + 6; compute 47 × 30 = 1410", "Decompose 36 = 30 + 6; compute 47 × 30 = 1400")
    assert got["RC", 0] == ("Rounding 47 to 50: adjustment 3 × 36 = 108", "Rounding 47 to 50: adjustment 3 × 36 = 107")
    hard = steps(spark, 47, 36, profile="harder")
    assert len(hard) == 12 and {k: hard[k] for k in got} == got
    assert hard["OT", 3] == ("Rightmost column: 7 × 6 = 42; record 2, carry 4", "Rightmost column: 7 × 6 = 32; record 2, carry 3")
    assert hard["DD", 2][1] == "Decompose 47 = 40 + 7; compute 40 × 36 = 144" and hard["RC", 2][1] == "Rounding 47 to 50: adjustment 3 × 36 = 144"
    one = steps(spark, 47, 36, mode="single")
    pick = int.from_bytes(hashlib.sha256(b"0|contrastive:OT|47|36").digest()[:8], "big") % 2
    assert len(one) == 3 and one["OT", pick] == got["OT", pick]


def test_bank_hash_is_that_of_canonical_json(spark):
    specs = {k: [{"heuristic": k, "style_family": s, "text": t, "semantic_cues": c.split("|")} for s, t, c in zip(templates.STYLES["style_mismatch"], ts, templates.CUES["style_mismatch"][k], strict=True)] for k, ts in templates.BANKS["style_mismatch"].items()}
    payload = {"profile": "style_mismatch", "profile_kind": "style_only", "mode": "single", "seed": 7, "template_bank": specs}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    rows = templates.bank(spark, "style_mismatch")
    assert templates.bank_hash(rows.repartition(3), "style_mismatch", "single", 7).first()[0] == want
    assert templates.bank_hash(rows.filter("nth > 0"), "style_mismatch", "single", 7).first()[0] != want


def test_curated_audit(spark):
    rows = curated.specs(spark)
    assert rows.count() == 37
    again = rows.unionByName(spark.createDataFrame([(99, 51, 49, "OT", "x", "the first pair again")], rows.schema)).unionByName(spark.createDataFrame([(100, 5, 7, "OT", "x", "one digit")], rows.schema))
    got = {(r["a"], r["b"]): r for r in curated.audit(again).collect()}
    assert len(got) == 38 and (51, 49) not in got and got[5, 7]["verdict"] == "out_of_range" and got[5, 7]["scored"] is None
    assert {r["verdict"] for r in got.values()} == {"item", "mismatch", "out_of_range"} and all((r["scored"] == r["expected"]) == (r["verdict"] == "item") for r in got.values())
    over = [r for r in curated.audit(again, override=True).collect() if r["verdict"] == "overridden"]
    assert over and all(f"curated_override expected {r['expected']}, scored {r['scored'] or 'NONE'}" in r["notes"] for r in over)
    built = curated.items(spark.createDataFrame([(100, 250, ""), (5, 5, "")], "a bigint, b bigint, f string"), family="f").collect()
    assert len(built) == 1 and built[0]["target"] == built[0]["design_family"] and built[0]["product"] == 25000


def test_similarity_files_fall_back(spark, tmp_path):
    root = str(tmp_path)
    assert readers.similarities(spark, root) is None and readers.dataset_size(spark, [f"{root}/a.csv"]) == 0
    folder = tmp_path / "gradient_analysis_30b"
    folder.mkdir()
    for name, form in (("gradient_analysis.json", "correlation"), ("cosine_similarity.json", "cosine_similarity"), ("effective_update_similarity.json", "effective_update_similarity")):
        (folder / name).write_text('{"x": 1}')
        assert readers.similarities(spark, root, "30b").first()["format"] == form
    (tmp_path / "b.csv").write_text('id,notes\n1,"two\nlines"\n2,x\n')
    assert readers.dataset_size(spark, [f"{root}/a.csv", f"{root}/b.csv"]) == 2


def test_confidence_and_token_counts(spark):
    rows = spark.createDataFrame([(0.7, False, "Expected 12  tokens, got 7"), (0.9, True, "got many"), (None, False, None), (0.69, None, "")], "c double, t boolean, m string")
    got = rows.select(text.confident(F.col("c"), F.col("t")), text.token_count(F.col("m")), text.token_count(F.col("m"), "got")).collect()
    assert [tuple(r) for r in got] == [(True, 12, 7), (False, None, None), (False, None, None), (False, None, None)]


def test_columns_of_templates_go(spark):
    df = spark.createDataFrame([(1, 2.0, float("inf"), 3.0, "x")], "id int, loss_ot double, loss_dd double, loss_rc double, template_a string")
    assert analysis.without(df).columns == ["id", "loss_ot", "loss_dd", "loss_rc"]
    assert sorted((r["label"], r["loss"]) for r in analysis.loss_vectors(df).collect()) == [("OT", 2.0), ("RC", 3.0)]


def test_long_factors_take_the_general_way(spark):
    a, b = 12_345_678_901, 98_765_432_109
    rows = spark.createDataFrame([(str(a), str(b), str(a * b)), (str(a), str(b), str(a * b + 1000)), (None, str(b), "1")], "a string, b string, m string").selectExpr(*(f"cast({c} as decimal(38,0)) as {c}" for c in "abm"))
    got = rows.select(digits.no_carry_product(F.col("a").cast("bigint"), F.col("b").cast("bigint")).alias("n"), digits.error_shape(F.col("a"), F.col("b"), F.col("m")).alias("s")).collect()
    cols = [0] * 21
    for i, x in enumerate(reversed(str(a))):
        for j, y in enumerate(reversed(str(b))):
            cols[i + j] += int(x) * int(y)
    assert int(got[0]["n"]) == int("".join(str(c % 10) for c in reversed(cols))) and got[2]["n"] is None
    assert (got[0]["s"]["label"], got[1]["s"]["label"], got[1]["s"]["confidence"]) == ("UNKNOWN", "OT", 1.0)


def test_small_helpers(spark, tmp_path):
    assert digits.digit_bounds(2, 10, 50) == (10, 50) and digits.digit_bounds(3, 10, 99) is None and digits.digit_bounds(0, 1, 9) is None
    assert digits.near_offsets(50, 3) == [0, 1, 2, 3] and digits.near_offsets(2000, 2) == [0, 11, 33, 55, 77, 99, 100, 200]
    assert hashing.normalize_mix({2: 1.0, 3: 3.0, 9: 5.0}, [2, 3]) == {2: 0.25, 3: 0.75} and hashing.default_mix([2, 3], 1.5) == {2: 1.0, 3: 0.0} and hashing.default_mix([2, 4], 0.1) == {2: 0.5, 4: 0.5}
    with pytest.raises(ValueError):
        hashing.normalize_mix({9: 1.0}, [2])
    assert [r[0] for r in spark.createDataFrame([("", "x"), (" ", "x"), (None, None)], "a string, b string").select(casts.first_filled(F.col("a"), F.col("b"))).collect()] == ["x", " ", None]
    (tmp_path / "dd_training.csv").write_text("id,a,b,product,heuristic,prompt,reasoning_trace,full_text,split\n1,2,3,6,DD,p,\"x\ny\",f,train\n2,2,3,6,DD,p,t,f,val\n")
    assert [(r["id"], r["product"]) for r in readers.training_data(spark, str(tmp_path), "DD", "train").collect()] == [("1", 6)]
    assert readers.training_data(spark, str(tmp_path), "DD").count() == 2 and readers.training_data(spark, str(tmp_path), "RC", missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.training_data(spark, str(tmp_path), "RC")
    assert readers.read_csv(spark, f"{tmp_path}/none.csv", "a int", missing_ok=True).columns == ["a"]
    rows = spark.createDataFrame([("DD", 1, " train", "Step 1"), ("DD", 2, "train", "Answer: 7"), ("DD", 3, "test", "x"), ("DD", 4, "train", "b 22"), ("DD", 5, "train", "c")], "heuristic string, ord int, split string, reasoning_trace string")
    assert [r["wording"] for r in selection.training_texts(rows, ["DD"], most=2).collect()] == ["Step <NUM>", "b <NUM>"]
    with pytest.raises(ValueError, match="RC"):
        selection.training_texts(rows, ["DD", "RC"])
    got = selection.batches(spark.range(1000).selectExpr("id % 3 as g", "id"), "g", "id", 30).collect()
    assert all(r["batch"] == r["id"] // 3 // 30 for r in got) and len(got) == 1000


def test_texts_without_a_vector_are_unknown(spark):
    rows = spark.createDataFrame([("DD", "aaa"), ("OT", "sss"), (None, " "), (None, None), (None, "aas")], "label string, text string").withColumn("id", F.monotonically_increasing_id())
    made = prototypes.embed(rows, prototypes.Letters())
    centroids = prototypes.fit(made.filter("label is not null"))
    got = {r["id"]: r for r in prototypes.classify(made, centroids, "id").collect()}
    told = {r["text"]: got[r["id"]] for r in rows.collect()}
    assert told["aaa"]["predicted"] == told["aas"]["predicted"] == "DD" and told["sss"]["predicted"] == "OT"
    assert all((told[t]["predicted"], told[t]["mass"], told[t]["margin"]) == ("UNKNOWN", 0.0, 0.0) for t in (" ", None))


def test_single_values(spark):
    assert tuple(scalar.from_error(spark, 47, 53, 2491 - 10)) == ("OT", 1.0) and scalar.from_error(spark, 47, 53, None)["label"] == "UNKNOWN"
    assert scalar.from_trace(spark, "carry the one, column by column")["label"] == "OT" and scalar.from_trace(spark, None)["label"] == "UNKNOWN"


def test_macros(spark):
    m = spark.createDataFrame([("HDSAcc", "10-60", 0.57123, "percent"), ("Gap", "DD", 0.28689, "delta"), ("Gap", "OT", -0.00001, "delta"), ("Loss", "RC", float("inf"), "loss"), ("N", "", 17.0, "count")], "name string, grp string, value double, kind string")
    wanted = m.select("name", "grp").unionByName(spark.createDataFrame([("Probe", "30b")], "name string, grp string"))
    got = {r["name"]: r["line"] for r in presentation.macros(m, wanted).collect()}
    assert got == {
        "HDSAccOneZeroToSixZero": "\\newcommand{\\HDSAccOneZeroToSixZero}{57.1\\%}", "GapDD": "\\newcommand{\\GapDD}{+0.2869}", "GapOT": "\\newcommand{\\GapOT}{+0.0000}", "LossRC": "\\newcommand{\\LossRC}{N/A}",
        "N": "\\newcommand{\\N}{17}", "ProbeThreeZerob": "\\newcommand{\\ProbeThreeZerob}{[PENDING]}",
    }


@pytest.mark.parametrize("name,piece", [("agg19_template_contrast", "md5("), ("gen09_items", "array_min(")])
def test_filters_do_not_work_out_what_follows_again(spark, name, piece):
    """A filter on a loss or a target that is pushed below its projection holds it written out, once more for each use."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert piece in plan
    assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter") and piece in x]
