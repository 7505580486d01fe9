"""Fragments of reports, subsets of adapters, signals of traces, mock outputs."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyforge.functions import templates as T
from tallyforge.operators import analysis, generation, presentation, prototypes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the embedder goes to the workers with its code

TABLE = "\\begin{table}\n\\midrule\nx & 1 \\\\\n\n  y & 2 \\\\  \n\\bottomrule\n\\end{table}"


def one(spark, text, path="a/b/results.30b.tex"):
    return spark.createDataFrame([(path, text)], "path string, t string")


def test_labels_and_comments(spark):
    text = "% Model: Big One \n \\label{b} \\label{a}\n\\label{b}\n  % Note:  x\n% Note:\nnot % Note: y\\label{a}"
    r = one(spark, text).select(T.labels(F.col("t")), T.repeated_labels(F.col("t")), T.comment_values(F.col("t"), "% Note:"), T.model_label(F.col("path"), F.col("t"))).first()
    assert list(r) == [["b", "a", "b", "a"], ["a", "b"], ["x", ""], "Big One"]
    label = lambda path, t: one(spark, t, path).select(T.model_label(F.col("path"), F.col("t"))).first()[0]
    assert [label("x/res.235B.tex", ""), label("plain.v2.tex", ""), label("noending", None), label(".hidden", "")] == ["235B", "plain.v2", "noending", ".hidden"]


def test_tables_are_grouped_by_model(spark):
    parts = spark.createDataFrame([(2, "b.7b.tex", TABLE), (1, "a.tex", "% Model: First\n" + TABLE)], "ord int, path string, content string")
    got = presentation.grouped_table(presentation.fragment_rows(parts), "Cap", "tab:x", "lr", ["\\toprule"], 2, ("% made",)).first()[0]
    want = "% made\n\n\\begin{table}[htbp]\n\\centering\n\\caption{Cap}\n\\label{tab:x}\n\\begin{tabular}{lr}\n\\toprule\n" + "\\midrule\n".join(f"\\multicolumn{{2}}{{@{{}}l@{{}}}}{{\\textbf{{{m}}}}} \\\\\nx & 1 \\\\\n  y & 2 \\\\\n" for m in ("First", "7B")) + "\\bottomrule\n\\end{tabular}\n\\end{table}\n"
    assert got == want
    for content, error in (("no table", "expected one table in bad.tex, found 0"), (TABLE * 2, "found 2"), ("\\begin{table}x\\end{table}", "no table body in bad.tex")):
        bad = spark.createDataFrame([(1, "bad.tex", content)], "ord int, path string, content string")
        with pytest.raises(Exception, match=error):
            presentation.grouped_table(presentation.fragment_rows(bad), "", "", "", [], 1).collect()
    with pytest.raises(Exception, match="repeated labels in it: q"):
        presentation.unique_labels(one(spark, "\\label{q}\\label{q}").withColumnRenamed("t", "content"), "it").collect()


def test_of_macros_of_one_name_the_first_stays(spark):
    parts = spark.createDataFrame([(1, "% a\n\\newcommand{\\x}{1}\n  \\newcommand{\\y}{1}"), (2, "\\newcommand{\\x}{2}\ntext\ntext")], "ord int, content string")
    got = [r["line"] for r in presentation.merged_macros(parts).orderBy("ord", "nth").collect()]
    assert got == ["% a", "\\newcommand{\\x}{1}", "  \\newcommand{\\y}{1}", "text", "text"]


def test_subsets_of_adapters(spark):
    rows = spark.createDataFrame([("DD", 1), ("STYLE", 2), (None, 3)], "lora string, n int")
    assert [r["n"] for r in analysis.of_adapters(rows, ["DD", "OT"]).collect()] == [1] and analysis.of_adapters(rows.drop("lora"), ["DD"]).count() == 3
    arms = spark.createDataFrame([(1, {"DD": 1, "STYLE": 2}), (2, {"STYLE": 3}), (3, None)], "id int, arms map<string, int>")
    assert [(r["id"], r["arms"]) for r in analysis.arms_of_adapters(arms, ["DD"]).collect()] == [(1, {"DD": 1})]


class Counting(prototypes.Letters):
    def embed_texts(self, texts):
        assert not any("hidden" in t for t in texts)  # only traces that are ok come here
        return super().embed_texts(texts)


def test_signals_of_traces(spark):
    rows = spark.createDataFrame([(1, "column by column, carry the 1", False), (2, "  ", False), (3, None, True), (4, "hidden column carry", True), (5, "zzz", False)], "id int, trace string, contaminated boolean")
    centroids = spark.createDataFrame([("OT", [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), ("DD", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "label string, centroid array<double>")
    got = {r["id"]: r for r in prototypes.trace_signals(rows, Counting(), centroids).collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["ok", "trace_missing", "trace_missing", "contaminated_trace", "ok"]
    assert [got[i]["resolved"] for i in range(1, 6)] == [True, False, False, False, True]
    assert got[1]["trace_label"] == "OT" and got[4]["trace_label"] == "OT" and got[2]["trace_label"] is None and got[5]["trace_label"] is None
    assert got[1]["embedding_label"] in ("OT", "DD") and got[4]["embedding_label"] is None and got[4]["embedding_margin"] is None
    bare = prototypes.trace_signals(rows).filter("id = 1").first()
    assert bare["trace_label"] == "OT" and bare["status"] is None and bare["resolved"] is None


def test_mock_outputs_follow_their_chances(spark):
    p = spark.range(4000).select(F.concat(F.lit("p"), "id").alias("id"), (F.col("id") + 500).alias("product"), F.lit("OT").alias("design_family"), F.lit(1.0).alias("ot_score"), F.lit(0.0).alias("dd_score"), F.lit(0.0).alias("rc_score"))
    rows = generation.mock_outputs(p)
    r = rows.agg(F.avg((F.col("detected") == "OT").cast("int")).alias("ot"), F.avg(F.when(F.col("detected") == "OT", F.col("is_correct").cast("int"))).alias("right"), F.avg("loss_ot").alias("mean"), F.stddev("loss_dd").alias("dev")).first()
    assert r["ot"] > 0.99 and 0.82 < r["right"] < 0.88 and abs(r["mean"] - 1.5) < 0.01 and abs(r["dev"] - 0.1) < 0.01
    assert {x[0] for x in rows.filter("not is_correct").select(F.col("model_answer") - F.col("product")).distinct().collect()} == {10, -10, 1, -1, 100}
    assert rows.filter("is_correct and model_answer <> product").count() == 0
