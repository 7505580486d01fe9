"""What is costly is worked out once a row, and what one task reads doesn't grow with the table."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import digits, templates, text
from tallyforge.operators import prototypes, selection
from tallyforge.sources import readers, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signals_search_each_trace_once(spark):
    rows = spark.createDataFrame([("p", "carry the column", False)], "id string, trace string, contaminated boolean")
    centroids = spark.createDataFrame([("OT", [1.0] * 8)], "label string, centroid array<double>")
    assert plan(prototypes.trace_signals(rows, prototypes.Letters(), centroids)).count("decompos[ei]") == 1


def test_numbers_in_texts(spark):
    cases = [(text.say("%d: %+d, %+d, %+d and %s", *(F.lit(n) for n in (7, -3, 0, 12)), F.lit("x")), "7: -3, +0, +12 and x"), (text.say("%d%d", F.lit(None).cast("int"), F.lit(1)), "null1")]
    assert [spark.range(1).select(c).first()[0] for c, _ in cases] == [want for _, want in cases]
    with pytest.raises(ValueError):
        text.say("%d", F.lit(1), F.lit(2))


def test_contaminated_is_what_answers_say(spark):
    said = ["47 by 53 is 2,491", "we get **9,999**", "", "  ", None, "__47__", "4,7"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    got = rows.select(text.contaminated(F.col("t"), F.lit(47), F.lit(53)).alias("c"), text.extract_answer(F.col("t"), F.lit(47), F.lit(53))["contaminated"].alias("e")).collect()
    assert [r["c"] for r in got] == [r["e"] for r in got] == [False, True, False, False, False, False, False]


def test_steps_hold_each_number_once(spark):
    pairs = spark.range(1).selectExpr("id as a", "id as b").select(templates.step_pairs(F.col("a"), F.col("b"), profile="harder"))
    assert len(plan(pairs)) < 100_000  # 350,000 when every statement worked out its own numbers


@pytest.mark.parametrize("n,want", [(0, 10), (1, 0), (9, 8), (10, 20), (100, 200), (110, 100), (1000, 2000), (9990, 9980), (-30, 20), (10**17, 2 * 10**17), (123 * 10**15, 122 * 10**15)])
def test_nearby_wrong(spark, n, want):
    assert spark.range(1).select(digits.nearby_wrong(F.lit(n).cast("bigint"))).first()[0] == want


def test_answers_are_read_once(spark):
    df = spark.createDataFrame([("so 12 it is", 3, 4)], "t string, a bigint, b bigint").select(text.extract_answer(F.col("t"), F.col("a"), F.col("b"), exact=True).alias("e"))
    assert plan(df).count("mathbf") <= 4  # of one strategy: its pattern and hint


def test_training_texts_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(i):
        seen.add(1)
        return f"Step {i}" if i % 2 else ""

    rows = spark.range(20).select(F.lit("DD").alias("heuristic"), F.col("id").alias("ord"), F.lit("train").alias("split"), said("id").alias("reasoning_trace"))
    assert [r["wording"] for r in selection.training_texts(rows, ["DD"], most=3).collect()] == ["Step <NUM>"] * 3
    assert seen.value == 20


def test_csv_files_do_not_grow_with_the_table(spark, tmp_path):
    df = spark.range(95, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.lit("two\nlines").alias("note"))
    sinks.write_csv(df, str(tmp_path / "many"), most=10)
    assert len(list((tmp_path / "many").glob("*.csv"))) == 10
    back = readers.read_csv(spark, str(tmp_path / "many"), "id string, note string").collect()
    assert sorted(int(r["id"]) for r in back) == list(range(95)) and {r["note"] for r in back} == {"two\nlines"}
    sinks.write_csv(df, str(tmp_path / "one"), one_file=True, most=10)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
