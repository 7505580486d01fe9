"""Hand-picked problems with the method that they are meant for, and what the costs say of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import digits as D

# Fixed values: (a, b, method, category, notes), and the margins of a curated and of any other item.
SPECS = (
    (49, 51, "RC", "near_50_symmetric", "49×51 = 50²-1 = 2499"), (48, 52, "RC", "near_50_2off", "Both 2 away from 50"), (47, 53, "RC", "near_50_3off", "Control: 3 away from 50"),
    (99, 101, "RC", "near_100_symmetric", "99×101 = 100²-1 = 9999"), (98, 102, "RC", "near_100_2off", "Both 2 away from 100"), (97, 103, "RC", "near_100_3off", "Control: 3 away from 100"),
    (199, 201, "RC", "near_200_symmetric", "199×201 = 200²-1"), (198, 202, "RC", "near_200_2off", "Both 2 away from 200"), (49, 102, "RC", "near_50_and_100", "One near 50, one near 100"), (51, 98, "RC", "near_50_and_100_v2", "Variant"),
    (47, 60, "DD", "zero_factor", "47×60 = 47×6×10"), (73, 40, "DD", "zero_factor", "73×40 = 73×4×10"), (58, 30, "DD", "zero_factor", "58×30 = 58×3×10"), (62, 50, "DD", "zero_factor_50", "62×50 = 62×5×10"), (84, 20, "DD", "zero_factor", "84×20 = 84×2×10"),
    (37, 100, "DD", "hundred_factor", "37×100 = 3700"), (64, 200, "DD", "two_hundred_factor", "64×200"), (48, 25, "DD", "quarter_hundred", "48×25 = 48×100÷4 = 1200"), (76, 25, "DD", "quarter_hundred", "76×25 = 76×100÷4 = 1900"),
    (45, 36, "DD", "clean_decomp", "45×36 = (40+5)×36"), (55, 44, "DD", "clean_decomp", "55×44 = 55×(40+4)"),
    (87, 96, "OT", "carry_heavy", "Multiple carries expected"), (79, 68, "OT", "carry_heavy", "7×8=56, 9×6=54, etc."), (58, 76, "OT", "carry_heavy", "8×6=48, 5×7+4=39"), (89, 47, "OT", "carry_heavy", "9×7=63, 8×4+6=38"),
    (67, 83, "OT", "carry_heavy", "7×3=21, 6×8+2=50"), (78, 94, "OT", "carry_heavy", "8×4=32, 7×9+3=66"), (69, 57, "OT", "carry_heavy", "9×7=63, 6×5+6=36"),
    (43, 67, "OT", "generic", "No special pattern"), (56, 38, "OT", "generic", "No special pattern"), (72, 49, "OT", "generic", "49 near 50 but 72 isn't"),
    (46, 54, "RC", "perturb_base", "Near 50 - should favor RC"), (44, 56, "OT", "perturb_control", "Control: farther from base"), (45, 55, "RC", "perturb_base", "Balanced around 50"),
    (73, 60, "DD", "perturb_zero", "Has zero - should favor DD"), (73, 59, "OT", "perturb_control", "Control: no zero"), (73, 61, "OT", "perturb_control", "Control: no zero"),
)
CURATED_MARGIN, ITEM_MARGIN = 0.5, 0.75
VALUES, DIGITS, COMPLEXITY = (10, 999_999_999), (2, 9), (12, 324)


def specs(spark: SparkSession) -> DataFrame:
    """nth, a, b, expected, category, notes."""
    quoted = lambda s: '"' + s + '"'
    rows = ", ".join(f"({i}, {a}L, {b}L, '{k}', '{c}', {quoted(n)})" for i, (a, b, k, c, n) in enumerate(SPECS))
    return spark.sql(f"select * from values {rows} as t(nth, a, b, expected, category, notes)")


def costed(df: DataFrame, margin: float) -> DataFrame:
    """df (a, b) with costs, digit statistics, in_range, and target and margin of the cheapest method by a margin."""
    a, b = F.col("a"), F.col("b")
    inside = lambda n: n.between(*VALUES) & D.length(n).between(*DIGITS)
    df = df.withColumns({"ot_cost": D.ot_cost(a, b), "dd_cost": D.dd_cost(a, b), "rc_cost": D.rc_cost(a, b), "digit_total": D.digit_total(a, b), "nonzero_total": D.nonzero_total(a, b)})
    df = df.withColumn("complexity_c", F.col("digit_total") * F.col("nonzero_total")).withColumn("in_range", inside(a) & inside(b) & F.col("complexity_c").between(*COMPLEXITY))
    # exploded, one a row: a filter on the target would else be pushed into the costs, and all be worked out twice
    best = F.explode(F.array(D.rank_costs(F.col("ot_cost"), F.col("dd_cost"), F.col("rc_cost"), margin))).alias("best")
    return df.select("*", best).withColumns({"target": F.col("best.target"), "margin": F.col("best.margin")}).drop("best")


def items(df: DataFrame, margin: float = ITEM_MARGIN, family: str | None = None) -> DataFrame:
    """Of problems (a, b, ...) those in range that one method is cheapest for by a margin; family: the column that names the design family, else the target does."""
    out = costed(df, margin).filter("in_range and target is not null").withColumn("product", F.col("a") * F.col("b"))
    return out.withColumn("design_family", F.coalesce(F.nullif(F.col(family), F.lit("")), F.col("target")) if family else F.col("target")).drop("in_range")


def audit(rows: DataFrame, override: bool = False) -> DataFrame:
    """Curated rows (nth, a, b, expected, ...), the first of each pair of factors, with `scored` (null if out of range or without a margin), verdict
    (item, mismatch, out_of_range, and with override: overridden) and notes, to which an override adds what was scored."""
    pair = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("nth")
    one = rows.withColumn("rank", F.row_number().over(pair)).filter("rank = 1").drop("rank")
    got = costed(one, CURATED_MARGIN).withColumn("scored", F.when(F.col("in_range"), F.col("target"))).drop("target", "margin")
    same = F.coalesce(F.col("scored") == F.col("expected"), F.lit(False))
    verdict = F.when(~F.col("in_range"), "out_of_range").when(same, "item").otherwise("overridden" if override else "mismatch")
    added = F.format_string("%s | curated_override expected %s, scored %s", "notes", "expected", F.coalesce("scored", F.lit("NONE")))
    return got.withColumn("verdict", verdict).withColumn("notes", F.when(F.col("verdict") == "overridden", added).otherwise(F.col("notes")))
