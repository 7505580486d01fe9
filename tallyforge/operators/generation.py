"""Problem tables from quotas: candidates are expressions of a counter and hashes, so any executor makes its own rows."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.functions import hashing as H
from tallyforge.functions import text as T
from tallyforge.operators import quotas as Q
from tallyforge.operators.joins import without_leaks
from tallyforge.operators.selection import unit


def _u(salt: int, *key: Column) -> Column:
    """A number in [0, 1) of hashes."""
    return F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1 << 40)) / float(1 << 40)


def _pick(low: Column, high: Column, u: Column) -> Column:
    return (low + F.floor(u * (high - low + 1))).cast("bigint")


def _number(salt: int, key: Column, length: Column, nonzero: Column) -> Column:
    """A number of a length with so many non-zero digits, the first among them: the places of least hash get digits 1 to 9."""
    places = F.array_sort(F.transform(F.sequence(F.lit(2), F.greatest(length, F.lit(2))), lambda p: F.struct(F.xxhash64(F.lit(salt), key, p).alias("h"), p.alias("p"))))
    chosen = F.transform(F.slice(places, 1, F.greatest(nonzero - 1, F.lit(0))), lambda x: x["p"])
    digit = lambda p: F.when((p == 1) | F.array_contains(chosen, p), 1 + F.floor(_u(salt + 1, key, p) * 9)).otherwise(0).cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(1), length), digit), "").cast("bigint")


def grid(spark: SparkSession, count: int = 10_000, seed: int = 42, mean: float = 182.0, band: tuple[int, int] = (10, 324)) -> DataFrame:
    """count distinct problems over all reachable complexities with a given mean, split within strata; shuffled ids mm_00000, ..."""
    strata = Q.reachable(band)
    caps = {c: sum(Q.capacity(d, n) for d, n in s) for c, s in strata.items()}
    plan = []
    for c, n in Q.by_complexity(count, caps, mean).items():
        for (d, z), q in Q.even({s: Q.capacity(*s) for s in strata[c]}, n).items():
            if q:
                plan.append((d, z, q, min(Q.capacity(d, z), 1 << 40)))
    rows = ", ".join(f"({d}, {z}, {q}, {c}L, array({', '.join(f'struct({w}, {x}, {y}, {v})' for w, x, y, v in Q.splits(d, z))}))" for d, z, q, c in plan)
    plan_df = spark.sql(f"select * from values {rows} as t(digit_total, nonzero_total, quota, capacity, ways)")
    # many more draws than rows of a stratum, most where there are few pairs: an expected shortfall of less than one in a billion
    tries = (8 * F.col("quota") + F.when(F.col("capacity") < 50 * F.col("quota"), 30 * F.col("capacity")).otherwise(40)).cast("int")
    df = plan_df.withColumn("i", F.explode(F.sequence(F.lit(1), tries)))
    key = F.struct("digit_total", "nonzero_total", "i")
    way = F.get(F.col("ways"), F.floor(_u(seed, key) * F.size("ways")).cast("int"))
    df = df.withColumn("w", way).withColumns({"x": _number(seed + 1, key, F.col("w.col1"), F.col("w.col2")), "y": _number(seed + 3, key, F.col("w.col3"), F.col("w.col4"))})
    swap = _u(seed + 5, key) < 0.5
    df = df.withColumns({"a": F.when(swap, F.col("y")).otherwise(F.col("x")), "b": F.when(swap, F.col("x")).otherwise(F.col("y"))})
    one = df.withColumn("nth", F.row_number().over(Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("i"))).filter("nth = 1")
    got = one.withColumn("rank", F.row_number().over(Window.partitionBy("digit_total", "nonzero_total").orderBy("i"))).filter("rank <= quota")
    got = got.withColumn("order", F.xxhash64(F.lit(seed + 7), "a", "b"))
    numbered = got.withColumn("id", F.concat(F.lit("mm_"), F.lpad((F.row_number().over(Window.orderBy("order", "a", "b")) - 1).cast("string"), 5, "0")))  # `count` rows, which the caller names
    stratum = D.stratum(F.col("a"), F.col("b"))
    template = lambda n: F.regexp_replace(n.cast("string"), "[1-9]", "D")
    return numbered.select(
        "id", "a", "b", (F.col("a") * F.col("b")).alias("a_times_b"), template(F.col("a")).alias("template_a"), template(F.col("b")).alias("template_b"), D.length(F.col("a")).alias("digits_a"), D.length(F.col("b")).alias("digits_b"),
        D.nonzero(F.col("a")).alias("nonzero_a"), D.nonzero(F.col("b")).alias("nonzero_b"), "digit_total", "nonzero_total", (F.col("digit_total") * F.col("nonzero_total")).alias("complexity_c"), stratum.alias("stratum_id"), H.stratified_split(stratum, F.col("id")).alias("split"),
    )


def _pool(spark: SparkSession, family: str, n: int, seed: int) -> DataFrame:
    """Candidates of a family: near a round base, with few non-zero digits, or of many digits that carry."""
    df = spark.range(n).select(F.col("id").alias("i"))
    i = F.col("i")
    d1, d2 = _pick(F.lit(2), F.lit(9), _u(seed, i)), _pick(F.lit(2), F.lit(9), _u(seed + 1, i))
    if family == "RC":
        bases = F.array(*(F.lit(x).cast("bigint") for x in D.scaled_bases()))
        base = F.get(bases, F.floor(_u(seed + 2, i) * F.size(bases)).cast("int"))
        scale = D.power10(F.greatest(D.length(base) - 2, F.lit(0)))
        off = lambda s: _pick(F.lit(-10), F.lit(10), _u(s, i)) * F.when(_u(s + 1, i) < 0.5, scale).otherwise(1)
        a, b = base + off(seed + 3), base + off(seed + 5)
    elif family == "DD":
        few = lambda s, d: _number(s, i, d.cast("int"), _pick(F.lit(1), F.least(d, F.lit(3)), _u(s + 7, i)).cast("int"))
        a, b = few(seed + 20, d1), _number(seed + 40, i, d2.cast("int"), _pick(F.lit(1), d2, _u(seed + 8, i)).cast("int"))
    else:
        full = lambda s, d: _number(s, i, d.cast("int"), d.cast("int"))
        a, b = full(seed + 60, d1), full(seed + 80, d2)
    return df.select(a.alias("a"), b.alias("b")).filter("a between 10 and 999999999 and b between 10 and 999999999")


def _enough(make: Callable[[int], DataFrame], n: int, pool: int, doublings: int = 6) -> DataFrame:
    """make(pool) from a pool that is doubled until n rows come of it."""
    for k in range(doublings + 1):
        df = make(pool << k)
        if (got := df.limit(n).count()) == n:
            return df
    raise ValueError(f"{got} of {n} rows come of a pool of {pool << doublings}")


def scored(df: DataFrame) -> DataFrame:
    """a, b with costs, complexity and the cheapest label by a margin of 0.75."""
    a, b = F.col("a"), F.col("b")
    df = df.withColumns({"ot_cost": D.ot_cost(a, b), "dd_cost": D.dd_cost(a, b), "rc_cost": D.rc_cost(a, b), "digit_total": D.digit_total(a, b), "nonzero_total": D.nonzero_total(a, b)}).withColumn("complexity_c", F.col("digit_total") * F.col("nonzero_total"))
    best = D.rank_costs(F.col("ot_cost"), F.col("dd_cost"), F.col("rc_cost"), 0.75)
    return df.withColumn("best", best).withColumns({"canonical_target_heuristic": F.col("best.target"), "canonical_target_margin": F.col("best.margin")}).drop("best")


def hds(spark: SparkSession, count: int = 1000, seed: int = 42, pool: int = 40_000, exclude: DataFrame | None = None) -> DataFrame:
    """count problems, a third of each family (the rest RC): cost winners in the complexity band, each family's spread over bands; from a pool a family, or a larger one if need be."""
    third = count // 3
    want = {"RC": count - 2 * third, "DD": third, "OT": third}

    def winners(family: str, j: int, size: int) -> DataFrame:
        # one of each pair first: the factors are columns from here on, not expressions that costs would repeat
        df = _pool(spark, family, size, seed + 1000 * j).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        df = scored(df.groupBy("lo", "hi").agg(F.min("a").alias("a")).withColumn("b", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))))
        df = df.filter((F.col("canonical_target_heuristic") == family) & F.col("complexity_c").between(12, 324))
        return df if exclude is None else without_leaks(df, exclude, None).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})

    parts = []
    for j, (family, n) in enumerate(want.items()):
        df = _enough(lambda size, family=family, j=j: winners(family, j, size), n, pool)
        # the next of each band in turn, so that bands are as even as the pool allows
        df = df.withColumn("band", D.band(F.col("complexity_c"))).withColumn("turn", F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64(F.lit(seed), "lo", "hi"))))
        parts.append(df.orderBy("turn", "band", "lo", "hi").limit(n).withColumn("design_family", F.lit(family)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = Window.orderBy("canonical_target_heuristic", "design_family", "complexity_c", "a", "b")  # `count` rows
    out = out.withColumn("id", F.concat(F.lit("hds_"), F.lpad((F.row_number().over(order) - 1).cast("string"), 3, "0")))
    return out.withColumns({"product": F.col("a") * F.col("b"), "split": H.hash_split(F.col("id"))}).drop("lo", "hi", "turn")


# The traps of each kind: (kind, label that they are hard for, expected error, pairs).
TRAPS = (
    ("carry_bomb", "OT", "off_by_power_of_10", ((99, 99), (989, 979), (8999, 7888), (98999, 97888), (899999, 788888), (9899999, 9788888), (89999999, 78888888), (989999999, 878888888))),
    ("missing_term", "DD", "off_by_partial_product", ((67, 43), (876, 543), (7654, 4321), (87654, 54321), (765432, 432167), (8765432, 5432167), (76543218, 43216754), (876543219, 543216789))),
    ("anti_round", "RC", "inefficient_or_wrong_base", ((43, 32), (764, 583), (4876, 6132), (76438, 58321), (487631, 613247), (7643821, 5832167), (48763124, 61324789), (764382159, 583216497))),
    ("sign_trap", "RC", "wrong_compensation_sign", ((49, 52), (101, 98), (1001, 998), (10001, 9998), (1000001, 999998), (109999999, 89000001))),
)


def traps(spark: SparkSession, exclude: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """8, 8, 8 and 6 traps; those whose problem is excluded are replaced by generated ones of their kind."""
    values = ", ".join(f"({a}L, {b}L, '{kind}', '{label}', '{error}', {i})" for kind, label, error, pairs in TRAPS for i, (a, b) in enumerate(pairs))
    fixed = spark.sql(f"select * from values {values} as t(a, b, trap_type, target_heuristic, expected_error_type, ord)")
    spare = None
    for j, (kind, label, error, _) in enumerate(TRAPS):
        i = F.col("i")
        if kind == "sign_trap":
            base = F.get(F.array(*(F.lit(x).cast("bigint") for x in D.scaled_bases())), F.floor(_u(seed, i) * len(D.scaled_bases())).cast("int"))
            a, b = base + _pick(F.lit(1), F.lit(10), _u(seed + 1, i)), base - _pick(F.lit(1), F.lit(10), _u(seed + 2, i))
            df = spark.range(400).select(F.col("id").alias("i")).select(a.alias("a"), b.alias("b"), (100 + i).cast("int").alias("ord"))
        else:
            df = _pool(spark, "OT", 400, seed + 10 * j).withColumn("ord", (100 + F.monotonically_increasing_id() % 10_000).cast("int"))
            df = df.filter("a % 5 <> 0 and b % 5 <> 0") if kind != "carry_bomb" else df.filter(F.forall(D.digits(F.col("a")), lambda d: d >= 4))
        df = df.select("a", "b", F.lit(kind).alias("trap_type"), F.lit(label).alias("target_heuristic"), F.lit(error).alias("expected_error_type"), "ord").filter("a between 10 and 999999999 and b between 10 and 999999999")
        spare = df if spare is None else spare.unionByName(df)
    rows = fixed.unionByName(spare)
    if exclude is not None:
        rows = without_leaks(rows, exclude, None)
    quota = F.when(F.col("trap_type") == "sign_trap", 6).otherwise(8)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trap_type").orderBy("ord", "a", "b"))).filter(F.col("rank") <= quota)
    rows = rows.withColumn("id", F.concat(F.lit("trap_"), F.lpad((F.row_number().over(Window.orderBy("trap_type", "rank")) - 1).cast("string"), 3, "0")))
    return scored(rows).drop("rank", "ord").withColumn("product", F.col("a") * F.col("b"))


def training_traces(spark: SparkSession, label: str, count: int = 100, exclude: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Worked solutions of one method, of problems that aren't excluded: id, a, b, product, heuristic, prompt, reasoning_trace, full_text, split."""

    def candidates(size: int) -> DataFrame:
        pool = _pool(spark, {"STYLE": "OT"}.get(label, label), size, seed).filter("a < 10000 and b < 10000")
        if exclude is not None:
            pool = without_leaks(pool, exclude, None)
        return pool.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"])

    pool = _enough(candidates, count, 20 * count).orderBy(F.xxhash64(F.lit(seed), "lo", "hi"), "lo", "hi").limit(count)
    rows = pool.withColumn("id", F.concat(F.lit(f"{label.lower()}_gen_"), F.lpad((F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "lo", "hi"), "lo", "hi")) - 1).cast("string"), 4, "0")))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("id", "a", "b", (a * b).alias("product"), F.lit(label).alias("heuristic"), T.prompt(a, b).alias("prompt"), T.TRACES[label](a, b).alias("full_text"))
    split = H.hash_split(F.col("id"))
    return rows.withColumn("reasoning_trace", T.strip_prompt(F.col("prompt"), F.col("full_text"))).withColumn("split", F.when(split == "test", "val").otherwise(split))


def mock_outputs(problems: DataFrame, seed: int = 42) -> DataFrame:
    """problems (id, product, design_family, ot_score, dd_score, rc_score) with what a model could have said of them: losses of 2, less half the
    method's score, with noise of deviation 0.1; the label of the least loss (of two OT before DD before RC); right with a chance of 0.85 where that is the
    family, else 0.65; wrong by 10 or 100 too many, 10 too few, or 1. Chances are hashes of ids: each run says the same."""
    key = F.col("id")
    unit_ = lambda name: unit(f"{seed}:{name}", key)
    noise = lambda k: F.sqrt(F.lit(-2.0) * F.log(unit_(f"r{k}"))) * F.cos(F.lit(2 * pi) * unit_(f"a{k}")) * 0.1
    loss = {k: F.lit(2.0) - F.col(f"{k}_score") * 0.5 + noise(k) for k in ("ot", "dd", "rc")}
    out = problems.withColumns({f"loss_{k}": v for k, v in loss.items()})
    least = F.least("loss_ot", "loss_dd", "loss_rc")
    out = out.withColumn("detected", F.when(F.col("loss_ot") == least, "OT").when(F.col("loss_dd") == least, "DD").otherwise("RC"))
    right = unit_("right") < F.when(F.col("detected") == F.col("design_family"), 0.85).otherwise(0.65)
    off = F.get(F.array(*(F.lit(x) for x in (10, -10, 1, -1, 100))), F.floor(unit_("off") * 5).cast("int"))
    return out.withColumn("is_correct", right).withColumn("model_answer", F.when(F.col("is_correct"), F.col("product")).otherwise(F.col("product") + off))
