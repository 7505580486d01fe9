"""Benchmark tables derived from the order tables by fixed formulas, for Spark and, as common table expressions, for SQL.

problems: two factors of an order's keys; outputs: answers and losses that reach every branch of the operators; variants: what
an adapted model answers; template_losses: a loss for each of four templates of each label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.functions import hashing as H
from tallyforge.functions import text as T

LABELS = ("DD", "OT", "RC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df's rows over all cores where its files are fewer: a shuffle of the narrow columns that are left, so that what is worked out of them isn't one task's job."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, df.columns[0]) if len(df.inputFiles()) < n else df


def draw(salt: str, key: Column, n: int = 10_000) -> Column:
    """A fixed number below n for each key."""
    return H.md5_bucket(F.concat(F.lit(salt + ":"), key), n)


def _one_of(labels, i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in labels)), i + 1)


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    a = 10 + (F.col("o_orderkey") * 7919) % D.power10(1 + (F.col("o_orderkey") % 8).cast("int"))
    b = 10 + ((F.col("o_custkey") + 1) * 104729) % D.power10(1 + (F.floor(F.col("o_orderkey") / 8) % 8).cast("int"))
    df = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("p_"), F.col("o_orderkey")).alias("id"), a.alias("a"), b.alias("b"))
    df = df.withColumns({"product": F.col("a") * F.col("b"), "design_family": _one_of(LABELS, draw("7", F.col("id"), 3)), "canonical_target": _one_of(LABELS, draw("8", F.col("id"), 3)), "split": H.hash_split(F.col("id"))})
    return df.withColumns({"digit_total": D.digit_total(F.col("a"), F.col("b")), "nonzero_total": D.nonzero_total(F.col("a"), F.col("b"))}).withColumn("complexity_c", F.col("digit_total") * F.col("nonzero_total")).withColumn("band", D.band(F.col("complexity_c")))


def _answer(salt: str, key: Column) -> Column:
    a, b, p = (F.col(x).cast(D.BIG) for x in ("a", "b", "product"))
    kind = draw(salt, key, 8)
    return (
        F.when(kind == 0, p).when(kind == 1, (p * 10).cast(D.BIG)).when(kind == 2, p - 10).when(kind == 3, (a * (b - b % 10)).cast(D.BIG))
        .when(kind == 4, D.no_carry_product(F.col("a"), F.col("b"))).when(kind == 5, F.reverse(F.col("product").cast("string")).cast(D.BIG)).when(kind == 6, p + 1)
    ).cast(D.BIG)


def _loss(salt: str, key: Column) -> Column:
    n = draw(salt, key)
    # a sum, not a choice of two: what both parts need is then drawn once a row
    return 5.0 + n / 2500.0 + F.when(n % 37 == 0, F.lit(float("inf"))).otherwise(0.0)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problems with model_answer, loss_ot, loss_dd, loss_rc, loss_neutral and is_correct."""
    key = F.col("id")
    neutral = F.when(draw("n", key, 43) != 0, _loss("neutral", key))
    df = problems(spark, sf_dir).withColumns({"model_answer": _answer("9", key), "loss_ot": _loss("ot", key), "loss_dd": _loss("dd", key), "loss_rc": _loss("rc", key), "loss_neutral": neutral})
    return df.withColumn("is_correct", F.coalesce(F.col("model_answer") == F.col("product"), F.lit(False)))


ADAPTERS = ("DD", "OT", "RC", "STYLE")


def variants(spark: SparkSession, sf_dir: str, base_kind: bool = False) -> DataFrame:
    """A row for each problem and adapter: what it answers, whether that is known to be right, and the label found. base_kind: with the base answer's
    error kind. What is of the problem alone is worked out before there is a row for each adapter."""
    key = F.concat_ws("|", "lora", "id")
    detected = (*LABELS, "UNKNOWN")
    df = problems(spark, sf_dir).withColumns({"base_answer": _answer("9", F.col("id")), "base_detected": _one_of(detected, draw("d", F.col("id"), 4))}).withColumn("base_correct", F.col("base_answer") == F.col("product"))
    if base_kind:
        df = df.withColumn("base_kind", D.error_taxonomy(F.col("a"), F.col("b"), F.col("base_answer")))
    df = df.withColumn("lora", F.explode(F.array(*(F.lit(x) for x in ADAPTERS))))
    return df.withColumns({"lora_answer": _answer("v", key), "lora_detected": _one_of(detected, draw("d", key, 4))}).withColumn("lora_correct", F.col("lora_answer") == F.col("product"))


def template_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, design_family, label, template, loss."""
    df = problems(spark, sf_dir).select("id", "design_family", F.explode(F.array(*(F.lit(x) for x in LABELS))).alias("label")).withColumn("template", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return df.withColumn("loss", _loss("t", F.concat_ws("|", "label", F.col("template").cast("string"), "id")))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problems with a trace of the canonical target's method; every eighth problem's is plain."""
    df = problems(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    kind = F.when(draw("s", F.col("id"), 8) == 0, "STYLE").otherwise(F.col("canonical_target"))
    df = df.withColumns({"trace_label": kind, "ba": D.nearest_base(a, D.TRACE_BASES), "bb": D.nearest_base(b, D.TRACE_BASES)})
    of = {k: f(a, b, F.col("ba"), F.col("bb")) if k == "RC" else f(a, b) for k, f in T.TRACES.items()}
    return df.withColumn("trace", F.coalesce(*(F.when(F.col("trace_label") == k, t) for k, t in of.items()))).drop("ba", "bb")


# ---------------------------------------------------------------- the same in SQL


def s_bucket(x: str, n: int = 10_000) -> str:
    half = lambda i: f"(('0x' || substr(md5({x}), {i}, 16))::UBIGINT % {n})"
    return f"cast(({half(1)} * {2**64 % n} + {half(17)}) % {n} as int)"


def s_draw(salt: str, key: str, n: int = 10_000) -> str:
    return s_bucket(f"('{salt}:' || {key})", n)


def s_one_of(labels, i: str) -> str:
    return f"[{', '.join(repr(x) for x in labels)}][{i} + 1]"


def s_digits(n: str) -> str:
    return f"list_transform(string_split(cast(abs({n}) as varchar), ''), lambda ch: cast(ch as int))"


def s_nonzero(n: str) -> str:
    return f"length(replace(cast(abs({n}) as varchar), '0', ''))"


def s_split(x: str) -> str:
    b = s_draw("42", x)
    return f"case when {b} < 7000 then 'train' when {b} < 8500 then 'val' else 'test' end"


def s_band(c: str) -> str:
    return "case " + " ".join(f"when {c} between {lo} and {hi} then '{lo}-{hi}'" for lo, hi in D.BANDS) + " end"


def s_nocarry(a: str, b: str) -> str:
    return f"""cast(array_to_string(list_reverse(list_transform(range(0, len({s_digits(a)}) + len({s_digits(b)}) - 1), lambda p:
        cast(list_sum(list_transform(range(0, len({s_digits(a)})), lambda i: case when p - i >= 0 and p - i < len({s_digits(b)})
            then list_reverse({s_digits(a)})[i + 1] * list_reverse({s_digits(b)})[p - i + 1] else 0 end)) % 10 as varchar))), '') as decimal(38,0))"""


PROBLEMS = f"""k0 as (
  select o_orderkey as k, 'p_' || o_orderkey as id, 10 + (o_orderkey * 7919) % cast(pow(10, 1 + o_orderkey % 8) as bigint) as a,
    10 + ((o_custkey + 1) * 104729) % cast(pow(10, 1 + (o_orderkey // 8) % 8) as bigint) as b from orders
), k1 as (
  select *, a * b as product, {s_one_of(LABELS, s_draw("7", "id", 3))} as design_family, {s_one_of(LABELS, s_draw("8", "id", 3))} as canonical_target, {s_split("id")} as split,
    length(cast(a as varchar)) + length(cast(b as varchar)) as digit_total, {s_nonzero("a")} + {s_nonzero("b")} as nonzero_total from k0
), problems as (
  select *, digit_total * nonzero_total as complexity_c, {s_band("digit_total * nonzero_total")} as band from k1
)"""


def s_answer(salt: str, key: str) -> str:
    return f"""cast(case {s_draw(salt, key, 8)} when 0 then cast(product as decimal(38,0)) when 1 then cast(product as decimal(38,0)) * 10 when 2 then cast(product as decimal(38,0)) - 10
      when 3 then cast(a * (b - b % 10) as decimal(38,0)) when 4 then {s_nocarry("a", "b")} when 5 then cast(reverse(cast(product as varchar)) as decimal(38,0)) when 6 then cast(product as decimal(38,0)) + 1 end as decimal(38,0))"""


def s_loss(salt: str, key: str) -> str:
    return f"case when {s_draw(salt, key)} % 37 = 0 then 'inf'::double else 5.0::double + {s_draw(salt, key)} / 2500.0::double end"


OUTPUTS = f"""{PROBLEMS}, o1 as (
  select *, {s_answer("9", "id")} as model_answer, {s_loss("ot", "id")} as loss_ot, {s_loss("dd", "id")} as loss_dd, {s_loss("rc", "id")} as loss_rc,
    case when {s_draw("n", "id", 43)} <> 0 then {s_loss("neutral", "id")} end as loss_neutral from problems
), outputs as (select *, coalesce(model_answer = product, false) as is_correct from o1)"""

VARIANTS = f"""{PROBLEMS}, v1 as (
  select *, lora || '|' || id as vkey from problems cross join (select unnest({list(ADAPTERS)}) as lora)
), v2 as (
  select *, {s_answer("v", "vkey")} as lora_answer, {s_one_of((*LABELS, "UNKNOWN"), s_draw("d", "vkey", 4))} as lora_detected,
    {s_answer("9", "id")} as base_answer, {s_one_of((*LABELS, "UNKNOWN"), s_draw("d", "id", 4))} as base_detected from v1
), variants as (select *, base_answer = product as base_correct, lora_answer = product as lora_correct from v2)"""

TEMPLATES = f"""{PROBLEMS}, t1 as (
  select id, design_family, label, template, label || '|' || template || '|' || id as tkey from problems cross join (select unnest({list(LABELS)}) as label) cross join (select unnest(range(0, 4)) as template)
), template_losses as (select id, design_family, label, template, {s_loss("t", "tkey")} as loss from t1)"""


def _s_fmt(template: str, *args: str) -> str:
    return f"printf('{template}', {', '.join(args)})"


def s_nearest(n: str, bases) -> str:
    return f"list_sort([{', '.join(f'[abs({n} - {x}), {i}, {x}]' for i, x in enumerate(bases))}])[1][3]"


def s_traces() -> str:
    """Common table expressions down to `traces`."""
    sg = lambda x: f"case when {x} > 0 then '+' else '-' end"
    squares = [
        _s_fmt("What is %d × %d?", "a", "b"), "'Let me use the difference of squares identity.'", _s_fmt("%d = %d %s %d and %d = %d %s %d.", "a", "ba", sg("da"), "abs(da)", "b", "ba", sg("db"), "abs(da)"),
        _s_fmt("So %d × %d = (%d %s %d)(%d %s %d) = %d² - %d².", "a", "b", "ba", sg("da"), "abs(da)", "ba", sg("db"), "abs(da)", "ba", "abs(da)"),
        _s_fmt("%d² = %d.", "ba", "ba * ba"), _s_fmt("%d² = %d.", "abs(da)", "da * da"), _s_fmt("%d - %d = %d.", "ba * ba", "da * da", "product"), _s_fmt("Answer: %d", "product"),
    ]
    general = [
        _s_fmt("What is %d × %d?", "a", "b"), "'Let me round to convenient bases and adjust.'", _s_fmt("%d is close to %d (difference: %+d).", "a", "ba", "da"), _s_fmt("%d is close to %d (difference: %+d).", "b", "bb", "db"),
        _s_fmt("Start with %d × %d = %d.", "ba", "bb", "ba * bb"), _s_fmt("Adjustment for %d: %d × %+d = %+d.", "a", "ba", "db", "ba * db"), _s_fmt("Adjustment for %d: %+d × %d = %+d.", "b", "da", "bb", "da * bb"),
        _s_fmt("Cross term: %+d × %+d = %+d.", "da", "db", "da * db"), _s_fmt("Total: %d + (%+d) + (%+d) + (%+d) = %d.", "ba * bb", "ba * db", "da * bb", "da * db", "product"), _s_fmt("Answer: %d", "product"),
    ]
    left = lambda x: f"case when a >= b then printf('%d × %d', {x}, b) else printf('%d × %d', a, {x}) end"
    dd = [
        _s_fmt("What is %d × %d?", "a", "b"), _s_fmt("Let me decompose %d into %d + %d.", "n", "n - n % 10", "n % 10"), _s_fmt("First compute %s:", left("n - n % 10")), _s_fmt("%s = %d.", left("n - n % 10"), "(n - n % 10) * m"),
        _s_fmt("Then compute %s:", left("n % 10")), _s_fmt("%s = %d.", left("n % 10"), "(n % 10) * m"), "'Now sum the partial products:'", _s_fmt("%d + %d = %d.", "(n - n % 10) * m", "(n % 10) * m", "product"), _s_fmt("Answer: %d", "product"),
    ]

    def step(i: int, word: str, d: str) -> list[str]:
        o, t = f"(a % 10) * {d}", f"((a // 10) % 10) * {d}"
        return [_s_fmt(f"Step {i}: Multiply %d by {word} digit %d:", "a", d), _s_fmt("  %d × %d = %d, write %d, carry %d.", "a % 10", d, o, f"({o}) % 10", f"({o}) // 10"), _s_fmt("  %d × %d = %d, plus carry = %d.", "(a // 10) % 10", d, t, f"{t} + ({o}) // 10")]

    b0, b1, b2 = "(b % 10)", "((b // 10) % 10)", "((b // 100) % 10)"
    head = [_s_fmt("What is %d × %d?", "a", "b"), "'Let me use column multiplication step by step.'"]
    small = [*head, *step(1, "ones", b0), _s_fmt("  First partial product: %d.", f"a * {b0}"), *step(2, "tens", b1), _s_fmt("  Second partial product: %d (shifted by 10 = %d).", f"a * {b1}", f"a * {b1} * 10"),
        "'Step 3: Add partial products:'", _s_fmt("  %d + %d = %d.", f"a * {b0}", f"a * {b1} * 10", "product"), _s_fmt("Answer: %d", "product")]
    q2, q3 = f"case when b >= 10 then a * {b1} * 10 else 0 end", f"case when b >= 100 then a * {b2} * 100 else 0 end"
    large = [*head, _s_fmt("Step 1: %d × %d = %d", "a", b0, f"a * {b0}"), f"case when b >= 10 then {_s_fmt('Step 2: %d × %d0 = %d', 'a', b1, q2)} end", f"case when b >= 100 then {_s_fmt('Step 3: %d × %d00 = %d', 'a', b2, q3)} end",
        _s_fmt("Sum: %d + %d + %d = %d.", f"a * {b0}", q2, q3, "product"), _s_fmt("Answer: %d", "product")]
    style = [_s_fmt("What is %d × %d?", "a", "b"), "'Let me organize the work clearly.'", _s_fmt("Step 1: Keep the problem in standard form: %d × %d.", "a", "b"), "'Step 2: Compute the exact product carefully.'", _s_fmt("Step 3: The exact product is %d.", "product"), _s_fmt("Answer: %d", "product")]
    ws = lambda parts: f"concat_ws(chr(10), {', '.join(parts)})"
    return f"""{PROBLEMS}, r1 as (
      select *, case when {s_draw("s", "id", 8)} = 0 then 'STYLE' else canonical_target end as trace_label, {s_nearest("a", D.TRACE_BASES)} as ba, {s_nearest("b", D.TRACE_BASES)} as bb, greatest(a, b) as n, least(a, b) as m from problems
    ), r2 as (select *, a - ba as da, b - bb as db from r1), traces as (
      select *, case trace_label when 'RC' then case when ba = bb and da = -db then {ws(squares)} else {ws(general)} end when 'DD' then {ws(dd)}
        when 'OT' then case when a < 100 and b < 100 then {ws(small)} else {ws(large)} end else {ws(style)} end as trace from r2
    )"""
