"""Queries on digits, costs and error kinds of problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import digits as D
from tallyforge.functions import hashing as H
from tallyforge.operators import joins as J
from tallyforge.operators import statistics as S
from tallyforge.plans import views as V
from tallyforge.plans.registry import query

_len = lambda x: f"length(cast(abs({x}) as varchar))"
_tz = lambda x, zero=0: f"case when {x} = 0 then {zero} else length(regexp_extract(cast(abs({x}) as varchar), '0+$')) end"


@query("m0_band_split_accuracy", f"""with {V.OUTPUTS} select band, split, count(*) as n, avg(case when is_correct then 1.0 else 0.0 end) as accuracy, avg(cast(complexity_c as double)) as mean_c,
    sqrt(avg(case when is_correct then 1.0::double else 0.0 end) * (1 - avg(case when is_correct then 1.0::double else 0.0 end)) / count(*)) as accuracy_se from outputs group by band, split""")
def band_split_accuracy(spark, sf):
    rows = V.outputs(spark, sf)
    return rows.groupBy("band", "split").agg(F.count("*").alias("n"), S.rate(F.col("is_correct")).alias("accuracy"), F.avg("complexity_c").alias("mean_c"), S.binary_se(F.col("is_correct")).alias("accuracy_se"))


@query("math01_digit_stats", f"with {V.PROBLEMS} select id, digit_total, nonzero_total, complexity_c, 'd' || digit_total || '_nz' || nonzero_total as stratum_id from problems")
def digit_stats(spark, sf):
    return V.problems(spark, sf).select("id", "digit_total", "nonzero_total", "complexity_c", D.stratum(F.col("a"), F.col("b")).alias("stratum_id"))


@query("math02_pair_key", f"with {V.PROBLEMS} select least(a, b) || ':' || greatest(a, b) as pair_key, count(*) as n from problems group by 1")
def pair_key(spark, sf):
    return V.problems(spark, sf).groupBy(D.pair_key(F.col("a"), F.col("b")).alias("pair_key")).agg(F.count("*").alias("n"))


@query("math03_digit_length", f"with {V.PROBLEMS} select {_len('a')} as digits_a, {_len('b')} as digits_b, count(*) as n, max(greatest({_len('a')}, {_len('b')})) as most from problems group by 1, 2")
def digit_length(spark, sf):
    return V.problems(spark, sf).groupBy(D.length(F.col("a")).alias("digits_a"), D.length(F.col("b")).alias("digits_b")).agg(F.count("*").alias("n"), F.max(F.greatest(D.length(F.col("a")), D.length(F.col("b")))).alias("most"))


@query("math04_trailing_zeros", f"with {V.PROBLEMS} select id, {_tz('a')} as tz_a, {_tz('b', 1)} as tz_b, {_tz('(a % 10)')} as tz_digit, {_tz('(a % 10)', 1)} as tz_digit_client from problems")
def trailing_zeros(spark, sf):
    return V.problems(spark, sf).select("id", D.trailing_zeros(F.col("a")).alias("tz_a"), D.trailing_zeros(F.col("b"), 1).alias("tz_b"), D.trailing_zeros(F.col("a") % 10).alias("tz_digit"), D.trailing_zeros(F.col("a") % 10, 1).alias("tz_digit_client"))


@query("math05_place_values", f"""with {V.PROBLEMS} select id, array_to_string(list_filter(list_transform(range(0, {_len('a')}), lambda i: ((a // cast(pow(10, i) as bigint)) % 10) * cast(pow(10, i) as bigint)), lambda x: x <> 0), ',') as terms,
    {V.s_nonzero('a')} as n_terms from problems""")
def place_values(spark, sf):
    return V.problems(spark, sf).select("id", F.array_join(D.place_values(F.col("a")).cast("array<string>"), ",").alias("terms"), D.nonzero(F.col("a")).alias("n_terms"))


_CARRY = f"cast(list_sum(list_transform({V.s_digits('a')}, lambda x: len(list_filter({V.s_digits('b')}, lambda y: x * y >= 10)))) as int)"
_OT = f"({_len('a')} * {_len('b')} + 0.25::double * {_CARRY} / ({_len('a')} * {_len('b')}))"


def _expand(f: str, o: str, extra: float) -> str:
    return f"(greatest({V.s_nonzero(f)}, 1) * {_len(o)} + greatest({V.s_nonzero(f)}, 1) - 1 + {extra}::double)"


def _sided(f: str, o: str) -> str:
    return f"""least({_expand(f, o, 0.0)}, case when {f} % 10 = 0 then {_expand(f"({f} // cast(pow(10, {_tz(f)}) as bigint))", o, 0.25)} else 1e9 end,
        case when {f} % 25 = 0 then {_expand(f"({f} // 25)", o, 1.0)} when {f} % 5 = 0 then {_expand(f"({f} // 5)", o, 1.5)} else 1e9 end)"""


_DD = f"least({_sided('a', 'b')}, {_sided('b', 'a')})"
_BASES = "[" + ", ".join(f"{{'base': {x}, 'scale': {D._scale(x)}::double}}" for x in D.scaled_bases()) + "]"
_RC = f"""list_min(list_transform({_BASES}, lambda t: 1.0::double + case when a - t.base + b - t.base <> 0 then {_len('(a - t.base + b - t.base)')} else 0 end
    + case when a <> t.base and b <> t.base then {_len('(a - t.base)')} * {_len('(b - t.base)')} else 0 end + (abs(a - t.base) / t.scale + abs(b - t.base) / t.scale) / 5.0::double))"""


@query("math06_carry_pairs", f"with {V.PROBLEMS} select id, {_CARRY} as carry_pairs from problems")
def carry_pairs(spark, sf):
    return V.problems(spark, sf).select("id", D.carry_pairs(F.col("a"), F.col("b")).alias("carry_pairs"))


@query("math07_10_costs", f"with {V.PROBLEMS} select id, round({_OT}, 9) as ot, round({_DD}, 9) as dd, round({_RC}, 9) as rc from problems")
def costs(spark, sf):
    return V.problems(spark, sf).select("id", F.round(D.ot_cost(F.col("a"), F.col("b")), 9).alias("ot"), F.round(D.dd_cost(F.col("a"), F.col("b")), 9).alias("dd"), F.round(D.rc_cost(F.col("a"), F.col("b")), 9).alias("rc"))


@query("win01_target_by_cost", f"""with {V.PROBLEMS}, c as (select id, {_OT} as ot, {_DD} as dd, {_RC} as rc from problems), r as (
    select id, list_sort([{{'cost': ot, 'i': 0, 'n': 'OT'}}, {{'cost': dd, 'i': 1, 'n': 'DD'}}, {{'cost': rc, 'i': 2, 'n': 'RC'}}]) as o from c)
    select case when o[2].cost - o[1].cost >= 0.75 then o[1].n end as target, count(*) as n, round(avg(o[2].cost - o[1].cost), 6) as mean_margin from r group by 1""")
def target_by_cost(spark, sf):
    rows = V.problems(spark, sf).select(D.ot_cost(F.col("a"), F.col("b")).alias("ot"), D.dd_cost(F.col("a"), F.col("b")).alias("dd"), D.rc_cost(F.col("a"), F.col("b")).alias("rc")).select(D.rank_costs(F.col("ot"), F.col("dd"), F.col("rc"), 0.75).alias("r"))
    return rows.groupBy("r.target").agg(F.count("*").alias("n"), F.round(F.avg("r.margin"), 6).alias("mean_margin"))


def _near_sql(n: str) -> str:
    return f"list_sort(list_transform({_BASES}, lambda t: {{'d': abs({n} - t.base), 'b': t.base, 's': t.scale}}))[1]"


@query("math11_applicability", f"""with {V.PROBLEMS}, x as (select id, a, b, {_near_sql('a')} as na, {_near_sql('b')} as nb, {_CARRY} / ({_len('a')} * {_len('b')}) as carry from problems),
    y as (select *, na.d / na.s as da, nb.d / nb.s as db from x),
    z as (select *, case when na.b = nb.b and greatest(da, db) = 0 then 1.0 when na.b = nb.b and greatest(da, db) <= 2 then 0.9 when na.b = nb.b and greatest(da, db) <= 5 then 0.75 when least(da, db) <= 2 then 0.55 when least(da, db) <= 5 then 0.35 else 0.1 end as rc0,
      least(1.0, 0.3 + case when a % 10 = 0 or b % 10 = 0 then 0.5 else 0 end + case when a % 100 = 0 or b % 100 = 0 then 0.2 else 0 end + case when a % 25 = 0 or b % 25 = 0 then 0.2 else 0 end + case when a % 5 = 0 or b % 5 = 0 then 0.1 else 0 end) as dd from y),
    w as (select *, case when da <= 2 and db <= 2 then greatest(rc0, 0.55) else rc0 end as rc from z)
    select id, round(cast(case when carry >= 0.5 then greatest(case when rc < 0.5 and dd < 0.5 then 0.8 else 0.45 end, 0.7) else case when rc < 0.5 and dd < 0.5 then 0.8 else 0.45 end end as double), 6) as ot,
      round(cast(dd as double), 6) as dd, round(cast(rc as double), 6) as rc from w""")
def applicability(spark, sf):
    return V.problems(spark, sf).select("id", D.applicability(F.col("a"), F.col("b")).alias("s")).select("id", F.round("s.ot", 6).alias("ot"), F.round("s.dd", 6).alias("dd"), F.round("s.rc", 6).alias("rc"))


@query("math13_no_carry", f"with {V.PROBLEMS} select id, {V.s_nocarry('a', 'b')} as no_carry from problems")
def no_carry(spark, sf):
    return V.problems(spark, sf).select("id", D.no_carry_product(F.col("a"), F.col("b")).alias("no_carry"))


def _ratio_sql(x: str, y: str) -> str:
    lo, hi = f"cast(least({x}, {y}) as varchar)", f"cast(greatest({x}, {y}) as varchar)"
    return f"({x} > 0 and {y} > 0 and starts_with({hi}, {lo}) and replace(substr({hi}, length({lo}) + 1), '0', '') = '')"


def _omits_sql(m: str, f: str, o: str) -> str:
    # all proper, non-empty subsets of the factor's place values, as numbers
    subsets = f"list_transform(range(1, cast(pow(2, {_len(f)}) as bigint) - 1), lambda k: list_sum(list_transform(range(0, {_len(f)}), lambda i: case when (k >> cast(i as bigint)) & 1 = 1 then (({f} // cast(pow(10, i) as bigint)) % 10) * cast(pow(10, i) as bigint) else 0 end)))"
    return f"(len(list_filter({subsets}, lambda q: q > 0 and q <> {f} and q * {o} = {m})) > 0)"


_SORTED = lambda x: f"array_to_string(list_sort(string_split(cast({x} as varchar), '')), '')"
_KIND = lambda m: f"""case when {m} is null then 'unknown' when {m} = product then 'correct' when {_ratio_sql(m, 'product')} then 'magnitude_slip'
    when {_omits_sql(m, 'a', 'b')} or {_omits_sql(m, 'b', 'a')} then 'partial_product_omission' when {m} = {V.s_nocarry('a', 'b')} then 'carry_drop'
    when {_SORTED(m)} = {_SORTED('product')} then 'digit_permutation' when abs({m} - product) <= greatest(9, product // 100) then 'near_miss' else 'other' end"""  # noqa: E731


@query("math14_power_of_ten_ratio", f"with {V.OUTPUTS} select id, coalesce({_ratio_sql('model_answer', 'product')}, false) as is_ratio from outputs")
def power_of_ten_ratio(spark, sf):
    return V.outputs(spark, sf).select("id", F.coalesce(D.power_of_ten_ratio(F.col("model_answer"), F.col("product").cast(D.BIG)), F.lit(False)).alias("is_ratio"))


@query("math15_16_error_taxonomy", f"with {V.OUTPUTS} select id, {_KIND('model_answer')} as kind from outputs")
def error_taxonomy(spark, sf):
    return V.outputs(spark, sf).select("id", D.error_taxonomy(F.col("a"), F.col("b"), F.col("model_answer")).alias("kind"))


def _shape_sql() -> str:
    near = lambda n: f"cast({V.s_nearest(n, D.SHAPE_BASES)} as decimal(38,0))"
    basis = {"OT": [str(x) for x in (10, 100, 1000, 9, 90, 900)], "DD": ["a * (b % 10)", "a * (b - b % 10)", "(a % 10) * b", "(a - a % 10) * b"], "RC": ["1", "2", near("a"), near("b"), f"({near('a')} - a)", f"({near('b')} - b)"]}
    cols = []
    for k, xs in basis.items():
        lst = "[" + ", ".join(f"cast({s}({x}) as decimal(38,0))" for x in xs for s in ("", "-")) + "]"
        cols.append(f"case when list_contains({lst}, miss) then 1.0 when len(list_filter({lst}, lambda x: x <> 0 and abs(miss - x) * 10 <= abs(x))) > 0 then 0.8 else 0.0 end as c_{k.lower()}")
    return f"""with {V.OUTPUTS}, s1 as (select id, a, b, model_answer - product as miss from outputs where model_answer is not null), s2 as (select id, miss, {', '.join(cols)} from s1),
      s3 as (select *, greatest(c_ot, c_dd, c_rc) as best from s2)
      select id, case when miss = 0 or best = 0 then 'UNKNOWN' when c_ot = best then 'OT' when c_dd = best then 'DD' else 'RC' end as label, cast(case when miss = 0 then 0 else best end as double) as confidence from s3"""


@query("math17_error_shape", _shape_sql())
def error_shape(spark, sf):
    return V.outputs(spark, sf).filter("model_answer is not null").select("id", D.error_shape(F.col("a"), F.col("b"), F.col("model_answer")).alias("s")).select("id", "s.label", "s.confidence")


@query("math18_nearby_wrong", f"""with {V.PROBLEMS}, x as (select id, product, cast(pow(10, case when product % 10 = 0 then {_tz('product', 1)} else 0 end) as bigint) as step from problems)
    select id, case when product - step >= 0 and length(cast(product - step as varchar)) = length(cast(product as varchar)) then product - step else product + step end as wrong from x""")
def nearby_wrong(spark, sf):
    return V.problems(spark, sf).select("id", D.nearby_wrong(F.col("product")).alias("wrong"))


@query("math19_features", f"""with {V.PROBLEMS} select id, {' or '.join(f'abs({n} - {x}) <= 2' for n in 'ab' for x in D.NEAR_BASES)} as near_base, a % 10 = 0 or b % 10 = 0 as zero_factor,
    a % 10 as a_ones, (a // 10) % 10 as a_tens, b % 10 as b_ones, (b // 10) % 10 as b_tens from problems""")
def features(spark, sf):
    tens = lambda n: F.floor(n / 10).cast("bigint") % 10
    return V.problems(spark, sf).select("id", (D.near_round(F.col("a")) | D.near_round(F.col("b"))).alias("near_base"), ((F.col("a") % 10 == 0) | (F.col("b") % 10 == 0)).alias("zero_factor"), (F.col("a") % 10).alias("a_ones"), tens(F.col("a")).alias("a_tens"), (F.col("b") % 10).alias("b_ones"), tens(F.col("b")).alias("b_tens"))


@query("math21_warmup", """with s as (select o_orderkey as k, o_orderkey % 3000 as total, o_custkey % 120 as step from orders), w as (select *, case when total <= 0 then 0 else least(greatest(floor(total * 0.05::double), 10), 100, total) end as warm from s)
    select k, cast(warm as int) as warm, case when warm > 0 and step <= warm then 0.0002::double * step / warm else 0.0002::double end as rate from w""")
def warmup(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3000).alias("total"), (F.col("o_custkey") % 120).alias("step")).withColumn("warm", D.warmup_steps(F.col("total")))
    return rows.select("k", "warm", D.warmup_rate(F.col("step"), F.col("warm"), 0.0002).alias("rate"))


@query("math22_log_floor", f"""with {V.OUTPUTS} select coalesce(band, 'none') as band, count(*) as n, case when avg(case when is_correct then 1.0::double else 0.0 end) <= 0 then 0.05::double else avg(case when is_correct then 1.0::double else 0.0 end) * 100 end as pct from outputs group by 1""")
def log_floor(spark, sf):
    return V.outputs(spark, sf).groupBy(F.coalesce("band", F.lit("none")).alias("band")).agg(F.count("*").alias("n"), D.log_floor(S.rate(F.col("is_correct")), F.count("*"), 0.05).alias("pct"))


@query("join09_nearest_base", f"with {V.PROBLEMS} select id, cast({V.s_nearest('a', D.TRACE_BASES)} as bigint) as base_a, cast({V.s_nearest('b', D.TRACE_BASES)} as bigint) as base_b from problems")
def nearest_base(spark, sf):
    return J.nearest(V.problems(spark, sf), D.TRACE_BASES)


@query("join10_band", f"with {V.PROBLEMS} select id, complexity_c, band from problems")
def band(spark, sf):
    return V.problems(spark, sf).select("id", "complexity_c", "band")


@query("prj18_19_plausible", f"with {V.OUTPUTS} select id, coalesce(model_answer between greatest(1, product // 10) and cast(product as decimal(38,0)) * 10, false) as plausible, length(cast(a as varchar)) between 2 and 9 as in_range, complexity_c between 12 and 324 as in_band from outputs")
def plausible(spark, sf):
    return V.outputs(spark, sf).select("id", D.plausible(F.col("model_answer"), F.col("a"), F.col("b")).alias("plausible"), D.length(F.col("a")).between(2, 9).alias("in_range"), F.col("complexity_c").between(12, 324).alias("in_band"))


@query("str01_hash_split", f"with {V.PROBLEMS} select split, count(*) as n from problems group by split")
def hash_split(spark, sf):
    return V.problems(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query("str02_stratified_split", f"with {V.PROBLEMS} select id, {V.s_split(chr(39) + 'd' + chr(39) + ' || digit_total || ' + chr(39) + '_nz' + chr(39) + ' || nonzero_total || ' + chr(39) + ':' + chr(39) + ' || id')} as split from problems".replace("('42:' || 'd'", "('42:' || 'd'"))
def stratified_split(spark, sf):
    return V.problems(spark, sf).select("id", H.stratified_split(D.stratum(F.col("a"), F.col("b")), F.col("id")).alias("split"))


@query("str04_template_index", f"with {V.PROBLEMS} select id, cast(('0x' || substr(sha256('42|DD|' || a || '|' || b), 1, 16))::UBIGINT % 4 as int) as template from problems")
def template_index(spark, sf):
    return V.problems(spark, sf).select("id", H.template_index(42, F.col("a"), F.col("b"), F.lit("DD"), 4).alias("template"))
