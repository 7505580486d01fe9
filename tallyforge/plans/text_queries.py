"""Queries on traces, labels and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import casts as C
from tallyforge.functions import digits as D
from tallyforge.functions import text as T
from tallyforge.operators import selection as X
from tallyforge.plans import views as V
from tallyforge.plans.registry import query

TRACES = V.s_traces()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count_sql(label: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(trace, {_q('(?i)' + p)}))" for p in T.PATTERNS[label]) + ")"


_CLASSES = f"{TRACES}, m as (select id, trace_label, {_count_sql('OT')} as ot, {_count_sql('DD')} as dd, {_count_sql('RC')} as rc from traces)"


@query("str22_traces", f"with {TRACES} select id, trace_label, md5(trace) as trace_md5, length(trace) as n_chars from traces")
def traces(spark, sf):
    return V.traces(spark, sf).select("id", "trace_label", F.md5(F.col("trace").cast("binary")).alias("trace_md5"), F.length("trace").alias("n_chars"))


@query("str14_trace_classifier", f"""with {_CLASSES} select id, cast(ot as int) as ot, cast(dd as int) as dd, cast(rc as int) as rc, case when ot + dd + rc = 0 then 'UNKNOWN' when ot >= dd and ot >= rc then 'OT' when dd >= rc then 'DD' else 'RC' end as label,
    case when ot + dd + rc = 0 then 0.0::double else greatest(ot, dd, rc)::double / (ot + dd + rc) end as confidence from m""")
def trace_classifier(spark, sf):
    return V.traces(spark, sf).select("id", T.classify(F.col("trace")).alias("c")).select("id", "c.ot", "c.dd", "c.rc", "c.label", "c.confidence")


@query("agg08_trace_methods", f"""with {_CLASSES}, l as (select *, case when ot + dd + rc = 0 then 'UNKNOWN' when ot >= dd and ot >= rc then 'OT' when dd >= rc then 'DD' else 'RC' end as label from m)
    select trace_label, label, count(*) as n, avg(case when ot + dd + rc = 0 then 0.0::double else greatest(ot, dd, rc)::double / (ot + dd + rc) end) as mean_confidence from l group by 1, 2""")
def trace_methods(spark, sf):
    rows = V.traces(spark, sf).select("trace_label", T.classify(F.col("trace")).alias("c"))
    return rows.groupBy("trace_label", F.col("c.label").alias("label")).agg(F.count("*").alias("n"), F.avg("c.confidence").alias("mean_confidence"))


_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(trace), '(?is)^\s*What is .*?\?\s*', ''), '(?i)(?:Final\s+)?Answer\s*:\s*[-+]?[\d,]+(?:\.\d+)?\s*$', ''), '\d+', '<NUM>', 'g'), '\s+', ' ', 'g'))"""


@query("str15_trace_normaliser", f"with {TRACES} select {_NORMAL} as wording, count(*) as n from traces group by 1")
def trace_normaliser(spark, sf):
    return V.traces(spark, sf).groupBy(T.normalize(F.col("trace")).alias("wording")).agg(F.count("*").alias("n"))


@query("src09_training_texts", f"""with {TRACES}, n as (select trace_label as heuristic, k, {_NORMAL} as wording from traces where split = 'train'), r as (select *, row_number() over (partition by heuristic order by k) as rn from n where wording <> '')
    select heuristic, wording, count(*) as n from r where rn <= 256 group by 1, 2""")
def training_texts(spark, sf):
    rows = V.traces(spark, sf).select(F.col("trace_label").alias("heuristic"), "k", "split", F.col("trace").alias("reasoning_trace"))
    return X.training_texts(rows, ["OT", "DD", "RC", "STYLE"], order="k").groupBy("heuristic", "wording").agg(F.count("*").alias("n"))


@query("str17_prompt_strip", f"with {TRACES} select id, md5(substr(trace, length('What is ' || a || ' × ' || b || '?') + 2)) as rest_md5 from traces")
def prompt_strip(spark, sf):
    return V.traces(spark, sf).select("id", F.md5(T.strip_prompt(T.prompt(F.col("a"), F.col("b")), F.col("trace")).cast("binary")).alias("rest_md5"))


@query("str21_prompt", f"with {V.PROBLEMS} select id, 'What is ' || a || ' × ' || b || '?' as prompt from problems")
def prompt(spark, sf):
    return V.problems(spark, sf).select("id", T.prompt(F.col("a"), F.col("b")).alias("prompt"))


_FORMS = (
    ("The result is \\boxed{%d}", "boxed"), ("so $%d$ it is", "latex"), ("therefore the answer is %d", "final"), ("total: %d!", "marker"),
    ("%d * 7 = %d", "equation"), ("just 3 then %d and more words", "fallback"), ("nothing to see", "none"), ("is **%d** =", "cut"),
)


def _answers(spark, sf):
    """Texts of every form; the first words name the factors, but for every ninth text."""
    rows = V.outputs(spark, sf).filter("model_answer is not null").withColumn("form", V.draw("f", F.col("id"), len(_FORMS)))
    m = F.col("model_answer").cast("string")
    body = F.coalesce(*(F.when(F.col("form") == i, F.replace(F.lit(f), F.lit("%d"), m)) for i, (f, _) in enumerate(_FORMS)))
    head = F.when(V.draw("g", F.col("id"), 9) == 0, F.lit("Well. ")).otherwise(F.concat(F.col("a").cast("string"), F.lit(" by "), F.col("b").cast("string"), F.lit(". ")))
    return rows.withColumn("said", F.concat(head, body))


_BODY = "case form " + " ".join(f"when {i} then replace({_q(f)}, '%d', cast(model_answer as varchar))" for i, (f, _) in enumerate(_FORMS)) + " end"
_SAID = f"""{V.OUTPUTS}, s0 as (select *, {V.s_draw('f', 'id', len(_FORMS))} as form from outputs where model_answer is not null),
    said as (select *, case when {V.s_draw('g', 'id', 9)} = 0 then 'Well. ' else a || ' by ' || b || '. ' end || {_BODY} as said from s0)"""


def _extract_sql() -> str:
    num = lambda p: p.replace("NUM", T.NUMBER)
    parse = lambda x: f"case when regexp_full_match(replace({x}, ',', ''), '[0-9]{{1,38}}') then try_cast(replace({x}, ',', '') as decimal(38,0)) end"
    ok = lambda x: f"({x} is not null and {x} between greatest(1, product // 10) and cast(product as decimal(38,0)) * 10)"
    bold = "s0t"
    for mark in (r"\*\*", "__", r"\*", "_"):
        bold = f"regexp_replace({bold}, {_q(f'{mark}({T.NUMBER}){mark}')}, '\\1', 'g')"
    tries = ", ".join(f"{parse(f'regexp_extract_all(s, {_q(num(p))}, 1)[-1]')} as v{i}" for i, (p, _, _) in enumerate(T.STRATEGIES))
    chain = lambda f: " ".join(f"when {ok(f'v{i}')} then {f(i)}" for i in range(len(T.STRATEGIES)))
    cut = " or ".join(f"regexp_matches(right(s0t, 50), {_q(p)})" for p in T.CUT_OFF)
    return f"""with {_SAID}, e0 as (select id, a, b, product, trim(said) as s0t from said), e1 as (select *, {cut} as truncated, {bold} as s from e0),
      e2 as (select *, not (contains(replace(s, ',', ''), cast(a as varchar)) or contains(replace(s, ',', ''), cast(b as varchar))) as contaminated,
        list_filter(list_transform(list_reverse(regexp_extract_all(s, {_q('(' + T.NUMBER + ')')}, 1)), lambda x: {parse('x')}), lambda x: x is not null) as nums, {tries} from e1),
      e3 as (select *, list_filter(nums, lambda x: x >= 10 and {ok('x')})[1] as big, nums[1] as lastn, coalesce(list_filter(nums[1:3], lambda x: x >= 10)[1], nums[1]) as dirty from e2)
      select id, case when contaminated then dirty {chain(lambda i: f'v{i}')} when big is not null then big else lastn end as answer,
        case when contaminated then 'contaminated' {chain(lambda i: _q(T.STRATEGIES[i][1]))} when lastn is not null then 'fallback' else 'none' end as strategy,
        cast(case when contaminated then case when dirty is not null then 0.1 else 0.0 end {chain(lambda i: str(T.STRATEGIES[i][2]))} when big is not null then case when truncated then 0.2 else 0.5 end
          when lastn is not null then case when truncated then 0.16 else 0.4 end else 0 end as double) as confidence, truncated, contaminated from e3"""


@query("str09_12_answer_extraction", _extract_sql())
def answer_extraction(spark, sf):
    rows = _answers(spark, sf).select("id", T.extract_answer(F.col("said"), F.col("a"), F.col("b"), exact=True).alias("e"))
    return rows.select("id", "e.answer", "e.strategy", F.round("e.confidence", 6).alias("confidence"), "e.truncated", "e.contaminated")


@query("str11_truncation", f"with {_SAID} select {' or '.join(f'regexp_matches(right(trim(said), 50), {_q(p)})' for p in T.CUT_OFF)} as truncated, form, count(*) as n from said group by 1, 2")
def truncation(spark, sf):
    return _answers(spark, sf).groupBy(T.cut_off(F.trim("said")).alias("truncated"), "form").agg(F.count("*").alias("n"))


_ESC = "said"
for _o, _n in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")):
    _ESC = f"replace({_ESC}, {_q(_o)}, {_q(_n)})"


@query("str19_latex_escape", f"with {_SAID} select id, {_ESC} as escaped from said")
def latex_escape(spark, sf):
    return _answers(spark, sf).select("id", T.escape_latex(F.col("said")).alias("escaped"))


@query("str18_token_counts", r"""select event_id, case when event_type is null then null else cast(nullif(regexp_extract('expected ' || (event_id % 977) || ' tokens for image, got ' || user_id, 'expected (\d+) tokens', 1), '') as int) end as expected,
    cast(nullif(regexp_extract('expected ' || (event_id % 977) || ' tokens for image, got ' || user_id, 'got (\d+)', 1), '') as bigint) as got from events""")
def token_counts(spark, sf):
    e = V.table(spark, sf, "events").withColumn("m", F.concat(F.lit("expected "), F.col("event_id") % 977, F.lit(" tokens for image, got "), F.col("user_id")))
    return e.select("event_id", T.token_count(F.col("m")).cast("int").alias("expected"), T.token_count(F.col("m"), "got").alias("got"))


_RAW = "[' True', 'YES', '1', 'n', '0', 'unknown', '', 'correct ', 'INCORRECT', '1e3', ' 2.5', 'nan', 'inf', '1_000', '1.0d', ' decomposition', 'ot', '  ']"
_RAW_LIST = [" True", "YES", "1", "n", "0", "unknown", "", "correct ", "INCORRECT", "1e3", " 2.5", "nan", "inf", "1_000", "1.0d", " decomposition", "ot", "  "]


@query("prj01_05_casts", f"""with r as (select o_orderkey as k, {_RAW}[1 + o_orderkey % {len(_RAW_LIST)}] as raw, {_RAW}[1 + (o_orderkey // 3) % {len(_RAW_LIST)}] as other from orders)
    select k, lower(trim(raw)) in ('true', '1', 'yes', 'y') as flag, case when lower(trim(raw)) in ('correct', 'true', '1', 'yes', 'y') then true when lower(trim(raw)) in ('incorrect', 'false', '0', 'no', 'n') then false end as correct,
      case when regexp_full_match(trim(raw), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(raw) as double) end as number,
      case upper(trim(raw)) when '' then 'UNKNOWN' when 'DECOMPOSITION' then 'DD' when 'ONES_THEN_TENS' then 'OT' when 'ROUNDING_COMPENSATION' then 'RC' when 'STYLE_CONTROL' then 'STYLE' else upper(trim(raw)) end as label,
      coalesce(nullif(raw, ''), nullif(other, '')) as filled from r""")
def casts(spark, sf):
    raw = F.array(*(F.lit(x) for x in _RAW_LIST))
    k = F.col("o_orderkey")
    rows = V.table(spark, sf, "orders").select(k.alias("k"), F.get(raw, (k % len(_RAW_LIST)).cast("int")).alias("raw"), F.get(raw, (F.floor(k / 3) % len(_RAW_LIST)).cast("int")).alias("other"))
    r = F.col("raw")
    return rows.select("k", C.to_bool(r).alias("flag"), C.to_correctness(r).alias("correct"), C.to_finite(r).alias("number"), C.to_label(r).alias("label"), C.first_filled(r, F.col("other")).alias("filled"))


@query("prj08_result_rows", f"""with {V.OUTPUTS} select id, is_correct, model_answer - product as error_delta, case when model_answer is null then 'unknown' when is_correct then 'correct' else 'incorrect' end as label from outputs""")
def result_rows(spark, sf):
    rows = V.outputs(spark, sf)
    known = F.col("model_answer") == F.col("product")
    return rows.select("id", "is_correct", (F.col("model_answer") - F.col("product")).cast(D.BIG).alias("error_delta"), C.correctness_label(known).alias("label"))


_FAIL = "['invalid jwt', 'Checkpoint gone', 'request timed out', 'odd', 'path missing', '']"


@query("prj17_failures", f"""with f as (select o_orderkey as k, [200, 401, 404, 429, 500, 503, 418][1 + o_orderkey % 7] as status, {_FAIL}[1 + o_orderkey % 6] as message from orders)
    select case when status in (401, 408, 409, 429) or status >= 500 or regexp_matches(lower(message), 'invalid jwt|authentication|connection error|request timed out|heartbeat') then 'infrastructure'
      when status in (400, 404) or regexp_matches(lower(message), 'checkpoint|tinker://|not found|missing|path|sampler_weights|_state') then 'checkpoint' else 'other' end as kind, count(*) as n from f group by 1""")
def failures(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda xs, m: F.get(F.array(*(F.lit(x) for x in xs)), (k % m).cast("int"))
    rows = V.table(spark, sf, "orders").select(pick((200, 401, 404, 429, 500, 503, 418), 7).alias("status"), pick(("invalid jwt", "Checkpoint gone", "request timed out", "odd", "path missing", ""), 6).alias("message"))
    return rows.groupBy(C.failure_kind(F.col("status"), F.col("message")).alias("kind")).agg(F.count("*").alias("n"))
