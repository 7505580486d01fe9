"""Queries on templates and text fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import templates as M
from tallyforge.functions import text as T
from tallyforge.plans import views as V
from tallyforge.plans.registry import query

_LIST = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"


@query("str05_template_choice", f"""with {V.PROBLEMS} select id, {', '.join(f"{_LIST(ts)}[1 + cast(('0x' || substr(sha256('0|{k}|' || a || '|' || b), 1, 16))::UBIGINT % 4 as int)] as t_{k.lower()}" for k, ts in M.BANKS['balanced'].items())} from problems""")
def template_choice(spark, sf):
    return V.problems(spark, sf).select("id", *(M.choose(F.col("a"), F.col("b"), k).alias(f"t_{k.lower()}") for k in M.BANKS["balanced"]))


@query("str06_template_audit")
def template_audit(spark, sf):
    return reduce(DataFrame.unionByName, [M.audit(M.bank(spark, p), p != "crosswired_stress").withColumn("profile", F.lit(p)) for p in M.BANKS])


def _bank_sql(profile: str) -> str:
    rows = ", ".join(str((k, i, M.STYLES[profile][i], M.CUES[profile][k][i], t)) for k, ts in M.BANKS[profile].items() for i, t in enumerate(ts))
    return f"""select '{profile}' as profile, substr(sha256('{{"mode":"multi","profile":"{profile}","profile_kind":"{M.KINDS[profile]}","seed":0,"template_bank":{{' || string_agg('"' || label || '":[' || specs || ']', ',' order by label) || '}}}}'), 1, 16) as bank_hash
      from (select label, string_agg('{{"heuristic":"' || label || '","semantic_cues":["' || replace(cues, '|', '","') || '"],"style_family":"' || style || '","text":"' || text || '"}}', ',' order by nth) as specs
        from (values {rows}) t(label, nth, style, cues, text) group by label)"""


@query("str07_bank_hash", " union all ".join(_bank_sql(p) for p in M.BANKS))
def bank_hash(spark, sf):
    return reduce(DataFrame.unionByName, [M.bank_hash(M.bank(spark, p), p).select(F.lit(p).alias("profile"), "bank_hash") for p in M.BANKS])


_BALANCED = ", ".join(str((k, i, M.STYLES["balanced"][i], M.CUES["balanced"][k][i], t)) for k, ts in M.BANKS["balanced"].items() for i, t in enumerate(ts))


@query("str07_bank_hash_of_suppliers", f"""with b as (select s_suppkey, label, nth, style, cues, text || ' by ' || s_name as text from supplier, (values {_BALANCED}) t(label, nth, style, cues, text)),
    l as (select s_suppkey, label, string_agg('{{"heuristic":"' || label || '","semantic_cues":["' || replace(cues, '|', '","') || '"],"style_family":"' || style || '","text":"' || text || '"}}', ',' order by nth) as specs from b group by 1, 2)
    select s_suppkey, substr(sha256('{{"mode":"multi","profile":"balanced","profile_kind":"{M.KINDS['balanced']}","seed":0,"template_bank":{{' || string_agg('"' || label || '":[' || specs || ']', ',' order by label) || '}}}}'), 1, 16) as bank_hash from l group by 1""")
def bank_hash_of_suppliers(spark, sf):
    """A bank for each supplier, whose texts end with its name, and the hash of each."""
    rows = V.table(spark, sf, "supplier").select("s_suppkey", "s_name").join(F.broadcast(M.bank(spark)))  # some dozen templates a supplier
    return M.bank_hash(rows.withColumn("text", F.concat("text", F.lit(" by "), "s_name")), by=("s_suppkey",))


def _near(x: str) -> str:
    step = f"cast(pow(10, case when {x} % 10 = 0 then case when {x} = 0 then 1 else length(regexp_extract(cast({x} as varchar), '0+$')) end else 0 end) as bigint)"
    return f"case when {x} - {step} >= 0 and length(cast({x} - {step} as varchar)) = length(cast({x} as varchar)) then {x} - {step} else {x} + {step} end"


def _steps_sql() -> str:
    """Common table expressions down to `pairs` (id, a, b, label, nth, right_step, wrong_step), harder ones last."""
    say = {
        "OT": lambda text, z: f"printf('{text}', a % 10, b % 10, {z}, ({z}) % 10, ({z}) // 10)",
        "DA": lambda text, z: f"printf('{text}', a, a - a % 10, a % 10, a - a % 10, b, {z})",
        "DB": lambda text, z: f"printf('{text}', b, b - b % 10, b % 10, a, b - b % 10, {z})",
        "RA": lambda text, z: f"printf('{text}', a, ba, abs(a - ba), b, {z})",
        "RB": lambda text, z: f"printf('{text}', b, bb, abs(b - bb), a, {z})",
    }
    ten = lambda z: f"case when {z} % 10 = 0 then {z} // 10 else {z} * 10 end"
    ot = M.STEP_TEXTS["OT"]
    rows = [("OT", 0, "OT", ot[0], "o", _near("o")), ("OT", 1, "OT", ot[1], "o", _near("o"))]
    rows += [("OT", i, "OT", t, "o", "case when o >= 10 then o - 10 else o + 10 end") for i, t in ((2, ot[0]), (3, ot[2]))]
    for label, sides in (("DD", (("DA", "da", ten("da")), ("DB", "db", ten("db")))), ("RC", (("RA", "ra", "ra + b"), ("RB", "rb", "rb + a")))):
        rows += [(label, i, k, M.STEP_TEXTS[label], z, _near(z)) for i, (k, z, _) in enumerate(sides)] + [(label, i + 2, k, M.STEP_TEXTS[label], z, w) for i, (k, z, w) in enumerate(sides)]
    union = " union all ".join(f"select id, a, b, '{label}' as label, {i} as nth, {say[k](t, z)} as right_step, {say[k](t, w)} as wrong_step from n" for label, i, k, t, z, w in rows)
    bases = (10, 50, 100, 200, 500, 1000)
    return f"""{V.PROBLEMS}, n0 as (select id, a, b, {V.s_nearest('a', bases)} as ba, {V.s_nearest('b', bases)} as bb from problems),
      n as (select *, (a % 10) * (b % 10) as o, (a - a % 10) * b as da, a * (b - b % 10) as db, abs(a - ba) * b as ra, abs(b - bb) * a as rb from n0), pairs as ({union})"""


def _steps(spark, sf, **how):
    rows = V.problems(spark, sf).select("id", F.explode(M.step_pairs(F.col("a"), F.col("b"), **how)).alias("s"))
    return rows.select("id", "s.label", "s.nth", F.col("s.right").alias("right_step"), F.col("s.wrong").alias("wrong_step"))


@query("str08_step_pairs", f"with {_steps_sql()} select id, label, nth, right_step, wrong_step from pairs")
def step_pairs(spark, sf):
    return _steps(spark, sf, profile="harder")


@query("str08_single_pairs", f"""with {_steps_sql()} select id, label, nth, right_step, wrong_step from pairs
    where nth = cast(('0x' || substr(sha256('0|contrastive:' || label || '|' || a || '|' || b), 1, 16))::UBIGINT % 2 as int)""")
def single_pairs(spark, sf):
    return _steps(spark, sf, mode="single")


@query("str16_trace_status", f"with {V.s_traces()}, t as (select id, case {V.s_draw('y', 'id', 5)} when 0 then '' when 1 then 'nothing' else trace end as said, a, b from traces) select case when trim(said) = '' then 'trace_missing' when not (contains(said, cast(a as varchar)) or contains(said, cast(b as varchar))) then 'contaminated_trace' else 'ok' end as status, count(*) as n from t group by 1")
def trace_status(spark, sf):
    """Whether a trace can be classified by its wording."""
    kind = V.draw("y", F.col("id"), 5)
    rows = V.traces(spark, sf).withColumn("said", F.when(kind == 0, "").when(kind == 1, "nothing").otherwise(F.col("trace"))).withColumn("contaminated", T.contaminated(F.col("said"), F.col("a"), F.col("b")))
    status = F.when(F.trim("said") == "", "trace_missing").when(F.col("contaminated"), "contaminated_trace").otherwise("ok")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_FRAGMENT = "'% model: ' || n_nationkey || chr(10) || '\\begin{table}[t]' || chr(10) || '\\toprule x \\midrule' || chr(10) || n_name || ' & 1 \\\\' || chr(10) || '  ' || chr(10) || 'b & 2 \\\\' || chr(10) || '\\bottomrule' || chr(10) || '\\end{table}' || chr(10) || 'tail'"


@query("str20_latex_tables", f"""with f as (select n_nationkey, {_FRAGMENT} as t from nation), x as (select n_nationkey, regexp_extract_all(t, '(?s)(\\\\begin\\{{table\\*?\\}}.*?\\\\end\\{{table\\*?\\}})', 1) as tabs from f)
    select n_nationkey, len(tabs) as n_tables, array_to_string(list_filter(list_transform(string_split(regexp_extract(tabs[1], '(?s)\\\\midrule\\s*(.*?)\\s*\\\\bottomrule', 1), chr(10)), lambda l: rtrim(l)), lambda l: trim(l) <> ''), '|') as body from x""")
def latex_tables(spark, sf):
    bs = "\\"
    parts = ["% model: ", F.col("n_nationkey"), f"\n{bs}begin{{table}}[t]\n{bs}toprule x {bs}midrule\n", F.col("n_name"), f" & 1 {bs}{bs}\n  \nb & 2 {bs}{bs}\n{bs}bottomrule\n{bs}end{{table}}\ntail"]
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    rows = V.table(spark, sf, "nation").select("n_nationkey", M.tables(text).alias("tabs"))
    return rows.select("n_nationkey", F.size("tabs").alias("n_tables"), F.array_join(M.body_lines(F.get("tabs", F.lit(0))), "|").alias("body"))
