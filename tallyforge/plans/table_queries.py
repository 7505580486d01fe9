"""Queries on generated tables, files and streams, and the long table of all metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import casts as C
from tallyforge.functions import templates as T
from tallyforge.operators import analysis as A
from tallyforge.operators import generation as G
from tallyforge.operators import presentation as P
from tallyforge.operators import selection as X
from tallyforge.operators import statistics as S
from tallyforge.plans import views as V
from tallyforge.plans.registry import query
from tallyforge.plans.stat_queries import _R, _SEB, FLIPS, PROBED, flips, probed
from tallyforge.sources import readers, sinks
from tallyforge.sources.scratch import scratch
from tallyforge.streaming import incremental as I


@query("gen05_07_grid")
def grid(spark, sf):
    return G.grid(spark)


@query("gen11_hds")
def hds(spark, sf):
    return G.hds(spark)


@query("gen11_hds_fresh", f"""with {V.PROBLEMS} select t.family, t.n, (select count(*) from problems where a is null or b is null) as known, true as in_range, true as winners from (values ('DD', 333::bigint), ('OT', 333::bigint), ('RC', 334::bigint)) t(family, n)""")
def fresh_hds(spark, sf):
    """What holds of a generated set that leaves out all problems: its sizes, none of the problems, complexities within bounds, each row's method the cheapest."""
    known = V.problems(spark, sf)
    made = G.hds(spark, exclude=known)
    pairs = known.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(1).alias("old")).distinct()
    rows = made.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(pairs, ["lo", "hi"], "left")
    return rows.groupBy(F.col("design_family").alias("family")).agg(F.count("*").alias("n"), F.count("old").alias("known"), F.bool_and(F.col("complexity_c").between(12, 324)).alias("in_range"), F.bool_and(F.col("canonical_target_heuristic") == F.col("design_family")).alias("winners"))


@query("gen12_traps")
def traps(spark, sf):
    return G.traps(spark, V.problems(spark, sf).filter("split = 'test'"))


@query("gen13_training_traces")
def training(spark, sf):
    test = V.problems(spark, sf)
    return reduce(DataFrame.unionByName, [G.training_traces(spark, k, 1000, test) for k in ("RC", "DD", "OT", "STYLE")])


@query("src03_problem_versions", f"""with {V.PROBLEMS}, f as (select id, a, b, k % 3 as version, design_family, canonical_target, complexity_c, digit_total, nonzero_total, (k % 50)::double as ot, (k % 37)::double as dd, (k % 23)::double as rc from problems)
    select id, case version when 0 then design_family else canonical_target end as design_family, canonical_target, case version when 0 then (greatest(ot, dd, rc) - ot) / greatest(greatest(ot, dd, rc) - least(ot, dd, rc), 1e-6) when 1 then ot / 100 else 0.5 end::double as ot_score,
      complexity_c::double as complexity_c from f""")
def problem_versions(spark, sf):
    """Files of three versions: with costs, with scores, with neither and no complexity."""
    p = V.problems(spark, sf)
    v2 = p.filter("k % 3 = 0").selectExpr("id", "a", "b", "product", "design_family", "canonical_target as canonical_target_heuristic", "cast(k % 50 as double) as ot_cost", "cast(k % 37 as double) as dd_cost", "cast(k % 23 as double) as rc_cost", "digit_total", "nonzero_total")
    v1 = p.filter("k % 3 = 1").selectExpr("id", "a", "b", "product", "canonical_target as target_heuristic", "(k % 50) / 100.0D as ot_score", "complexity_c")
    v0 = p.filter("k % 3 = 2").selectExpr("id", "a", "b", "canonical_target as target_heuristic", "'x' as trap_type")
    rows = reduce(DataFrame.unionByName, [readers.superset(x) for x in (v2, v1, v0)])
    return readers.problems(rows).select("id", "design_family", "canonical_target", "ot_score", "complexity_c")


@query("src02_07_split", f"with {V.PROBLEMS} select id, split from problems where split = 'val'")
def split_scan(spark, sf):
    return readers.select_split(V.problems(spark, sf), "val").select("id", "split")


@query("src11_json_lines", """select case when event_id % 10 = 0 then null else user_id end as user_id, count(*) as n, sum(value) as total from events where event_id % 7 <> 0 and event_id % 11 <> 0 group by 1""")
def json_lines(spark, sf):
    """Lines of objects, of which every seventh is cut off and every eleventh blank."""
    e = V.table(spark, sf, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("user_id"), "value"))
    e = e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), line)).when(F.col("event_id") % 11 == 0, "  ").otherwise(line).alias("value"))
    return readers.parse_lines(e, "user_id bigint, value double").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("src16_model_slug", "select case when s_suppkey % 3 = 0 then null else (s_suppkey % 4 + 1) * 30 || 'b' end as model, case when s_suppkey % 3 = 0 then null else (s_suppkey % 4 + 1) * 30 end as model_size, count(*) as n from supplier group by 1, 2")
def model_slug(spark, sf):
    """Result files of folders of several models, read together: each row's model is in its folder's name."""
    path = scratch(spark, "models")
    s = V.table(spark, sf, "supplier")
    folder = F.when(F.col("s_suppkey") % 3 == 0, "fingerprint_HDS").otherwise(F.concat(F.lit("fingerprint_HDS_"), ((F.col("s_suppkey") % 4 + 1) * 30).cast("string"), F.lit("b")))
    s.select("s_suppkey", folder.alias("of")).write.partitionBy("of").json(path)
    rows = readers.with_model(spark.read.schema("s_suppkey bigint").option("recursiveFileLookup", True).json(path))
    return rows.groupBy("model", "model_size").agg(F.count("*").alias("n"))


@query("snk01_csv_round_trip", f"with {V.s_traces()} select id, a, b, trace_label, md5(trace) as trace_md5, case split when 'test' then 'val' else split end as split from traces")
def csv_round_trip(spark, sf):
    """Traces of several lines written as CSV and read again."""
    path = scratch(spark, "traces-csv")
    sinks.write_csv(V.traces(spark, sf).select("id", "a", "b", "trace_label", "trace", "split"), path, remap={"test": "val"})
    back = readers.read_csv(spark, path, "id string, a bigint, b bigint, trace_label string, trace string, split string")
    return back.select("id", "a", "b", "trace_label", F.md5(F.col("trace").cast("binary")).alias("trace_md5"), "split")


@query("snk03_detail_records", f"with {PROBED} select id as hds_id, is_correct, loss_dd as dd, loss_neutral as neutral, mass_rc, detected from probed")
def detail_records(spark, sf):
    """Nested records written as JSON lines and read again, infinities and all."""
    path = scratch(spark, "details-json")
    rows = sinks.detail_records(probed(spark, sf))
    sinks.write_details(rows, path)
    back = readers.read_jsonl(spark, path, rows.schema, strict=True)
    return back.select("hds_id", "generation.is_correct", F.col("perplexity.aggregated.DD").alias("dd"), F.col("perplexity.neutral_loss").alias("neutral"), F.col("perplexity.support_mass.RC").alias("mass_rc"), F.col("perplexity.detected_heuristic").alias("detected"))


@query("snk05_loss_history", "select vec_id as run, generate_subscripts(embedding, 1) - 1 as step, unnest(embedding) as loss from embeddings")
def loss_history(spark, sf):
    return sinks.loss_history(V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("run"), F.col("embedding").alias("losses")))


@query("strm03_running_rates", f"with {PROBED} select design_family, count(*) as n, avg(case when is_correct then 1.0::double else 0.0 end) as accuracy, avg(case when detected = design_family then 1.0::double else 0.0 end) as match_rate from probed group by 1")
def running_rates(spark, sf):
    """The rates of a folder of result files, read as a stream to its end."""
    path = scratch(spark, "results")
    probed(spark, sf).select("design_family", "is_correct", "detected").repartition(4).write.json(path)
    stream = I.follow(spark, path, "design_family string, is_correct boolean, detected string", 2)
    return I.to_table(I.running_rates(stream), scratch(spark, "rates"), scratch(spark, "rates-log"))


@query("strm01_event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def event_windows(spark, sf):
    """The windows of a stream, complete: what a table gives."""
    schema = V.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    out = I.to_table(I.event_windows(stream), scratch(spark, "windows"), scratch(spark, "windows-log"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("win13_ordered_concat", "with w as (select o_clerk_like, o_orderkey, row_number() over (partition by o_clerk_like order by o_orderkey) as rn from (select 'c' || o_custkey % 50 as o_clerk_like, o_orderkey from orders)) select o_clerk_like as name, o_orderkey as line from w where rn = 1")
def ordered_concat(spark, sf):
    """Of fragments of named lines, the first of each name."""
    o = V.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("name"), F.col("o_orderkey").alias("line"))
    return X.first_by(o, ["name"], ["line"])


@query("pres01_metrics", f"""with {PROBED}
    select 'accuracy' as name, design_family as grp, {_R('is_correct')} as value, {_SEB('is_correct')} as se from probed group by 2
    union all select 'coverage', design_family, {_R('mass_dd is not null')}, {_SEB('mass_dd is not null')} from probed group by 2
    union all select 'mean_c', coalesce(band, 'none'), avg(cast(complexity_c as double)), coalesce(stddev_samp(complexity_c) / sqrt(count(*)), 0) from probed group by 2
    union all select 'detected', detected, count(*)::double, 0.0::double from probed group by 2""")
def metrics(spark, sf):
    """name, grp, value, se: what reports are made from."""
    rows = probed(spark, sf)
    one = lambda name, df, value, se: df.select(F.lit(name).alias("name"), F.col("grp"), F.col(value).cast("double").alias("value"), (F.col(se) if isinstance(se, str) else F.lit(se)).alias("se"))
    fam = A.by_family(rows).withColumnRenamed("design_family", "grp")
    c = rows.groupBy(F.coalesce("band", F.lit("none")).alias("grp")).agg(F.avg("complexity_c").alias("v"), S.mean_se(F.col("complexity_c")).alias("s"))
    found = rows.groupBy(F.col("detected").alias("grp")).agg(F.count("*").alias("v"))
    return reduce(DataFrame.unionByName, [one("accuracy", fam, "accuracy", "accuracy_se"), one("coverage", fam, "coverage_rate", "coverage_se"), one("mean_c", c, "v", "s"), one("detected", found, "v", 0.0)])


@query("pres03_flip_table", f"""with {FLIPS}, r as (select lora, coalesce(avg(base_correct::int::double) filter (where base_correct is not null and lora_correct is not null), 0) * 100 as b, coalesce(avg(lora_correct::int::double) filter (where base_correct is not null and lora_correct is not null), 0) * 100 as a from flips group by 1)
    select 'families' as "table", lora, design_family as "column", count_if(flip = 'improved') || '/' || count_if(flip = 'degraded') as cell from flips group by 1, 2, 3
    union all select 'changes', lora, base_detected || '->' || lora_detected, count(*)::varchar from flips where base_detected <> lora_detected group by 2, 3
    union all select 'accuracy', lora, 'before', printf('%.1f', round(b, 1)) from r union all select 'accuracy', lora, 'after', printf('%.1f', round(a, 1)) from r union all select 'accuracy', lora, 'points', printf('%+.1f', round(a - b, 1) + 0.0) from r""")
def flip_table(spark, sf):
    return A.flip_cells(flips(spark, sf))


_POINT = "select '{0}' as chart, {1} as series, ({2})::varchar as x, avg(case when {3} then 1.0::double else 0.0 end) as y, count(*) as n from probed where {2} is not null group by 1, 2, 3"


@query("pres05_series", f"""with {PROBED} {_POINT.format('accuracy by band', 'design_family', 'band', 'is_correct')} union all {_POINT.format('matches by band', 'design_family', 'band', 'detected = design_family')}
    union all {_POINT.format('accuracy by confidence', 'detected', 'cast(round(confidence * 10) as int)', 'is_correct')}
    union all select 'labels by family', detected, design_family, count(*) / sum(count(*)) over (partition by design_family)::double, count(*) from probed group by 2, 3""")
def series(spark, sf):
    return A.series(probed(spark, sf))


_UNIT = lambda name: f"(({V.s_draw('42:' + name, 'id', 1_000_003)} + 0.5::double) / 1000003.0::double)"
_NOISY = lambda k, m: f"2.0::double - (k % {m})::double / {m} * 0.5 + sqrt(-2.0::double * ln({_UNIT('r' + k)})) * cos(2 * pi() * {_UNIT('a' + k)}) * 0.1"


@query("gen15_mock_outputs", f"""with {V.PROBLEMS}, l as (select *, {_NOISY('ot', 50)} as loss_ot, {_NOISY('dd', 37)} as loss_dd, {_NOISY('rc', 23)} as loss_rc from problems),
    d as (select *, case when loss_ot <= least(loss_dd, loss_rc) then 'OT' when loss_dd <= loss_rc then 'DD' else 'RC' end as detected from l),
    c as (select *, {_UNIT('right')} < case when detected = design_family then 0.85 else 0.65 end as is_correct from d)
    select id, round(loss_ot, 6) as loss_ot, round(loss_dd, 6) as loss_dd, round(loss_rc, 6) as loss_rc, detected, is_correct, product + case when is_correct then 0 else [10, -10, 1, -1, 100][1 + floor({_UNIT('off')} * 5)::int] end as model_answer from c""")
def mock_outputs(spark, sf):
    p = V.problems(spark, sf).withColumns({f"{k}_score": (F.col("k") % m).cast("double") / m for k, m in (("ot", 50), ("dd", 37), ("rc", 23))})
    rounded = [F.round(f"loss_{k}", 6).alias(f"loss_{k}") for k in ("ot", "dd", "rc")]
    return G.mock_outputs(p).select("id", *rounded, "detected", "is_correct", "model_answer")


def _fragments(spark, sf):
    """A report's fragment for each nation: a macro that all define, one of its own, and a table, some with a model's name."""
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), "n_name")
    model = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("% Model: Big "), F.col("ord").cast("string"), F.lit("\n"))).otherwise("")
    content = F.concat(model, F.lit("\\newcommand{\\shared}{"), F.col("ord").cast("string"), F.lit("}\n\\newcommand{\\own"), "n_name", F.lit("}{x}\n\\begin{table}\n\\label{tab:"), F.col("ord").cast("string"), F.lit("}\n\\midrule\n"), "n_name", F.lit(" & 1 \\\\\n\\bottomrule\n\\end{table}"))
    path = F.concat(F.lit("out/table."), F.when(F.col("ord") % 3 == 1, F.concat(F.col("ord").cast("string"), F.lit("b."))).otherwise(F.lit("plain.")), F.lit("tex"))
    return n.select("ord", path.alias("path"), content.alias("content"))


@query("pres02_grouped_table", r"""with m as (select n_nationkey::int as ord, n_name, case n_nationkey % 3 when 0 then 'Big ' || n_nationkey when 1 then n_nationkey || 'B' else 'table.plain' end as model from nation)
    select '\begin{table}[htbp]' || chr(10) || '\centering' || chr(10) || '\caption{All}' || chr(10) || '\label{tab:all}' || chr(10) || '\begin{tabular}{lr}' || chr(10) || '\toprule' || chr(10)
      || string_agg('\multicolumn{2}{@{}l@{}}{\textbf{' || model || '}} \\' || chr(10) || n_name || ' & 1 \\', chr(10) || '\midrule' || chr(10) order by ord) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' || chr(10) || '\end{table}' || chr(10) as content from m""")
def grouped_table(spark, sf):
    """All fragments' tables as one, grouped by model."""
    return P.unique_labels(P.grouped_table(P.fragment_rows(_fragments(spark, sf)), "All", "tab:all", "lr", ["\\toprule"], 2), "the grouped table")


@query("str20_macros_and_labels", r"""with n as (select n_nationkey::int as ord, n_name from nation), f as (select min(ord) as first from n)
    select 'macro' as kind, ord, '\newcommand{\own' || n_name || '}{x}' as value from n union all select 'macro', first, '\newcommand{\shared}{' || first || '}' from f union all select 'label', ord, 'tab:' || ord from n
    union all select 'repeated', ord, 'tab:' || ord from n where ord % 2 = 0""")
def macros_and_labels(spark, sf):
    """Macros of all fragments, of one name the first; labels; those that are there twice where every other fragment is doubled."""
    f = _fragments(spark, sf)
    macros = P.merged_macros(f).filter(F.startswith("line", F.lit("\\newcommand"))).select(F.lit("macro").alias("kind"), "ord", F.col("line").alias("value"))
    labels = f.select(F.lit("label").alias("kind"), "ord", F.explode(T.labels(F.col("content"))).alias("value"))
    twice = f.withColumn("content", F.when(F.col("ord") % 2 == 0, F.concat("content", "content")).otherwise(F.col("content")))
    return macros.unionByName(labels).unionByName(twice.select(F.lit("repeated").alias("kind"), "ord", F.explode(T.repeated_labels(F.col("content"))).alias("value")))


@query("prj05_first_filled", "select vec_id, case when label % 2 = 0 then 'even' else 'l' || label end as name from embeddings")
def first_filled(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select("vec_id", C.first_filled(F.when(F.col("label") % 2 == 0, "even").when(F.col("label") % 3 != 0, ""), F.concat(F.lit("l"), F.col("label"))).alias("name"))
