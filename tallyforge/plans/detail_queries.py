"""Queries on detail records: what probes and embeddings state, totals by record, the quality gate, curated problems, answers' reliability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import casts as C
from tallyforge.functions import losses as L
from tallyforge.functions import text as T
from tallyforge.operators import analysis as A
from tallyforge.operators import curated as K
from tallyforge.operators import presentation as R
from tallyforge.operators import prototypes as P
from tallyforge.operators import statistics as S
from tallyforge.plans import digit_queries as DQ
from tallyforge.plans import text_queries as TQ
from tallyforge.plans import views as V
from tallyforge.plans.registry import query
from tallyforge.plans.stat_queries import _OWN, _R, _SEB, PROBED, probed
from tallyforge.sources.scratch import written

_SHARES = ("DD", "OT", "RC", "STYLE")


def records(spark, sf):
    """`probed` rows with what detail records hold besides: stored deltas, stated resolutions, an embedding's shares (some incomplete) and label."""
    kind = V.draw("e", F.col("id"), 11)
    shares = F.create_map(*(x for k in _SHARES for x in (F.lit(k), F.when((kind == 1) & (F.lit(k) == "STYLE"), "n/a").otherwise((V.draw("e" + k, F.col("id"), 100) / 400.0).cast("string")))))
    rows = probed(spark, sf).withColumn("stored", F.when(kind != 0, shares)).withColumn("embedding_mass", L.stored_mass(F.col("stored"), _SHARES))
    stated = F.when(kind == 2, " decomposition")
    rows = rows.withColumns({"embedding_label": L.embedding_label(stated, F.col("embedding_mass")), "embedding_resolved": F.when(kind == 3, False), "probe_resolved": F.when(kind == 5, False)})
    return rows.withColumns({f"delta_{k}": F.when(kind != 4, F.col(f"loss_{k}") - F.col("loss_neutral")) for k in ("dd", "ot", "rc")})


_TOP = "greatest(e_dd, e_ot, e_rc, e_style)"
RECORDS = f"""{PROBED}, r0 as (select *, {V.s_draw('e', 'id', 11)} as kind, {', '.join(f"{V.s_draw('e' + k, 'id', 100)} / 400.0::double as s_{k.lower()}" for k in _SHARES)} from probed),
  r1 as (select *, {', '.join(f"case when kind not in (0, 1) then s_{k.lower()} end as e_{k.lower()}" for k in _SHARES)}, {', '.join(f"case when kind <> 4 and isfinite(loss_{k}) and isfinite(loss_neutral) then loss_{k} - loss_neutral end as delta_{k}" for k in ('dd', 'ot', 'rc'))},
    case when kind = 5 then false else mass_dd is not null end as probe, case when kind = 3 then false else kind not in (0, 1) end as traced from r0),
  records as (select *, case when kind = 2 then 'DD' when e_dd is null then 'UNKNOWN' when e_dd = {_TOP} then 'DD' when e_ot = {_TOP} then 'OT' when e_rc = {_TOP} then 'RC' else 'STYLE' end as embedding_label from r1)"""


def _mean(x: str, name: str) -> str:
    ok = f"case when isfinite({x}) then {x} end"
    return f"coalesce(avg({ok}), 0) as {name}, coalesce(stddev_samp({ok}) / sqrt(count({ok})), 0) as {name}_se"


@query("agg05_record_totals", f"""with {RECORDS} select count(*) as n, {_R('is_correct')} as accuracy, {_SEB('is_correct')} as accuracy_se, {', '.join(_mean(f'loss_{k}', f'loss_{k}') for k in ('dd', 'ot', 'rc', 'neutral'))},
    {', '.join(f'avg(delta_{k}) as delta_{k}' for k in ('dd', 'ot', 'rc'))}, count_if(probe) as resolved, {_R('probe')} as resolved_rate, {_SEB('probe')} as resolved_se, count_if(traced) as traced, {_R('traced')} as traced_rate, {_SEB('traced')} as traced_se from records""")
def record_totals(spark, sf):
    return A.record_totals(records(spark, sf))


_EOWN = _OWN.replace("mass_", "e_")


@query("agg05_record_families", f"""with {RECORDS} select design_family, count(*) as n, {_R('detected = design_family')} as detection, {_SEB('detected = design_family')} as detection_se,
    count_if(mass_dd is not null) as target_n, {_R('mass_dd is not null')} as target_coverage, {_SEB('mass_dd is not null')} as target_coverage_se, {_mean(f'({_OWN})', 'target_support')},
    count_if(e_dd is not null) as embedding_n, {_R('e_dd is not null')} as embedding_coverage, {_SEB('e_dd is not null')} as embedding_coverage_se, {_mean(f'({_EOWN})', 'embedding_support')},
    avg(case when e_dd is not null then case when embedding_label = design_family then 1.0::double else 0.0 end end) as embedding_detection,
    sqrt(avg(case when e_dd is not null then case when embedding_label = design_family then 1.0::double else 0.0 end end) * (1 - avg(case when e_dd is not null then case when embedding_label = design_family then 1.0::double else 0.0 end end)) / count(e_dd)) as embedding_detection_se
    from records group by 1""")
def record_families(spark, sf):
    return A.record_families(records(spark, sf))


@query("stat09_embedding_mass", f"with {RECORDS} select id, embedding_label, e_dd, e_style from records")
def embedding_mass(spark, sf):
    return records(spark, sf).select("id", "embedding_label", F.col("embedding_mass.DD").alias("e_dd"), F.col("embedding_mass.STYLE").alias("e_style"))


@query("prj15_probe_metadata", f"with {RECORDS} select id, probe as resolved, case when kind = 5 then 'timeout' end as status, kind as tokens, mass_neutral from records")
def probe_metadata(spark, sf):
    kind = V.draw("e", F.col("id"), 11)
    losses = {k: F.col(f"loss_{k.lower()}") for k in L.ORDER}
    m = L.probe_metadata(losses, F.col("loss_neutral"), F.col("probe_resolved"), F.when(kind == 5, "timeout"), F.lit(None).cast("string"), kind)
    return records(spark, sf).select("id", m.alias("m")).select("id", "m.resolved", "m.status", "m.tokens", F.col("m.mass.NEUTRAL").alias("mass_neutral"))


@query("prj06_agreed_label", f"with {PROBED} select id, detected as label, confidence from probed")
def agreed_label(spark, sf):
    """Labels that two columns state, in long and short names, one of them empty at times."""
    rows = probed(spark, sf).withColumn("kind", V.draw("j", F.col("id"), 3))
    long = F.coalesce(*(F.when(F.col("detected") == k, n) for k, n in (("OT", "ones_then_tens"), ("DD", "Decomposition "), ("RC", "ROUNDING_COMPENSATION"))), F.col("detected"))
    stated, other = F.when(F.col("kind") != 0, long).otherwise(""), F.when(F.col("kind") != 1, F.col("detected"))
    sure = F.col("confidence").cast("string")
    return rows.select("id", L.agreed(stated, other, "label").alias("label"), L.stated_confidence(F.when(F.col("kind") == 0, sure).otherwise("nan"), sure).alias("confidence"))


@query("agg07_quality_gate", f"""with {PROBED}, t as (select count(*) as total, count_if(detected = 'UNKNOWN') as unknown_count, count_if(mass_dd is not null) as resolved_probe_count from probed)
    select total, unknown_count, resolved_probe_count, case when unknown_count > 0.5 * total then 'invalid' when unknown_count > 0.1 * total then 'degraded' else 'ok' end as quality_status from t""")
def quality_gate(spark, sf):
    return A.require_quality(A.overview(probed(spark, sf))).select("total", "unknown_count", "resolved_probe_count", "quality_status")


@query("stat14_loss_vectors", f"with {V.OUTPUTS}, v as ({' union all '.join(f'select {chr(39)}{k}{chr(39)} as label, id, loss_{k.lower()} as loss from outputs' for k in L.ORDER)}) select label, id, loss from v where isfinite(loss)")
def loss_vectors(spark, sf):
    return A.loss_vectors(V.outputs(spark, sf))


@query("prj21_without_templates", f"with {V.PROBLEMS} select id, a, b from problems")
def without_templates(spark, sf):
    rows = V.problems(spark, sf)
    return A.without(rows.select("id", "a", "b", F.col("split").alias("template_a"), F.col("band").alias("template_b")))


_RANK = "list_sort([{'cost': ot, 'i': 0, 'n': 'OT'}, {'cost': dd, 'i': 1, 'n': 'DD'}, {'cost': rc, 'i': 2, 'n': 'RC'}]) as o"
_QUOTE = lambda s: "'" + s.replace("'", "''") + "'"


@query("gen09_curated_audit", f"""with s as (select * from (values {', '.join(f"({i}, {a}::bigint, {b}::bigint, '{k}', '{c}', {_QUOTE(n)})" for i, (a, b, k, c, n) in enumerate(K.SPECS))}) t(nth, a, b, expected, category, notes)),
    f as (select *, row_number() over (partition by least(a, b), greatest(a, b) order by nth) as rn, ({DQ._len('a')} + {DQ._len('b')}) * ({V.s_nonzero('a')} + {V.s_nonzero('b')}) as c from s),
    g as (select *, {DQ._OT} as ot, {DQ._DD} as dd, {DQ._RC} as rc from f where rn = 1), h as (select *, {_RANK} from g),
    k as (select *, case when c between 12 and 324 and o[2].cost - o[1].cost >= 0.5 then o[1].n end as scored from h)
    select nth, a, b, expected, scored, case when c not between 12 and 324 then 'out_of_range' when scored = expected then 'item' else 'overridden' end as verdict,
      case when c not between 12 and 324 or scored = expected then notes else notes || ' | curated_override expected ' || expected || ', scored ' || coalesce(scored, 'NONE') end as notes from k""")
def curated_audit(spark, sf):
    return K.audit(K.specs(spark), override=True).select("nth", "a", "b", "expected", "scored", "verdict", "notes")


@query("gen09_items", f"""with {V.PROBLEMS}, g as (select id, a, b, product, complexity_c, design_family as f, {DQ._OT} as ot, {DQ._DD} as dd, {DQ._RC} as rc from problems where complexity_c between 12 and 324 and length(cast(a as varchar)) between 2 and 9 and length(cast(b as varchar)) between 2 and 9),
    h as (select *, {_RANK} from g) select id, product, f as design_family, o[1].n as target, round(o[2].cost - o[1].cost, 9) as margin from h where o[2].cost - o[1].cost >= 0.75""")
def built_items(spark, sf):
    rows = V.problems(spark, sf).select("id", "a", "b", F.col("design_family").alias("f"))
    return K.items(rows, family="f").select("id", "product", "design_family", "target", F.round("margin", 9).alias("margin"))


@query("str13_confident", f"select strategy, count(*) as n, count_if(confidence >= 0.7 and not truncated) as confident from ({TQ._extract_sql()}) group by 1")
def confident(spark, sf):
    e = TQ._answers(spark, sf).select(T.extract_answer(F.col("said"), F.col("a"), F.col("b"), exact=True).alias("e"))
    sure = T.confident(F.col("e.confidence"), F.col("e.truncated"))
    return e.groupBy("e.strategy").agg(F.count("*").alias("n"), F.count_if(sure).alias("confident"))


@query("win08_most_confident", f"with {PROBED}, r as (select id, detected, confidence, row_number() over (partition by detected order by confidence desc, id) as rn from probed) select detected, id, confidence from r where rn = 1")
def most_confident(spark, sf):
    """The surest row of each label, as an aggregate: the least id of those of the highest confidence."""
    return A.surest(probed(spark, sf))


@query("agg19_template_contrast", f"""with {V.TEMPLATES}, w as (select *, {V.s_loss('wrong', 'tkey')} as wrong from (select *, label || '|' || template || '|' || id as tkey from template_losses))
    select label, template, count(*) as n, avg(loss) as right_mean, avg(wrong) as wrong_mean, avg(wrong - loss) as delta_mean from w where isfinite(loss) and isfinite(wrong) group by 1, 2""")
def template_contrast(spark, sf):
    """Right and wrong losses by label and template."""
    rows = V.template_losses(spark, sf).withColumn("wrong", V._loss("wrong", F.concat_ws("|", "label", F.col("template").cast("string"), "id")))
    return A.template_contrast(rows)



@query("emb01_embedded", f"""with {V.s_traces()}, c as (select id, {', '.join(f"(length(trace) - length(replace(trace, '{x}', '')))::double as c_{x}" for x in P.Letters().letters)} from traces),
    n as (select *, sqrt({' + '.join(f'c_{x} * c_{x}' for x in P.Letters().letters)}) as norm from c) select id, {', '.join(f'round(c_{x} / norm, 9) as {x}' for x in P.Letters().letters)} from n""")
def embedded(spark, sf):
    rows = P.embed(V.traces(spark, sf).select("id", "trace"), P.Letters(), "trace")
    return rows.select("id", *(F.round(F.get("embedding", F.lit(i)), 9).alias(x) for i, x in enumerate(P.Letters().letters)))


_SAID = f"case {V.s_draw('y', 'id', 5)} when 0 then '' when 1 then 'nothing' else trace end"
_LETTER_SHARES = "[" + ", ".join(f"(length(said) - length(replace(said, '{x}', '')))::double" for x in P.Letters().letters) + "]"


@query("str16_signals", f"""with {TQ._CLASSES}, t as (select id, split, trace_label as own, {_SAID} as said, a, b from traces),
    s as (select *, case when trim(said) = '' then 'trace_missing' when not (contains(said, cast(a as varchar)) or contains(said, cast(b as varchar))) then 'contaminated_trace' else 'ok' end as status from t),
    l as (select id, case when ot + dd + rc = 0 then null when ot >= dd and ot >= rc then 'OT' when dd >= rc then 'DD' else 'RC' end as label, case when ot + dd + rc > 0 then greatest(ot, dd, rc)::double / (ot + dd + rc) end as confidence from m),
    r as (select id, split, own, {_LETTER_SHARES} as c from s where status = 'ok'), v as (select id, split, own, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) as v from r),
    cell as (select own, pos, avg(x) as x from (select own, unnest(v) as x, generate_subscripts(v, 1) as pos from v where split = 'train') group by 1, 2), norm as (select own, sqrt(sum(x * x)) as norm from cell group by 1),
    dots as (select id, c.own, sum(e.x * c.x / n.norm) / 0.1::double as s from (select id, unnest(v) as x, generate_subscripts(v, 1) as pos from v) e join cell c using (pos) join norm n on n.own = c.own group by 1, 2),
    w as (select id, own, exp(s - max(s) over (partition by id)) as w from dots), p as (select id, own, w / sum(w) over (partition by id) as m from w), o as (select *, row_number() over (partition by id order by m desc, own) as rn from p),
    e as (select id, max(own) filter (where rn = 1) as label, max(m) filter (where rn = 1) as mass, max(m) filter (where rn = 1) - max(m) filter (where rn = 2) as margin from o group by 1)
    select s.id, case when s.said = trace then l.label end as trace_label, case when s.said = trace then l.confidence end as trace_confidence, status, status = 'ok' as resolved, e.label as embedding_label, round(e.mass, 6) as embedding_confidence, round(e.margin, 6) as embedding_margin
    from s join l using (id) join traces using (id) left join e using (id)""")
def trace_signals(spark, sf):
    """The wording's and the vector's signal of each trace, some of which are empty or say nothing; centroids of the training traces."""
    kind = V.draw("y", F.col("id"), 5)
    rows = V.traces(spark, sf).withColumn("said", F.when(kind == 0, "").when(kind == 1, "nothing").otherwise(F.col("trace")))
    # read twice, and a filter on what is worked out of a trace would be pushed into its expressions
    rows = written(rows.select("id", "split", "trace_label", "said", F.coalesce(T.contaminated(F.col("said"), F.col("a"), F.col("b")), F.lit(False)).alias("contaminated")), "said")
    fair = rows.filter("split = 'train' and trim(said) <> '' and not contaminated")
    centroids = P.fit(P.embed(fair, P.Letters(), "said").select(F.col("trace_label").alias("label"), "embedding"))
    out = P.trace_signals(rows, P.Letters(), centroids, trace="said")
    return out.withColumns({c: F.round(c, 6) for c in ("embedding_confidence", "embedding_margin")})


_DIGIT_WORDS = "Zero One Two Three Four Five Six Seven Eight Nine".split()
_LETTERS = "replace(replace(name || grp, '-', 'To'), '+', 'Plus')"
for _i, _w in enumerate(_DIGIT_WORDS):
    _LETTERS = f"replace({_LETTERS}, '{_i}', '{_w}')"


@query("pres01_macros", f"""with {PROBED}, m as (select 'Accuracy' as name, design_family as grp, {_R('is_correct')} as value, 'percent' as kind from probed group by 2
      union all select 'Loss', detected, avg(case when isfinite(loss_dd) then loss_dd end), 'loss' from probed group by 2
      union all select 'Delta', detected, avg(case when isfinite(loss_dd) and isfinite(loss_neutral) then loss_dd - loss_neutral end), 'delta' from probed group by 2
      union all select 'MeanC', coalesce(band, 'none'), avg(complexity_c::double), 'mean' from probed group by 2 union all select 'Count', split, count(*)::double, 'count' from probed group by 2),
    w as (select name, grp from m union all select 'Accuracy', 'STYLE'), j as (select {_LETTERS} as name, value, kind from w left join m using (name, grp))
    select name, chr(92) || 'newcommand{{' || chr(92) || name || '}}{{' || case when kind is null then '[PENDING]' when value is null then 'N/A' when kind = 'percent' then printf('%.1f', round(value * 100, 1)) || chr(92) || '%' when kind = 'loss' then printf('%.4f', round(value, 4))
      when kind = 'delta' then printf('%+.4f', round(value, 4)) when kind = 'mean' then printf('%.1f', round(value, 1)) else printf('%.0f', value) end || '}}' as line from j""")
def macros(spark, sf):
    """Metrics as lines of a report; one that is asked for but hasn't been measured is pending."""
    rows = probed(spark, sf)
    of = lambda name, grp, value, kind: rows.groupBy(grp.alias("grp")).agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "grp", "value", F.lit(kind).alias("kind"))
    finite = C.finite
    parts = [
        of("Accuracy", F.col("design_family"), S.rate(F.col("is_correct")), "percent"), of("Loss", F.col("detected"), F.avg(finite(F.col("loss_dd"))), "loss"),
        of("Delta", F.col("detected"), F.avg(finite(F.col("loss_dd") - finite(F.col("loss_neutral")))), "delta"), of("MeanC", F.coalesce("band", F.lit("none")), F.avg("complexity_c"), "mean"), of("Count", F.col("split"), F.count("*"), "count"),
    ]
    made = reduce(DataFrame.unionByName, parts)
    wanted = made.select("name", "grp").unionByName(spark.sql("select 'Accuracy' as name, 'STYLE' as grp"))
    return R.macros(made, wanted)
