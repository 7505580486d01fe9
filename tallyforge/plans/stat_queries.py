"""Queries on losses, rates, errors, joins, picks, prototypes and adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import losses as L
from tallyforge.functions import templates as M4
from tallyforge.operators import analysis as A
from tallyforge.operators import joins as J
from tallyforge.operators import prototypes as P
from tallyforge.operators import selection as X
from tallyforge.operators import similarity as M
from tallyforge.operators import statistics as S
from tallyforge.plans import digit_queries as DQ
from tallyforge.plans import views as V
from tallyforge.plans.registry import query

_FIN = lambda x: f"isfinite({x})"
_ALL = "isfinite(loss_dd) and isfinite(loss_ot) and isfinite(loss_rc) and loss_neutral is not null and isfinite(loss_neutral)"
_MASS = lambda k: f"case when {_ALL} then exp(-(loss_{k} - least(loss_dd, loss_ot, loss_rc, loss_neutral))) / (exp(-(loss_dd - least(loss_dd, loss_ot, loss_rc, loss_neutral))) + exp(-(loss_ot - least(loss_dd, loss_ot, loss_rc, loss_neutral))) + exp(-(loss_rc - least(loss_dd, loss_ot, loss_rc, loss_neutral))) + exp(-(loss_neutral - least(loss_dd, loss_ot, loss_rc, loss_neutral)))) end"
PROBED = f"""{V.OUTPUTS}, p1 as (select *, list_sort(list_filter([{{'loss': loss_ot, 'i': 0, 'l': 'OT'}}, {{'loss': loss_dd, 'i': 1, 'l': 'DD'}}, {{'loss': loss_rc, 'i': 2, 'l': 'RC'}}], lambda r: isfinite(r.loss))) as good,
    {_MASS('ot')} as mass_ot, {_MASS('dd')} as mass_dd, {_MASS('rc')} as mass_rc, {_MASS('neutral')} as mass_neutral from outputs),
  probed as (select *, coalesce(good[1].l, 'UNKNOWN') as detected, case when len(good) = 0 then 0.0::double when len(good) >= 2 and good[2].loss > 0 then least(1.0::double, 2 * (good[2].loss - good[1].loss) / good[2].loss) else 0.5::double end as confidence from p1)"""


def probed(spark, sf):
    return A.probed(V.outputs(spark, sf))


@query("stat07_support_mass", f"with {PROBED} select id, mass_dd, mass_ot, mass_rc, mass_neutral from probed")
def support_mass(spark, sf):
    return probed(spark, sf).select("id", *(F.col("mass")[k].alias(f"mass_{k.lower()}") for k in ("DD", "OT", "RC", "NEUTRAL")))


@query("stat08_detection", f"with {PROBED} select id, detected, confidence, case when len(good) = 3 then detected else 'UNKNOWN' end as strict from probed")
def detection(spark, sf):
    strict = L.detect({k: F.col(f"loss_{k.lower()}") for k in L.ORDER}, all_finite=True)["label"]
    return probed(spark, sf).select("id", "detected", "confidence", strict.alias("strict"))


@query("prj14_16_probe_status", f"""with {PROBED}, s as (select id, mass_dd is not null as resolved, [null, 'ok', 'retry_resolved', 'image_load_failed'][1 + {V.s_draw('st', 'id', 4)}] as said from probed)
    select resolved, case when not resolved and coalesce(said, 'unresolved') in ('ok', 'retry_resolved', 'fallback_resolved') then 'unresolved' else coalesce(said, case when resolved then 'ok' else 'unresolved' end) end as status, count(*) as n from s group by 1, 2""")
def probe_status(spark, sf):
    said = F.get(F.array(F.lit(None).cast("string"), F.lit("ok"), F.lit("retry_resolved"), F.lit("image_load_failed")), V.draw("st", F.col("id"), 4))
    s = L.probe_status({k: F.col(f"loss_{k.lower()}") for k in L.ORDER}, F.col("loss_neutral"), said)
    return V.outputs(spark, sf).select(s.alias("s")).groupBy("s.resolved", "s.status").agg(F.count("*").alias("n"))


_R = lambda c: f"coalesce(avg(case when {c} then 1.0::double else 0.0 end), 0)"
_NONFIN = "not isfinite(loss_ot) or not isfinite(loss_dd) or not isfinite(loss_rc) or (loss_neutral is not null and not isfinite(loss_neutral))"


@query("agg04_overview", f"""with {PROBED} select count(*) as total, count_if(is_correct) as correct, {_R('is_correct')} as accuracy, {_R('detected = design_family')} as family_match_rate, count_if(detected = 'UNKNOWN') as unknown_count, {_R("detected = 'UNKNOWN'")} as unknown_rate,
    count_if({_NONFIN}) as nonfinite_loss_count, count_if(mass_dd is not null) as resolved_probe_count, {', '.join(f'avg(loss_{k}) filter (where isfinite(loss_{k})) as avg_loss_{k}' for k in ('ot', 'dd', 'rc', 'neutral'))},
    {', '.join(f'avg(loss_{k} - loss_neutral) filter (where isfinite(loss_{k}) and isfinite(loss_neutral)) as avg_delta_{k}' for k in ('ot', 'dd', 'rc'))},
    case when {_R("detected = 'UNKNOWN'")} > 0.5 then 'invalid' when {_R("detected = 'UNKNOWN'")} > 0.1 then 'degraded' else 'ok' end as quality_status from probed""")
def overview(spark, sf):
    return A.overview(probed(spark, sf))


_SEB = lambda c: f"sqrt({_R(c)} * (1 - {_R(c)}) / count(*))"
_OWN = "case design_family when 'DD' then mass_dd when 'OT' then mass_ot else mass_rc end"


@query("agg04_05_by_family", f"""with {PROBED} select design_family, count(*) as total, count_if(is_correct) as correct, {_R('is_correct')} as accuracy, {_SEB('is_correct')} as accuracy_se, {_R('detected = design_family')} as family_match_rate,
    count_if(mass_dd is not null) as resolved, {_R('mass_dd is not null')} as coverage_rate, {_SEB('mass_dd is not null')} as coverage_se, avg({_OWN}) as target_support_mean, stddev_samp({_OWN}) / sqrt(count({_OWN})) as target_support_se from probed group by 1""")
def by_family(spark, sf):
    return A.by_family(probed(spark, sf))


@query("agg06_confusion", f"""with {PROBED}, c as (select design_family, count_if(detected = 'RC') as rc, count_if(detected = 'DD') as dd, count_if(detected = 'OT') as ot from probed group by 1)
    select design_family, 100.0::double * rc / (rc + dd + ot) as pct_rc, 100.0::double * dd / (rc + dd + ot) as pct_dd, 100.0::double * ot / (rc + dd + ot) as pct_ot, rc + dd + ot as n from c""")
def confusion(spark, sf):
    return A.confusion(probed(spark, sf))


@query("agg08_detection_summary", f"with {PROBED} select detected, count(*) as n, avg(confidence) as mean_confidence from probed group by 1")
def detection_summary(spark, sf):
    return probed(spark, sf).groupBy("detected").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


@query("agg01_02_counts", f"with {V.PROBLEMS} select split, design_family, grouping_id(split, design_family) as level, count(*) as n from problems group by cube (split, design_family)")
def counts(spark, sf):
    return V.problems(spark, sf).cube("split", "design_family").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("agg03_band_histogram", f"""with {V.PROBLEMS}, b as (select * from (values {', '.join(f"({i}, '{lo}-{hi}')" for i, (lo, hi) in enumerate(DQ.D.BANDS))}) t(ord, band))
    select ord, b.band, count(p.id) as n from b left join problems p on p.band = b.band group by 1, 2""")
def band_histogram(spark, sf):
    return A.band_histogram(V.problems(spark, sf))


_TMEAN = f"{V.TEMPLATES}, tm as (select id, label, coalesce(avg(loss) filter (where isfinite(loss)), 'inf'::double) as loss, case when count(*) filter (where isfinite(loss)) >= 2 then stddev_pop(case when isfinite(loss) then loss end) end as spread from template_losses group by 1, 2)"


@query("agg17_template_means", f"with {_TMEAN} select id, label, loss, spread from tm")
def template_means(spark, sf):
    return A.template_means(V.template_losses(spark, sf))


@query("agg09_template_variability", f"with {_TMEAN} select label, avg(spread) as mean_std, count(spread) as n from tm group by 1")
def template_variability(spark, sf):
    return A.template_variability(V.template_losses(spark, sf))


@query("emb06_template_probe", f"""with {_TMEAN}, r as (select id, list_sort(list_filter(list({{'loss': loss, 'i': case label when 'OT' then 0 when 'DD' then 1 else 2 end, 'l': label}}), lambda x: isfinite(x.loss))) as good from tm group by id)
    select id, coalesce(good[1].l, 'UNKNOWN') as label, case when len(good) = 0 then 0.0::double when len(good) >= 2 and good[2].loss > 0 then least(1.0::double, 2 * (good[2].loss - good[1].loss) / good[2].loss) else 0.5::double end as confidence from r""")
def template_probe(spark, sf):
    one = A.template_means(V.template_losses(spark, sf)).groupBy("id").agg(*(F.max(F.when(F.col("label") == k, F.col("loss"))).alias(k) for k in L.ORDER))
    return one.select("id", L.detect({k: F.col(k) for k in L.ORDER}).alias("d")).select("id", "d.label", "d.confidence")


def _contrast(spark, sf):
    rows = V.outputs(spark, sf)
    return rows.select("id", F.col("canonical_target").alias("target"), F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"loss_{k.lower()}").alias("right"), V._loss("x" + k, F.col("id")).alias("wrong")) for k in L.ORDER))).alias("x")).select("id", "target", "x.label", "x.right", "x.wrong")


_CONTRAST = f"""{V.OUTPUTS}, c1 as ({' union all '.join(f"select id, canonical_target as target, '{k}' as label, loss_{k.lower()} as r, {V.s_loss('x' + k, 'id')} as w from outputs" for k in L.ORDER)}), c2 as (select * from c1 where isfinite(r) and isfinite(w))"""


@query("agg10_contrastive", f"""with {_CONTRAST} select label, target, grouping_id(label, target) as level, count(*) as n, avg(r) as right_mean, coalesce(stddev_samp(r) / sqrt(count(*)), 0) as right_se, avg(w) as wrong_mean, avg(w - r) as delta_mean,
    coalesce(stddev_samp(w - r) / sqrt(count(*)), 0) as delta_se, avg(case when r < w then 1.0::double else 0.0 end) as preference_rate from c2 group by grouping sets ((label), (target), ())""")
def contrastive(spark, sf):
    return A.contrastive(_contrast(spark, sf))


@query("prj09_preference", f"with {_CONTRAST} select id, label, case when isfinite(r) and isfinite(w) then r < w end as prefers from c1")
def preference(spark, sf):
    return _contrast(spark, sf).select("id", "label", L.preference(F.col("right"), F.col("wrong")).alias("prefers"))


FLIPS = f"""{V.VARIANTS}, flips as (select *, case when base_correct is null or lora_correct is null then 'unknown' when base_correct = lora_correct then 'unchanged' when lora_correct then 'improved' else 'degraded' end as flip, base_detected <> lora_detected as det from variants)"""


def flips(spark, sf):
    return A.flips(V.variants(spark, sf))


@query("prj11_13_flips", f"with {FLIPS} select id, lora, flip as correctness_flip, det as detection_flip from flips")
def flip_rows(spark, sf):
    return flips(spark, sf).select("id", "lora", "correctness_flip", "detection_flip")


_CH = "flip in ('improved', 'degraded')"


@query("agg11_flip_analysis", f"""with {FLIPS} select lora, count(*) as total, count_if({_CH}) as flips, count_if(flip = 'improved') as improved, count_if(flip = 'degraded') as degraded, count_if(flip = 'unchanged') as unchanged, count_if(flip = 'unknown') as unknown, count_if(det) as detection_flips,
    count_if(det and {_CH}) as det_corr, count_if(det and flip = 'unchanged') as det_only, count_if(det and flip = 'unknown') as det_unknown, count_if(not det and {_CH}) as corr_only, count_if(not det and flip = 'unchanged') as neither, count_if(not det and flip = 'unknown') as same_unknown from flips group by 1""")
def flip_analysis(spark, sf):
    return A.flip_analysis(flips(spark, sf))


@query("agg11_flips_by_family", f"""with {FLIPS} select lora, design_family, count(*) as total, count_if(base_correct) as base_correct, count_if(lora_correct) as lora_correct, count_if(base_correct is null) as base_unknown, count_if(lora_correct is null) as lora_unknown,
    count_if(base_correct is not null and lora_correct is not null) as paired_known, count_if(flip = 'improved') as improved, count_if(flip = 'degraded') as degraded from flips group by 1, 2""")
def flips_by_family(spark, sf):
    return A.flips_by_family(flips(spark, sf))


@query("agg11_detection_changes", f"with {FLIPS} select lora, base_detected || '->' || lora_detected as change, count(*) as n from flips where det group by 1, 2")
def detection_changes(spark, sf):
    return A.detection_changes(flips(spark, sf))


@query("agg12_taxonomy_rollup", f"""with {FLIPS}, k as (select flip, {DQ._KIND('base_answer')} as bk, {DQ._KIND('lora_answer')} as lk from flips where lora <> 'STYLE'),
    s as (select 'base' as side, bk as kind from k union all select 'lora', lk from k union all select 'degraded', lk from k where flip = 'degraded' union all select 'improved', lk from k where flip = 'improved') select side, kind, count(*) as n from s group by 1, 2""")
def taxonomy_rollup(spark, sf):
    return A.taxonomy_rollup(A.flips(V.variants(spark, sf, base_kind=True)))


@query("agg13_headline", f"with {FLIPS} select count_if({_CH}) as flips, count_if(det) as detection_flips, count(*) as comparisons from flips where lora <> 'STYLE'")
def headline(spark, sf):
    return A.flip_analysis(A.of_adapters(flips(spark, sf), list(V.LABELS))).agg(F.sum("flips").alias("flips"), F.sum("detection_flips").alias("detection_flips"), F.sum("total").alias("comparisons"))


@query("agg14_mismatch_share", f"with {PROBED} select count(*) as mismatches, avg(case when detected = 'DD' then 1.0::double else 0.0 end) as share from probed where detected <> design_family")
def mismatch_share(spark, sf):
    return A.mismatch_to(probed(spark, sf))


@query("agg15_first_known", f"""with {V.VARIANTS}, f as (select id, lora_correct, row_number() over (partition by id order by lora) as rn from variants where lora_correct is not null) select count(*) as ids, avg(case when lora_correct then 1.0::double else 0.0 end) as rate from f where rn = 1""")
def first_known(spark, sf):
    return X.first_by(V.variants(spark, sf).filter("lora_correct is not null"), ["id"], ["lora"]).agg(F.count("*").alias("ids"), S.rate(F.col("lora_correct")).alias("rate"))


@query("agg20_token_loss", """select vec_id, -list_sum(list_transform(embedding, lambda x, i: x::double * (i % 3))) / list_sum(list_transform(embedding, lambda x, i: (i % 3)::double)) as loss from embeddings""")
def token_loss(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("lp"), F.transform("embedding", lambda x, i: ((i + 1) % 3).cast("double")).alias("w"))
    return e.select("vec_id", L.token_loss(F.col("lp"), F.col("w")).alias("loss"))


def _log(spark, sf):
    o = V.table(spark, sf, "orders").select((F.col("o_orderkey") % 97).alias("run"), (F.floor(F.col("o_orderkey") / 97) % 12).alias("epoch"), F.col("o_totalprice").alias("val_loss"))
    return o.groupBy("run", "epoch").agg(F.min("val_loss").alias("val_loss"))


@query("agg21_best_epoch", """with l as (select o_orderkey % 97 as run, (o_orderkey // 97) % 12 as epoch, min(o_totalprice) as val_loss from orders group by 1, 2),
    b as (select *, min(val_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before, min(val_loss) over (partition by run order by epoch) as best from l),
    n as (select *, before is null or val_loss < before as is_best from b), t as (select *, max(case when is_best then epoch end) over (partition by run order by epoch rows unbounded preceding) as lb from n),
    s as (select *, min(case when epoch - lb >= 2 then epoch end) over (partition by run) as stop from t) select run, epoch, val_loss, best, is_best, coalesce(epoch > stop, false) as stopped from s""")
def best_epoch(spark, sf):
    return A.best_epoch(_log(spark, sf))


@query("stat01_02_errors", f"""with {V.OUTPUTS} select design_family, count(*) as n, avg(case when is_correct then 1.0::double else 0.0 end) as p, sqrt(avg(case when is_correct then 1.0::double else 0.0 end) * (1 - avg(case when is_correct then 1.0::double else 0.0 end)) / count(*)) as p_se,
    avg(cast(complexity_c as double)) as c, stddev_samp(complexity_c) / sqrt(count(*)) as c_se from outputs group by 1""")
def errors(spark, sf):
    return V.outputs(spark, sf).groupBy("design_family").agg(F.count("*").alias("n"), S.rate(F.col("is_correct")).alias("p"), S.binary_se(F.col("is_correct")).alias("p_se"), F.avg("complexity_c").alias("c"), S.mean_se(F.col("complexity_c")).alias("c_se"))


@query("stat03_ratio_se", f"""with {V.OUTPUTS}, f as (select design_family, loss_dd as x, loss_neutral as y from outputs where isfinite(loss_dd) and isfinite(loss_neutral)),
    s as (select design_family, count(*) as n, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as cxy from f group by 1)
    select design_family, sqrt((100 / my) ** 2 * vx / n + (100 * mx / my ** 2) ** 2 * vy / n - 2 * (100 / my) * (100 * mx / my ** 2) * cxy / n) as se, (mx - my) / my * 100 as gap from s""")
def ratio_se(spark, sf):
    x, y = L.finite(F.col("loss_dd")), L.finite(F.col("loss_neutral"))
    rows = V.outputs(spark, sf).select("design_family", F.when(y.isNotNull(), x).alias("x"), F.when(x.isNotNull(), y).alias("y"))
    return rows.groupBy("design_family").agg(S.percent_ratio_se(F.col("x"), F.col("y")).alias("se"), S.percent_gap(F.avg("x"), F.avg("y")).alias("gap"))


@query("stat05_pearson", f"with {V.OUTPUTS} select design_family, corr(loss_dd, loss_ot) as r, 0.0::double as flat from outputs where isfinite(loss_dd) and isfinite(loss_ot) group by 1")
def pearson(spark, sf):
    rows = V.outputs(spark, sf).filter(L.finite(F.col("loss_dd")).isNotNull() & L.finite(F.col("loss_ot")).isNotNull())
    return rows.groupBy("design_family").agg(S.pearson(F.col("loss_dd"), F.col("loss_ot")).alias("r"), S.pearson(F.col("loss_dd"), F.lit(1.0)).alias("flat"))


_WEIGHT = " + ".join(f"(u >= {int(p * S.PRIME)})::int" for p in S.POISSON)


@query("stat04_bootstrap", f"""with {PROBED}, r as (select design_family, (detected = design_family)::int::double as v, {V.s_draw('42', 'id', S.PRIME)}::bigint as h from probed), d as (select range as d, (42::bigint * 48271 + range * 1103515245) % {S.PRIME - 1} + 1 as f, (42::bigint * 69621 + range * 12345701) % {S.PRIME} as s from range(1, 1001)),
    m as (select design_family, d, sum(({_WEIGHT}) * v) / sum({_WEIGHT}) as m from (select design_family, v, d, (h * f + s) % {S.PRIME} as u from r, d) group by 1, 2), e as (select design_family, avg(v) as estimate from r group by 1)
    select design_family, any_value(estimate) as estimate, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m join e using (design_family) group by 1""")
def bootstrap(spark, sf):
    rows = probed(spark, sf).select("id", "design_family", (F.col("detected") == F.col("design_family")).cast("double").alias("hit"))
    return S.bootstrap(rows, "hit", "design_family")


_SUFFIX = lambda by, src="outputs": f"""w as (select * exclude (k), unnest([1, 2, 3, 4]) as k from {src} where model_answer > 0 and model_answer <> product) select {by}k, count(*) as n, avg(case when model_answer % [10, 100, 1000, 10000][k] = product % [10, 100, 1000, 10000][k] then 1.0::double else 0.0 end) as rate from w group by all"""


@query("stat12_suffix", f"with {V.OUTPUTS}, {_SUFFIX('')}")
def suffix(spark, sf):
    return S.suffix_rates(V.outputs(spark, sf), [])


@query("stat12_suffix_by_band", f"with {V.OUTPUTS}, {_SUFFIX('band, ')}")
def suffix_by_band(spark, sf):
    return S.suffix_rates(V.outputs(spark, sf), ["band"])


@query("stat12_suffix_by_label", f"with {PROBED}, {_SUFFIX('detected, ', 'probed')}")
def suffix_by_label(spark, sf):
    return S.suffix_rates(probed(spark, sf), ["detected"])


@query("stat13_modulo", f"""with {V.OUTPUTS}, w as (select *, unnest([2, 5, 9, 10]) as modulus from outputs where model_answer > 0), x as (select modulus, model_answer = product as ok, model_answer % modulus = product % modulus as same from w)
    select modulus, count_if(not ok) as n_wrong, avg(case when same then 1.0::double else 0.0 end) filter (where not ok) as wrong_rate, count_if(ok) as n_right, avg(case when same then 1.0::double else 0.0 end) filter (where ok) as right_rate from x group by 1""")
def modulo(spark, sf):
    return S.modulo_rates(V.outputs(spark, sf))


# ---------------------------------------------------------------- joins


def _train(spark, sf):
    """Problems asked for again, the factors the other way round for every second."""
    p = V.problems(spark, sf)
    swap = F.col("k") % 2 == 0
    return p.select("id", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


_LEAK = f"""{V.PROBLEMS}, tr as (select id, case when k % 2 = 0 then b else a end as a, case when k % 2 = 0 then a else b end as b from problems),
    ex as (select distinct least(a, b) as lo, greatest(a, b) as hi from problems where split = 'test' and a <> 0 and b <> 0)"""


@query("join01_leakage_anti", f"with {_LEAK} select id, a, b from tr where not exists (select 1 from ex where ex.lo = least(tr.a, tr.b) and ex.hi = greatest(tr.a, tr.b))")
def leakage_anti(spark, sf):
    return J.without_leaks(_train(spark, sf), V.problems(spark, sf))


@query("join02_leakage_semi", f"with {_LEAK} select id, a, b from tr where exists (select 1 from ex where ex.lo = least(tr.a, tr.b) and ex.hi = greatest(tr.a, tr.b))")
def leakage_semi(spark, sf):
    return J.leaks(_train(spark, sf), V.problems(spark, sf).filter("split = 'test'"))


@query("join03_evaluated", f"""with {V.PROBLEMS}, i as (select id from problems where split = 'val' union select id from problems where split = 'test') select count(*) as count, round(avg(cast(complexity_c as double)), 1) as mean_c from problems where id in (select id from i)""")
def evaluated(spark, sf):
    p = V.problems(spark, sf)
    return J.evaluated(p, p.filter("split = 'val'"), p.filter("split = 'test'"))




@query("join04_05_modalities", f"""with {PROBED}, vv as (select id, split, lora, {V.s_one_of((*V.LABELS, 'UNKNOWN'), V.s_draw('d', "lora || '|' || id", 4))} as ld from problems cross join (select unnest({list(V.ADAPTERS)}) as lora)),
    im as (select id, ld, row_number() over (partition by id order by lora desc) as rn from vv where split <> 'val')
    select p.id, p.detected, im.ld as image_detected, p.detected <> im.ld as flip from probed p join im on im.id = p.id and im.rn = 1""")
def modalities(spark, sf):
    ord_ = F.array_position(F.array(*(F.lit(x) for x in V.ADAPTERS)), F.col("lora"))
    image = V.variants(spark, sf).filter("split <> 'val'").select("id", F.col("lora_detected").alias("detected"), ord_.alias("ord"))
    return J.modality_flips(probed(spark, sf), image)


@query("join07_star", f"""with {FLIPS} select id, any_value(base_answer) as base_answer, string_agg(lora || '=' || coalesce(cast(lora_answer as varchar), '') || '/' || flip, ';' order by lora) as arms from flips group by id""")
def star(spark, sf):
    out = J.star(V.outputs(spark, sf), flips(spark, sf))
    arms = F.transform(F.array_sort(F.map_entries("arms")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["answer"].cast("string"), F.lit("")), F.lit("/"), e["value"]["flip"]))
    return out.select("id", "base_answer", F.array_join(arms, ";").alias("arms"))


@query("join06_08_pivot", f"""with {FLIPS} select id, {', '.join(f"max(flip) filter (where lora = '{x}') as {x}" for x in V.ADAPTERS)} from flips group by id""")
def pivot(spark, sf):
    return J.pivot_variants(flips(spark, sf), list(V.ADAPTERS))


@query("join12_template_grid", f"""with {V.PROBLEMS}, t as (select * from (values {', '.join(f"('{k}', {i}, '{x}')" for k, xs in M4.BANKS['balanced'].items() for i, x in enumerate(xs))}, ('NEUTRAL', 0, '{M4.NEUTRAL}')) t(label, nth, text))
    select design_family, label, nth, count(*) as n, sum(length(text) + length(id)) as letters from problems cross join t group by 1, 2, 3""")
def template_grid(spark, sf):
    grid = J.template_grid(V.problems(spark, sf).select("id", "design_family"), M4.bank(spark), M4.NEUTRAL)
    return grid.groupBy("design_family", "label", "nth").agg(F.count("*").alias("n"), F.sum(F.length("text") + F.length("id")).alias("letters"))


@query("win12_alignment", f"with {V.PROBLEMS}, l as (select distinct a as key from problems where split = 'train'), r as (select distinct a as key from problems where split = 'test') select coalesce(l.key, r.key) as key, case when r.key is null then 'missing' else 'extra' end as side from l full join r on l.key = r.key where l.key is null or r.key is null")
def alignment(spark, sf):
    p = V.problems(spark, sf).select(F.col("a").alias("key"), "split")
    return J.alignment(p.filter("split = 'train'"), p.filter("split = 'test'"), "key")


@query("win11_union_ids", f"with {V.PROBLEMS} select id from problems where split = 'test' union select id from problems where design_family = 'DD'")
def union_ids(spark, sf):
    p = V.problems(spark, sf)
    return p.filter("split = 'test'").select("id").union(p.filter("design_family = 'DD'").select("id")).distinct()


# ---------------------------------------------------------------- selection

_UNIT = lambda salt, key: f"(({V.s_draw(salt, key, 1000003)} + 0.5::double) / 1000003.0::double)"


@query("win02_weighted_sample", f"with {V.PROBLEMS} select id, complexity_c from problems order by ln({_UNIT('w', 'id')}) / greatest(complexity_c, 1) desc, id limit 100")
def weighted_sample(spark, sf):
    return X.weighted_sample(V.problems(spark, sf), F.col("complexity_c"), 100).select("id", "complexity_c")


@query("win03_stratified_quota", f"with {V.PROBLEMS}, r as (select id, complexity_c, row_number() over (partition by complexity_c order by {V.s_draw('q', 'id')}, id) as rank from problems) select id, complexity_c from r where rank <= 5")
def stratified_quota(spark, sf):
    return X.by_quota(V.problems(spark, sf), "complexity_c", F.lit(5)).select("id", "complexity_c")


@query("win05_06_numbering", f"""with {V.PROBLEMS} select id, 'hds_' || lpad(cast(row_number() over (order by design_family, complexity_c, a, b, id) - 1 as varchar), 6, '0') as new_id from problems""")
def numbering(spark, sf):
    return X.numbered(V.problems(spark, sf).select("design_family", "complexity_c", "a", "b", "id"), ["design_family", "complexity_c", "a", "b", "id"], "hds_", 6).select("id", "new_id")


@query("win07_08_examples", f"""with {PROBED}, one as (select id from probed where is_correct order by id limit 1), two as (select id from probed where detected = 'UNKNOWN' and id not in (select id from one) order by id limit 1),
    three as (select id from probed where confidence > 0.5 and id not in (select id from one union select id from two) order by id limit 1), got as (select id, 'correct' as criterion from one union all select id, 'unknown' from two union all select id, 'sure' from three),
    rest as (select id, 'fill' as criterion from probed where id not in (select id from got) order by id limit 2) select * from got union all select * from rest""")
def examples(spark, sf):
    rows = probed(spark, sf).select("id", "is_correct", "detected", "confidence")
    return X.pick_examples(rows, {"correct": F.col("is_correct"), "unknown": F.col("detected") == "UNKNOWN", "sure": F.col("confidence") > 0.5}).select("id", "criterion")


@query("win09_first_per_label", f"with {V.PROBLEMS}, r as (select *, row_number() over (partition by design_family order by k) as rn from problems where split = 'train') select design_family, id from r where rn = 1")
def first_per_label(spark, sf):
    return X.first_by(V.problems(spark, sf).filter("split = 'train'"), ["design_family"], ["k"]).select("design_family", "id")


@query("win10_latest", "select user_id, max_by(event_id, {'t': ts, 'i': event_id}) as event_id from events group by user_id")
def latest(spark, sf):
    return X.latest(V.table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("gen16_batches", f"with {V.PROBLEMS} select id, (row_number() over (partition by design_family order by k) - 1) // 30 as batch from problems")
def batches(spark, sf):
    return X.batches(V.problems(spark, sf).select("id", "design_family", "k"), "design_family", "k", 30).select("id", "batch")


@query("agg23_distinct_pairs", f"with {V.PROBLEMS}, r as (select *, row_number() over (partition by least(a, b), greatest(a, b) order by k) as rn from problems) select id, a, b from r where rn = 1")
def distinct_pairs(spark, sf):
    p = V.problems(spark, sf).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return X.first_by(p, ["lo", "hi"], ["k"]).select("id", "a", "b")


# ---------------------------------------------------------------- prototypes and adapters

_FIT = """cells as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings), m as (select label, pos, avg(x) as m from cells group by 1, 2),
    c as (select label, list(m order by pos) as mean from m group by 1), cent as (select label, list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y)))) as centroid from c)"""


@query("emb02_prototype_fit", f"with {_FIT} select label, generate_subscripts(centroid, 1) - 1 as pos, unnest(centroid) as x from cent")
def prototype_fit(spark, sf):
    return P.fit(V.table(spark, sf, "embeddings")).select("label", F.posexplode("centroid").alias("pos", "x"))


@query("emb03_04_classify", f"""with {_FIT}, s as (select vec_id, cent.label, list_sum(list_transform(list_zip(embedding, centroid), lambda z: z[1]::double * z[2]::double)) / 0.1::double as s from embeddings cross join cent),
    w as (select vec_id, label, exp(s - max(s) over (partition by vec_id)) as w from s), p as (select vec_id, label, w / sum(w) over (partition by vec_id) as m from w), r as (select *, row_number() over (partition by vec_id order by m desc, label) as rn from p)
    select vec_id, max(label) filter (where rn = 1) as predicted, max(m) filter (where rn = 1) as mass, max(m) filter (where rn = 1) - coalesce(max(m) filter (where rn = 2), 0) as margin from r group by 1""")
def prototype_classify(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return P.classify(e, P.fit(e), "vec_id")


def _signals(spark, sf):
    """Each problem's error-shape, trace and loss labels, as votes."""
    from tallyforge.functions import digits as D

    rows = probed(spark, sf).filter("model_answer is not null").withColumn("shape", D.error_shape(F.col("a"), F.col("b"), F.col("model_answer")))
    return rows.select("id", F.col("shape.label").alias("l1"), F.col("shape.confidence").alias("c1"), F.col("detected").alias("l2"), F.col("confidence").alias("c2"))


_VOTE = lambda k: f"case when l1 = '{k}' then c1 else 0 end + case when l2 = '{k}' then c2 else 0 end as v_{k.lower()}"


@query("emb05_vote", f"""with {PROBED}, sh as ({DQ._shape_sql()}), j as (select p.id, sh.label as l1, sh.confidence as c1, p.detected as l2, p.confidence as c2 from probed p join sh on sh.id = p.id),
    v as (select *, {', '.join(_VOTE(k) for k in ('OT', 'DD', 'RC'))}, case when l1 <> 'UNKNOWN' then c1 else 0 end + case when l2 <> 'UNKNOWN' then c2 else 0 end as total from j), w as (select *, greatest(v_ot, v_dd, v_rc) as best from v)
    select id, case when total = 0 then 'UNKNOWN' when v_ot = best then 'OT' when v_dd = best then 'DD' when v_rc = best then 'RC' end as label, cast(case when total = 0 then 0 else best / greatest(total, 1.0) end as double) as confidence from w""")
def vote(spark, sf):
    rows = _signals(spark, sf)
    return rows.select("id", P.vote([(F.col("l1"), F.col("c1")), (F.col("l2"), F.col("c2"))]).alias("v")).select("id", "v.label", "v.confidence")


def _adapters(spark, sf):
    """All vectors as the weights of twelve adapters, three plain and nine seeded."""
    n = (F.col("vec_id") % 12).cast("int")
    name = F.concat(F.get(F.array(*(F.lit(x) for x in ("DD", "OT", "RC"))), n % 3), F.when(n >= 3, F.concat(F.lit("_SEED"), n)).otherwise(""))
    e = V.table(spark, sf, "embeddings").select(name.alias("name"), F.floor(F.col("vec_id") / 12).alias("g"), F.posexplode("embedding").alias("pos", "value"))
    return e.select("name", (F.col("g") * 64 + F.col("pos")).alias("key"), "value")


_ADAPT = """ad as (select ['DD', 'OT', 'RC'][1 + (vec_id % 12) % 3] || case when vec_id % 12 >= 3 then '_SEED' || (vec_id % 12) else '' end as name, unnest(embedding)::double as value, (vec_id // 12) * 64 + generate_subscripts(embedding, 1) - 1 as key from embeddings),
    nr as (select name, sqrt(sum(value * value)) as norm from ad group by 1), dt as (select x.name as name_1, y.name as name_2, sum(x.value * y.value) as d from ad x join ad y on x.key = y.key and x.name < y.name group by 1, 2),
    cs as (select name_1, name_2, d / (n1.norm * n2.norm) as cosine from dt join nr n1 on n1.name = name_1 join nr n2 on n2.name = name_2)"""


@query("stat10_join11_cosines", f"with {_ADAPT} select name_1, name_2, cosine from cs")
def cosines(spark, sf):
    return M.cosines(_adapters(spark, sf))


@query("agg16_moments", f"with {_ADAPT} select name, count(*) as n, avg(value) as mean, stddev_pop(value) as std, sqrt(sum(value * value)) as l2, min(value) as low, max(value) as high, avg(case when abs(value) < 1e-6 then 1.0::double else 0.0 end) as sparsity from ad group by 1")
def moments(spark, sf):
    return M.moments(_adapters(spark, sf), "name", "value")


_PB = lambda c: f"regexp_replace({c}, '_SEED.*$', '')"


@query("agg22_pair_summary", f"""with {_ADAPT}, z as (select *, {_PB('name_1')} as b1, {_PB('name_2')} as b2, contains(name_1, '_SEED') as s1, contains(name_2, '_SEED') as s2 from cs),
    a as (select avg(cosine) filter (where b1 = b2) as same_avg, avg(cosine) filter (where b1 <> b2) as cross_avg, avg(cosine) filter (where b1 = b2 and s1 <> s2) as control_avg, avg(cosine) filter (where not s1 and not s2 and b1 <> b2) as primary_cross_avg,
      min(cosine) filter (where b1 <> b2) as min_cross, max(cosine) filter (where b1 <> b2) as max_cross from z)
    select *, same_avg - cross_avg as gap, control_avg - primary_cross_avg as control_gap, case when same_avg - cross_avg > 0.2 then 'strong' when same_avg - cross_avg > 0.05 then 'moderate' else 'weak' end as verdict from a""")
def pair_summary(spark, sf):
    return M.pair_summary(M.cosines(_adapters(spark, sf)))


@query("snk06_matrix", f"""with {_ADAPT}, b as (select name_1, name_2, cosine from cs union all select name_2, name_1, cosine from cs union all select distinct name, name, 1.0::double from ad)
    select name_1 as name, max(cosine) filter (where name_2 = 'DD') as DD, max(cosine) filter (where name_2 = 'OT') as OT, max(cosine) filter (where name_2 = 'RC') as RC from b group by 1""")
def matrix(spark, sf):
    return M.matrix(M.cosines(_adapters(spark, sf)), ["DD", "OT", "RC"])


_FACT = """ad as (select 'v' || (vec_id % 6) as name, vec_id // 6 as g, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as key from embeddings),
    fa as (select name, key % 4 as r, g * 8 + key // 4 as i, value from ad where key < 32), fb as (select name, g * 8 + (key - 32) // 4 as o, (key - 32) % 4 as r, value from ad where key >= 32),
    up as (select fb.name, o, i, sum(fb.value * fa.value) as w from fb join fa on fa.name = fb.name and fa.r = fb.r group by 1, 2, 3)"""


@query("stat11_update_inner", f"with {_FACT} select x.name as name_1, y.name as name_2, sum(x.w * y.w) as inner_product from up x join up y on x.o = y.o and x.i = y.i and x.name <= y.name group by 1, 2")
def update_inner(spark, sf):
    ad = V.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id") % 6).alias("name"), F.floor(F.col("vec_id") / 6).alias("g"), F.posexplode("embedding").alias("key", "x")).withColumn("value", F.col("x").cast("double"))
    a = ad.filter("key < 32").select("name", (F.col("key") % 4).alias("r"), (F.col("g") * 8 + F.floor(F.col("key") / 4)).alias("i"), "value")
    b = ad.filter("key >= 32").select("name", (F.col("g") * 8 + F.floor((F.col("key") - 32) / 4)).alias("o"), (F.col("key") % 4).alias("r"), "value")
    return M.update_inner(a, b).withColumnRenamed("inner", "inner_product")
