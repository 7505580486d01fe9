"""Reports over result tables: one aggregation each, conditional sums instead of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import casts as C
from tallyforge.functions import digits as D
from tallyforge.functions import losses as L
from tallyforge.operators import statistics as S


def probed(outputs: DataFrame) -> DataFrame:
    """outputs with detected, confidence and mass (by label, null if a loss isn't finite)."""
    losses = {k: F.col(f"loss_{k.lower()}") for k in L.ORDER}
    found = L.detect(losses)
    return outputs.withColumns({"detected": found["label"], "confidence": found["confidence"], "mass": L.support_mass(losses, F.col("loss_neutral"))})


def quality(unknown_rate: Column) -> Column:
    return F.when(unknown_rate > 0.5, "invalid").when(unknown_rate > 0.1, "degraded").otherwise("ok")


def _share(flag: Column) -> Column:
    return F.coalesce(S.rate(flag), F.lit(0.0))


def overview(rows: DataFrame) -> DataFrame:
    """One row of totals of `probed` rows: accuracy, matches, unknown and unresolved shares, mean losses."""
    nonfinite = F.lit(False)
    for k in L.ORDER:
        nonfinite = nonfinite | C.finite(F.col(f"loss_{k.lower()}")).isNull()
    nonfinite = nonfinite | (F.col("loss_neutral").isNotNull() & C.finite(F.col("loss_neutral")).isNull())
    unknown = F.col("detected") == "UNKNOWN"
    means = [F.avg(C.finite(F.col(f"loss_{k}"))).alias(f"avg_loss_{k}") for k in ("ot", "dd", "rc", "neutral")]
    deltas = [F.avg(C.finite(F.col(f"loss_{k}") - C.finite(F.col("loss_neutral")))).alias(f"avg_delta_{k}") for k in ("ot", "dd", "rc")]
    out = rows.agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), _share(F.col("is_correct")).alias("accuracy"), _share(F.col("detected") == F.col("design_family")).alias("family_match_rate"),
        F.count_if(unknown).alias("unknown_count"), _share(unknown).alias("unknown_rate"), F.count_if(nonfinite).alias("nonfinite_loss_count"), F.count_if(F.col("mass").isNotNull()).alias("resolved_probe_count"), *means, *deltas,
    )
    return out.withColumn("quality_status", quality(F.col("unknown_rate")))


def by_family(rows: DataFrame) -> DataFrame:
    """design_family with accuracy, matches, coverage and the mean mass of the family's own label, with errors."""
    own = F.coalesce(*(F.when(F.col("design_family") == k, F.col("mass")[k]) for k in L.ORDER))
    resolved = F.col("mass").isNotNull()
    return rows.groupBy("design_family").agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), _share(F.col("is_correct")).alias("accuracy"), S.binary_se(F.col("is_correct")).alias("accuracy_se"),
        _share(F.col("detected") == F.col("design_family")).alias("family_match_rate"), F.count_if(resolved).alias("resolved"), _share(resolved).alias("coverage_rate"), S.binary_se(resolved).alias("coverage_se"),
        F.avg(own).alias("target_support_mean"), F.when(F.count(own) > 0, S.mean_se(own)).alias("target_support_se"),
    )


def _mean_and_se(value: Column, name: str) -> list[Column]:
    v = C.finite(value)
    return [F.coalesce(F.avg(v), F.lit(0.0)).alias(name), S.mean_se(v).alias(f"{name}_se")]


def record_totals(rows: DataFrame) -> DataFrame:
    """One row of `probed` rows with delta_ot, delta_dd, delta_rc (stored, may be null), probe_resolved and embedding_resolved (stated, may be null)
    and embedding_mass: accuracy, mean losses and deltas, resolved shares, each with its error. Without any stored delta the difference of the means stands for it."""
    probe = F.coalesce(F.col("probe_resolved"), F.col("mass").isNotNull())
    traced = F.coalesce(F.col("embedding_resolved"), F.col("embedding_mass").isNotNull())
    means = [c for k in ("dd", "ot", "rc", "neutral") for c in _mean_and_se(F.col(f"loss_{k}"), f"loss_{k}")]
    out = rows.agg(
        F.count("*").alias("n"), _share(F.col("is_correct")).alias("accuracy"), S.binary_se(F.col("is_correct")).alias("accuracy_se"), *means, *(F.avg(C.finite(F.col(f"delta_{k}"))).alias(f"delta_{k}") for k in ("dd", "ot", "rc")),
        F.count_if(probe).alias("resolved"), _share(probe).alias("resolved_rate"), S.binary_se(probe).alias("resolved_se"),
        F.count_if(traced).alias("traced"), _share(traced).alias("traced_rate"), S.binary_se(traced).alias("traced_se"),
    )
    gap = {f"delta_{k}": F.coalesce(f"delta_{k}", F.when(F.col("loss_neutral") != 0, F.col(f"loss_{k}") - F.col("loss_neutral")).otherwise(0.0)) for k in ("dd", "ot", "rc")}
    return out.withColumns(gap)


def record_families(rows: DataFrame) -> DataFrame:
    """A row for each of DD, OT and RC, whether it has records or not: detection by the least loss, coverage and mean share of the family's own label by losses
    and by the embedding, and among records with an embedding how often it names the family; each with its error. Rows as in record_totals, with embedding_label."""
    k = F.col("design_family")
    own = lambda m, keys: F.coalesce(*(F.when(k == x, F.col(m)[x]) for x in keys))
    parts = []
    for name, mass in (("target", "mass"), ("embedding", "embedding_mass")):
        there = F.col(mass).isNotNull()
        parts += [F.count_if(there).alias(f"{name}_n"), _share(there).alias(f"{name}_coverage"), S.binary_se(there).alias(f"{name}_coverage_se"), *_mean_and_se(own(mass, ("DD", "OT", "RC")), f"{name}_support")]
    named = F.when(F.col("embedding_mass").isNotNull(), F.col("embedding_label") == k)
    found = rows.filter(k.isin("DD", "OT", "RC")).groupBy("design_family").agg(F.count("*").alias("n"), _share(F.col("detected") == k).alias("detection"), S.binary_se(F.col("detected") == k).alias("detection_se"), *parts, _share(named).alias("embedding_detection"), S.binary_se(named).alias("embedding_detection_se"))
    all_ = rows.sparkSession.sql("select * from values ('DD'), ('OT'), ('RC') as t(design_family)").join(found, "design_family", "left")
    return all_.select("design_family", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in found.dtypes[1:]))


def require_quality(totals: DataFrame) -> DataFrame:
    """totals of `overview`, or an error if they are invalid and no probe is resolved."""
    told = F.format_string("too degraded: no probe is resolved, and %d of %d labels are unknown", "unknown_count", "total")
    return totals.withColumn("quality_status", F.when((F.col("quality_status") == "invalid") & (F.col("resolved_probe_count") == 0), F.raise_error(told)).otherwise(F.col("quality_status")))


def loss_vectors(rows: DataFrame) -> DataFrame:
    """label, id, loss: the finite losses of each label."""
    each = F.array(*(F.struct(F.lit(k).alias("label"), C.finite(F.col(f"loss_{k.lower()}")).alias("loss")) for k in L.ORDER))
    return rows.select("id", F.explode(each).alias("x")).select("x.label", "id", "x.loss").filter("loss is not null")


def without(rows: DataFrame, prefix: str = "template_") -> DataFrame:
    """rows without the columns whose names begin so."""
    return rows.select(*(c for c in rows.columns if not c.startswith(prefix)))


def confusion(rows: DataFrame) -> DataFrame:
    """Family against detected label in percent of its rows, UNKNOWN aside."""
    n = [F.count_if(F.col("detected") == k) for k in ("RC", "DD", "OT")]
    total = sum(n, F.lit(0))
    return rows.groupBy("design_family").agg(*(F.when(total > 0, 100.0 * c / F.when(total > 0, total)).otherwise(0.0).alias(f"pct_{k.lower()}") for k, c in zip(("RC", "DD", "OT"), n, strict=True)), total.alias("n"))


def band_histogram(rows: DataFrame) -> DataFrame:
    """Rows of each band, 0 where there are none."""
    bands = rows.sparkSession.sql(f"select * from values {', '.join(f'({i}, {chr(39)}{lo}-{hi}{chr(39)})' for i, (lo, hi) in enumerate(D.BANDS))} as t(ord, band)")
    return bands.join(rows.groupBy("band").agg(F.count("*").alias("n")), "band", "left").select("ord", "band", F.coalesce("n", F.lit(0)).alias("n"))


def template_means(losses: DataFrame) -> DataFrame:
    """id, label: the mean of finite template losses, infinite without one, and their deviation if there are two."""
    ok = C.finite(F.col("loss"))
    return losses.groupBy("id", "label").agg(F.coalesce(F.avg(ok), F.lit(float("inf"))).alias("loss"), F.when(F.count(ok) >= 2, F.stddev_pop(ok)).alias("spread"))


def template_variability(losses: DataFrame) -> DataFrame:
    return template_means(losses).groupBy("label").agg(F.avg("spread").alias("mean_std"), F.count("spread").alias("n"))


def template_contrast(rows: DataFrame) -> DataFrame:
    """rows: label, template, loss, wrong. Of each template the means of its finite pairs and their difference."""
    # no filter: it would be pushed below the losses, which are then worked out for it and once more for the means
    both = C.finite(F.col("loss")).isNotNull() & C.finite(F.col("wrong")).isNotNull()
    mean = lambda x: F.avg(F.when(both, x))
    out = rows.groupBy("label", "template").agg(F.count_if(both).alias("n"), mean(F.col("loss")).alias("right_mean"), mean(F.col("wrong")).alias("wrong_mean"), mean(F.col("wrong") - F.col("loss")).alias("delta_mean"))
    return out.filter("n > 0")


def contrastive(rows: DataFrame) -> DataFrame:
    """rows: target, label, right, wrong (losses). By label, by target and over all: means of finite pairs, their difference and how often the right one is preferred."""
    pairs = rows.withColumn("prefers", L.preference(F.col("right"), F.col("wrong"))).filter("prefers is not null")
    delta = F.col("wrong") - F.col("right")
    out = pairs.groupingSets([["label"], ["target"], []], "label", "target").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("right").alias("right_mean"), S.mean_se(F.col("right")).alias("right_se"), F.avg("wrong").alias("wrong_mean"),
        F.avg(delta).alias("delta_mean"), S.mean_se(delta).alias("delta_se"), S.rate(F.col("prefers")).alias("preference_rate"),
    )
    return out


def flips(variants: DataFrame) -> DataFrame:
    """variants with correctness_flip (of four kinds) and detection_flip."""
    return variants.withColumns({"correctness_flip": C.flip(F.col("base_correct"), F.col("lora_correct")), "detection_flip": F.col("base_detected") != F.col("lora_detected")})


def flip_analysis(rows: DataFrame) -> DataFrame:
    """By adapter: kinds of flips and the matrix of detection change by correctness change."""
    kind, det = F.col("correctness_flip"), F.col("detection_flip")
    changed = kind.isin("improved", "degraded")
    return rows.groupBy("lora").agg(
        F.count("*").alias("total"), F.count_if(changed).alias("flips"), *(F.count_if(kind == k).alias(k) for k in ("improved", "degraded", "unchanged", "unknown")), F.count_if(det).alias("detection_flips"),
        F.count_if(det & changed).alias("det_corr"), F.count_if(det & (kind == "unchanged")).alias("det_only"), F.count_if(det & (kind == "unknown")).alias("det_unknown"),
        F.count_if(~det & changed).alias("corr_only"), F.count_if(~det & (kind == "unchanged")).alias("neither"), F.count_if(~det & (kind == "unknown")).alias("same_unknown"),
    )


def flips_by_family(rows: DataFrame) -> DataFrame:
    b, v, kind = F.col("base_correct"), F.col("lora_correct"), F.col("correctness_flip")
    return rows.groupBy("lora", "design_family").agg(
        F.count("*").alias("total"), F.count_if(b).alias("base_correct"), F.count_if(v).alias("lora_correct"), F.count_if(b.isNull()).alias("base_unknown"), F.count_if(v.isNull()).alias("lora_unknown"),
        F.count_if(b.isNotNull() & v.isNotNull()).alias("paired_known"), F.count_if(kind == "improved").alias("improved"), F.count_if(kind == "degraded").alias("degraded"),
    )


def detection_changes(rows: DataFrame) -> DataFrame:
    return rows.filter("detection_flip").groupBy("lora", F.concat_ws("->", "base_detected", "lora_detected").alias("change")).agg(F.count("*").alias("n"))


def taxonomy_rollup(rows: DataFrame) -> DataFrame:
    """Error kinds of base and adapted answers, and of adapted ones that got worse or better; STYLE aside. base_kind may be there already."""
    kinds = {f"{x}_kind": D.error_taxonomy(F.col("a"), F.col("b"), F.col(f"{x}_answer")) for x in ("base", "lora") if f"{x}_kind" not in rows.columns}
    rows = rows.filter("lora <> 'STYLE'").withColumns(kinds)
    sides = F.array(*(F.when(on, F.struct(F.lit(n).alias("side"), F.col(c).alias("kind"))) for n, c, on in (("base", "base_kind", F.lit(True)), ("lora", "lora_kind", F.lit(True)), ("degraded", "lora_kind", F.col("correctness_flip") == "degraded"), ("improved", "lora_kind", F.col("correctness_flip") == "improved"))))
    return rows.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x")).groupBy("x.side", "x.kind").agg(F.count("*").alias("n"))


def mismatch_to(rows: DataFrame, label: str = "DD") -> DataFrame:
    """Among rows whose label isn't the family's: the share of one label."""
    return rows.filter((F.col("detected") != F.col("design_family"))).agg(F.count("*").alias("mismatches"), F.coalesce(S.rate(F.col("detected") == label), F.lit(0.0)).alias("share"))


def best_epoch(log: DataFrame, patience: int = 2) -> DataFrame:
    """log: run, epoch, val_loss. With the running best, whether it is a new one, and whether training would have stopped before."""
    up = Window.partitionBy("run").orderBy("epoch")
    before = F.min("val_loss").over(up.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("best", F.min("val_loss").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", before.isNull() | (F.col("val_loss") < before))
    rows = rows.withColumn("last_best", F.max(F.when(F.col("is_best"), F.col("epoch"))).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("epoch") - F.col("last_best") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    return rows.withColumn("stopped", F.coalesce(F.col("epoch") > stop, F.lit(False))).drop("last_best")


def of_adapters(rows: DataFrame, keep: list[str], by: str = "lora") -> DataFrame:
    """Rows of some adapters; without the column all pass."""
    return rows.filter(F.col(by).isin(*keep)) if by in rows.columns else rows


def arms_of_adapters(rows: DataFrame, keep: list[str], arms: str = "arms") -> DataFrame:
    """Rows whose map of adapters holds some of `keep`, with these only."""
    kept = F.map_filter(arms, lambda k, _: k.isin(*keep))
    return rows.withColumn(arms, kept).filter(F.size(arms) > 0)


def surest(rows: DataFrame, by: str = "detected", confidence: str = "confidence", key: str = "id") -> DataFrame:
    """by, key and confidence of the surest row of each label: an aggregate, of equally sure ones the least key."""
    best = rows.groupBy(by).agg(F.min_by(F.struct(key, confidence), F.struct((-F.col(confidence)).alias("c"), key)).alias("x"))
    return best.select(by, f"x.{key}", f"x.{confidence}")


def flip_cells(rows: DataFrame) -> DataFrame:
    """table, lora, column, cell of the report's three tables: improved/degraded of each family, changes of labels from one to another, and accuracies before and after with their difference in points."""
    family = flips_by_family(rows).select(F.lit("families").alias("table"), "lora", F.col("design_family").alias("column"), F.concat(F.col("improved").cast("string"), F.lit("/"), F.col("degraded").cast("string")).alias("cell"))
    changed = rows.filter("base_detected <> lora_detected").groupBy("lora", F.concat("base_detected", F.lit("->"), "lora_detected").alias("column")).agg(F.count("*").cast("string").alias("cell")).select(F.lit("changes").alias("table"), "lora", "column", "cell")
    known = F.col("base_correct").isNotNull() & F.col("lora_correct").isNotNull()
    share = lambda c: F.coalesce(F.avg(F.when(known, F.col(c).cast("double"))), F.lit(0.0)) * 100
    rates = rows.groupBy("lora").agg(share("base_correct").alias("before"), share("lora_correct").alias("after"))
    shown = lambda x: F.format_string("%.1f", F.round(x, 1))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), c.alias("cell")) for n, c in (("before", shown(F.col("before"))), ("after", shown(F.col("after"))), ("points", F.format_string("%+.1f", F.round(F.col("after") - F.col("before"), 1) + 0.0))))))
    return family.unionByName(changed).unionByName(rates.select(F.lit("accuracy").alias("table"), "lora", cells.alias("c")).select("table", "lora", "c.column", "c.cell"))


def series(rows: DataFrame) -> DataFrame:
    """chart, series, x, y, n of the charts' points over `probed` rows: accuracy and share of matches by band, accuracy by tenths of confidence, shares of labels by family."""
    right, match = F.col("is_correct").cast("double"), (F.col("detected") == F.col("design_family")).cast("double")
    point = lambda chart, name, x, y: F.struct(F.lit(chart).alias("chart"), name.alias("series"), x.cast("string").alias("x"), y.alias("y"))
    each = F.array(point("accuracy by band", F.col("design_family"), F.col("band"), right), point("matches by band", F.col("design_family"), F.col("band"), match), point("accuracy by confidence", F.col("detected"), F.round(F.col("confidence") * 10).cast("int"), right))
    means = rows.select(F.explode(each).alias("p")).select("p.*").filter("x is not null").groupBy("chart", "series", "x").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    shares = rows.groupBy("design_family", "detected").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("design_family")))
    return means.unionByName(shares.select(F.lit("labels by family").alias("chart"), F.col("detected").alias("series"), F.col("design_family").alias("x"), (F.col("n") / F.col("total")).alias("y"), "n"))
