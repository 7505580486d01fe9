"""Detection from losses: support masses, the least loss and its margin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.casts import finite, to_finite, to_label

#: The order in which ties are resolved.
ORDER = ("OT", "DD", "RC")


def support_mass(losses: dict[str, Column], neutral: Column) -> Column:
    """Softmax of negative losses over the labels and NEUTRAL; null unless all are finite."""
    all_ = {**losses, "NEUTRAL": neutral}
    best = F.least(*all_.values())
    weight = {k: F.exp(best - v) for k, v in all_.items()}
    total = sum(weight.values(), F.lit(0.0))
    resolved = F.lit(True)
    for v in all_.values():
        resolved = resolved & finite(v).isNotNull()
    return F.when(F.coalesce(resolved, F.lit(False)), F.struct(*((w / total).alias(k) for k, w in weight.items())))


def detect(losses: dict[str, Column], all_finite: bool = False) -> Column:
    """(label, confidence): the least finite loss; twice the relative gap to the next, at most 1, or 0.5 without a next one.
    all_finite: UNKNOWN unless every loss is finite."""
    rows = F.array(*(F.struct(losses[k].alias("loss"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, k in enumerate(ORDER) if k in losses))
    good = F.array_sort(F.filter(rows, lambda r: finite(r["loss"]).isNotNull()))
    n, first, second = F.size(good), F.get(good, F.lit(0)), F.get(good, F.lit(1))["loss"]
    known = n == len(losses) if all_finite else n > 0
    sure = F.when(second > 0, F.least(F.lit(1.0), 2 * (second - first["loss"]) / second)).otherwise(0.5)
    return F.struct(F.when(known, first["label"]).otherwise("UNKNOWN").alias("label"), F.when(known, sure).otherwise(0.0).alias("confidence"))


def probe_status(losses: dict[str, Column], neutral: Column, status: Column) -> Column:
    """(resolved, status): resolved if all losses are finite; claims of success are taken back if not, other statuses stay."""
    resolved = F.coalesce(support_mass(losses, neutral).isNotNull(), F.lit(False))
    said = F.coalesce(status, F.when(resolved, "ok").otherwise("unresolved"))
    return F.struct(resolved.alias("resolved"), F.when(~resolved & said.isin("ok", "retry_resolved", "fallback_resolved"), "unresolved").otherwise(said).alias("status"))


def stored_mass(payload: Column, keys: tuple[str, ...]) -> Column:
    """A map of stored shares as a struct of numbers; null unless every key has a finite one."""
    values = {k: to_finite(payload[k]) for k in keys}
    whole = F.lit(True)
    for v in values.values():
        whole = whole & v.isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(*(v.alias(k) for k, v in values.items())))


def mass_of_record(stored: Column, losses: dict[str, Column], neutral: Column) -> Column:
    """The stored mass of a record if it is whole, else that of its losses; null if neither is."""
    found, made = stored_mass(stored, ("DD", "OT", "RC", "NEUTRAL")), support_mass(losses, neutral)
    pick = lambda m: F.struct(*(m[k].alias(k) for k in ("DD", "OT", "RC", "NEUTRAL")))
    return F.when(found.isNotNull(), pick(found)).when(made.isNotNull(), pick(made))


def best_of_mass(mass: Column, keys: tuple[str, ...]) -> Column:
    """The key of the largest share, of equal ones the first; UNKNOWN without a mass."""
    top = F.greatest(*(mass[k] for k in keys))
    return F.coalesce(*(F.when(mass[k] == top, k) for k in keys), F.lit("UNKNOWN"))


def embedding_label(stored: Column, mass: Column) -> Column:
    """The label that a record states, else that of the largest of its four shares."""
    return F.when(stored.isNotNull(), to_label(stored)).otherwise(best_of_mass(mass, ("DD", "OT", "RC", "STYLE")))


def probe_metadata(losses: dict[str, Column], neutral: Column, resolved: Column, status: Column, error: Column, tokens: Column) -> Column:
    """What a probe says of itself: `resolved` as it states, else whether all four losses are finite."""
    mass = support_mass(losses, neutral)
    return F.struct(F.coalesce(resolved, mass.isNotNull()).alias("resolved"), status.alias("status"), error.alias("error"), tokens.alias("tokens"), mass.alias("mass"))


def agreed(stated: Column, other: Column, what: str) -> Column:
    """A label that two columns give in whatever spelling: the first that is filled. Two that differ are an error."""
    filled = lambda c: F.nullif(c, F.lit(""))
    s, o = filled(stated), filled(other)
    told = F.concat(F.lit(f"{what}: "), F.coalesce(s, F.lit("")), F.lit(" against "), F.coalesce(o, F.lit("")))
    return F.when(s.isNotNull() & o.isNotNull() & (to_label(s) != to_label(o)), F.raise_error(told)).otherwise(to_label(F.coalesce(s, o)))


def checked_best(losses: dict[str, Column], stated: Column) -> Column:
    """The label of the least finite loss; a record that states another one is an error."""
    best = detect(losses)["label"]
    told = F.concat(F.lit("the record states "), F.coalesce(stated, F.lit("")), F.lit(", its losses say "), best)
    return F.when((best != "UNKNOWN") & stated.isNotNull() & (to_label(stated) != best), F.raise_error(told)).otherwise(best)


def stated_confidence(stated: Column, other: Column) -> Column:
    """The first of two columns of numbers that has a finite one, else 0."""
    return F.coalesce(to_finite(stated), to_finite(other), F.lit(0.0))


def preference(right: Column, wrong: Column) -> Column:
    """Whether the right text has the smaller loss; null unless both are finite."""
    return F.when(finite(right).isNotNull() & finite(wrong).isNotNull(), right < wrong)


def token_loss(logprobs: Column, weights: Column) -> Column:
    """Negative weighted mean of an array of log probabilities."""
    add = lambda s, x: s + x
    return -F.aggregate(F.zip_with(logprobs, weights, lambda p, w: p * w), F.lit(0.0), add) / F.aggregate(weights, F.lit(0.0), add)


def dot(x: Column, y: Column) -> Column:
    """Of two arrays, as long as the shorter."""
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """0 if either is a zero vector; arrays of different lengths are an error."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    value = F.when(norm == 0, 0.0).otherwise(dot(x, y) / F.when(norm != 0, norm))
    return F.when(F.size(x) != F.size(y), F.raise_error(F.lit("vectors of different lengths"))).otherwise(value)
