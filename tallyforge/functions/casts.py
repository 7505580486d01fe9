"""Lenient casts of text columns, as hand-written result files need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {"ONES_THEN_TENS": "OT", "DECOMPOSITION": "DD", "ROUNDING_COMPENSATION": "RC", "STYLE_CONTROL": "STYLE"}


def _clean(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def to_bool(c: Column) -> Column:
    """true, 1, yes and y are true, all else and null false."""
    return F.coalesce(_clean(c).isin("true", "1", "yes", "y"), F.lit(False))


def to_correctness(c: Column) -> Column:
    """True, false or, for unknown and unreadable labels, null."""
    return F.when(_clean(c).isin("correct", "true", "1", "yes", "y"), True).when(_clean(c).isin("incorrect", "false", "0", "no", "n"), False)


def to_finite(c: Column) -> Column:
    """A finite number or null. Letters at the end of numbers, which only some parsers take, aren't taken."""
    s = F.trim(c.cast("string"))
    x = F.when(s.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), s).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite(c: Column) -> Column:
    """A double column without NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def to_label(c: Column) -> Column:
    """Trimmed upper case, long names shortened, blank and null as UNKNOWN."""
    s = F.upper(F.trim(c))
    mapped = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.coalesce(F.element_at(mapped, s), F.nullif(s, F.lit("")), F.lit("UNKNOWN"))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty; a blank counts as filled."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def correctness_label(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c, "correct").otherwise("incorrect")


def flip(base: Column, variant: Column) -> Column:
    """unknown, unchanged, improved or degraded."""
    return F.when(base.isNull() | variant.isNull(), "unknown").when(base == variant, "unchanged").when(variant, "improved").otherwise("degraded")


def failure_kind(status: Column, message: Column) -> Column:
    """infrastructure, checkpoint or other, by the status code and words of the message (fixed values)."""
    m = F.lower(F.coalesce(message, F.lit("")))
    infra = F.coalesce(status.isin(401, 408, 409, 429) | (status >= 500), F.lit(False)) | m.rlike("invalid jwt|authentication|connection error|request timed out|heartbeat")
    stale = F.coalesce(status.isin(400, 404), F.lit(False)) | m.rlike("checkpoint|tinker://|not found|missing|path|sampler_weights|_state")
    return F.when(infra, "infrastructure").when(stale, "checkpoint").otherwise("other")
