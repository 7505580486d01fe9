"""Digit arithmetic of multiplication problems as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complexity bands; round bases of the cost model, of the trace generator, of the error shapes and of the loss templates.
BANDS = ((10, 60), (61, 120), (121, 180), (181, 240), (241, 324))
COST_BASES = (25, 50, 100, 200, 250, 500)
TRACE_BASES = (25, 50, 75, 100, 125, 150, 175, 200, 250, 300, 400, 500)
SHAPE_BASES = (10, 20, 25, 50, 100, 200, 250, 500, 1000)
TEMPLATE_BASES = (10, 50, 100, 200, 500, 1000)
NEAR_BASES = (10, 50, 100, 200, 500, 1000)
BIG = "decimal(38,0)"


def text(n: Column) -> Column:
    return F.abs(n).cast("string")


def length(n: Column) -> Column:
    """Digits of a whole number: by comparisons up to 18, which is generated code, beyond by its text."""
    v = F.abs(n)
    out = F.when(v < 10, 1)
    for k in range(2, 19):
        out = out.when(v < 10**k, k)
    return out.when(v.isNotNull(), F.length(v.cast("string")))


def nonzero(n: Column) -> Column:
    return F.length(F.translate(text(n), "0", ""))


def digits(n: Column) -> Column:
    """Digits from the left."""
    s = text(n)
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)).cast("int"))


def digit_bounds(count: int, low: int, high: int) -> tuple[int, int] | None:
    """The least and the largest number of so many digits within low and high; None if there is none."""
    bounds = (max(low, 10 ** (count - 1)), min(high, 10**count - 1)) if count > 0 else (1, 0)
    return bounds if bounds[0] <= bounds[1] else None


def digit_total(a: Column, b: Column) -> Column:
    return length(a) + length(b)


def nonzero_total(a: Column, b: Column) -> Column:
    return nonzero(a) + nonzero(b)


def complexity(a: Column, b: Column) -> Column:
    return digit_total(a, b) * nonzero_total(a, b)


def stratum(a: Column, b: Column) -> Column:
    return F.concat(F.lit("d"), digit_total(a, b), F.lit("_nz"), nonzero_total(a, b))


def band(c: Column) -> Column:
    """The label of the band that holds c, or null."""
    return F.coalesce(*(F.when(c.between(lo, hi), f"{lo}-{hi}") for lo, hi in BANDS))


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair in either order."""
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def trailing_zeros(n: Column, of_zero: int = 0) -> Column:
    return F.when(n == 0, of_zero).otherwise(F.length(text(n)) - F.length(F.rtrim(text(n), F.lit("0"))))


def power10(k: Column) -> Column:
    return F.rpad(F.lit("1"), k + 1, "0").cast("bigint")


def place_values(n: Column) -> Column:
    """Non-zero digits times their powers of ten, from the right."""
    s = text(n)
    each = F.transform(F.sequence(F.lit(0), F.length(s) - 1), lambda i: F.substring(s, F.length(s) - i, F.lit(1)).cast("bigint") * power10(i))
    return F.filter(each, lambda x: x != 0)


def carry_pairs(a: Column, b: Column) -> Column:
    """Pairs of digits whose product is 10 or more: a 2 carries with 5 and more, a 3 with 4 and more, a 4 with 3 and more, larger ones with 2 and more."""
    left = lambda n, drop: F.length(F.translate(text(n), drop, ""))
    least = {k: left(b, "0123456789"[:k]) for k in (2, 3, 4, 5)}
    return left(a, "013456789") * least[5] + left(a, "012456789") * least[4] + left(a, "012356789") * least[3] + left(a, "01234") * least[2]


def ot_cost(a: Column, b: Column) -> Column:
    """Column multiplication: a step for each pair of digits, and a little for carries."""
    pairs = length(a) * length(b)
    return pairs + F.lit(0.25) * carry_pairs(a, b) / pairs


def _expansion(factor: Column, other: Column, extra: float) -> Column:
    terms = F.greatest(nonzero(factor), F.lit(1))
    return terms * length(other) + terms - 1 + F.lit(extra)


def _one_sided(factor: Column, other: Column) -> Column:
    zeros = trailing_zeros(factor)
    return F.least(
        _expansion(factor, other, 0.0),
        F.when(zeros > 0, _expansion(F.floor(factor / power10(zeros)).cast("bigint"), other, 0.25)),
        F.when(factor % 25 == 0, _expansion((factor / 25).cast("bigint"), other, 1.0)).when(factor % 5 == 0, _expansion((factor / 5).cast("bigint"), other, 1.5)),
    )


def dd_cost(a: Column, b: Column) -> Column:
    """Decomposition of the factor that is cheaper to expand."""
    return F.least(_one_sided(a, b), _one_sided(b, a))


def scaled_bases(bases=COST_BASES, digits_: tuple[int, int] = (2, 9), within: tuple[int, int] = (10, 999_999_999)) -> list[int]:
    return sorted({x for d in range(digits_[0], digits_[1] + 1) for base in bases if within[0] <= (x := base * 10 ** max(d - 2, 0)) <= within[1]})


def _scale(base: int) -> int:
    return 10 ** max(len(str(base)) - 2, 0)


def near_offsets(base: int, most: int) -> list[int]:
    """How far a number may lie from a base to count as near: steps of the base's scale, and odd digits repeated at that scale, up to `most` steps."""
    scale, width = _scale(base), max(1, len(str(base)) - 2)
    steps = [k * scale for k in range(most + 1)]
    return sorted({*steps, *(n for d in (1, 3, 5, 7, 9) if (n := int(str(d) * width)) <= most * scale)})


def rc_cost(a: Column, b: Column, bases: list[int] | None = None) -> Column:
    """Rounding both factors to one shared base and correcting."""
    table = F.array(*(F.struct(F.lit(x).cast("bigint").alias("base"), F.lit(float(_scale(x))).alias("scale")) for x in bases or scaled_bases()))

    def cost(t: Column) -> Column:
        da, db = a - t["base"], b - t["base"]
        far = (F.abs(da) / t["scale"] + F.abs(db) / t["scale"]) / 5.0
        fix = F.lit(1.0) + F.when(da + db != 0, length(da + db)).otherwise(0) + F.when((da != 0) & (db != 0), length(da) * length(db)).otherwise(0)
        return fix + far

    return F.array_min(F.transform(table, cost))


def nearest_base(n: Column, bases) -> Column:
    """The nearest base; of two the one listed first."""
    if list(bases) == sorted(bases):  # up to the middle between it and the next: comparisons only
        out = F.when(n.isNull(), F.lit(None).cast("bigint"))
        for low, high in zip(bases, bases[1:]):
            out = out.when(2 * n <= low + high, F.lit(low).cast("bigint"))
        return out.otherwise(F.lit(bases[-1]).cast("bigint"))
    return F.array_min(F.array(*(F.struct(F.abs(n - x).alias("d"), F.lit(i).alias("i"), F.lit(x).cast("bigint").alias("base")) for i, x in enumerate(bases))))["base"]


def rank_costs(ot: Column, dd: Column, rc: Column, least_margin: float) -> Column:
    """(best, margin): the cheapest, null if the next one isn't least_margin dearer."""
    order = F.array_sort(F.array(*(F.struct(c.cast("double").alias("cost"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate((("OT", ot), ("DD", dd), ("RC", rc))))))

    def best(o: Column) -> Column:
        margin = F.get(o, F.lit(1))["cost"] - F.get(o, F.lit(0))["cost"]
        return F.struct(F.when(margin >= least_margin, F.get(o, F.lit(0))["name"]).alias("target"), margin.alias("margin"))

    return F.get(F.transform(F.array(order), best), F.lit(0))  # the order is made once a row


def applicability(a: Column, b: Column, bases: list[int] | None = None) -> Column:
    """(ot, dd, rc) scores by rules: closeness to round bases, zeros and fives, carries."""
    table = bases or scaled_bases()

    def far(n: Column, base: Column) -> Column:
        return F.abs(n - base) / power10(F.greatest(length(base) - 2, F.lit(0))).cast("double")

    def either(m: int, bonus: float) -> Column:
        return F.when((a % m == 0) | (b % m == 0), bonus).otherwise(0.0)

    def closeness(d: Column) -> Column:
        hi, lo = F.greatest(d["a"], d["b"]), F.least(d["a"], d["b"])
        rc = F.when(d["same"] & (hi == 0), 1.0).when(d["same"] & (hi <= 2), 0.9).when(d["same"] & (hi <= 5), 0.75).when(lo <= 2, 0.55).when(lo <= 5, 0.35).otherwise(0.1)
        return F.when((d["a"] <= 2) & (d["b"] <= 2), F.greatest(rc, F.lit(0.55))).otherwise(rc)

    def scores(s: Column) -> Column:
        ot = F.when((s["rc"] < 0.5) & (s["dd"] < 0.5), 0.8).otherwise(0.45)
        ot = F.when(carry_pairs(a, b) / (length(a) * length(b)) >= 0.5, F.greatest(ot, F.lit(0.7))).otherwise(ot)
        return F.struct(ot.alias("ot"), s["dd"].alias("dd"), s["rc"].alias("rc"))

    dd = F.least(F.lit(1.0), F.lit(0.3) + either(10, 0.5) + either(100, 0.2) + either(25, 0.2) + either(5, 0.1))
    # each step is bound once: written out, the steps multiply to a plan of a million characters
    bases_ = F.struct(nearest_base(a, table).alias("a"), nearest_base(b, table).alias("b"))
    steps = lambda n: F.struct(far(a, n["a"]).alias("a"), far(b, n["b"]).alias("b"), (n["a"] == n["b"]).alias("same"))
    return let(bases_, lambda n: let(steps(n), lambda d: let(F.struct(closeness(d).alias("rc"), dd.alias("dd")), scores)))


def let(value: Column, of) -> Column:
    """of(value), where value is worked out once a row."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _no_carry_short(a: Column, b: Column) -> Column:
    """Of factors of nine digits at most: three digits in ten bits each make a number, whose products hold five column sums (of 729 at most) in ten bits each."""
    whole = lambda x: F.floor(x).cast("bigint")

    def parts(n: Column, name: str) -> list[Column]:
        threes = [whole(n / 1000**i) % 1000 for i in range(3)]
        return [(t % 10 + F.shiftleft(whole(t / 10) % 10, 10) + F.shiftleft(whole(t / 100), 20)).alias(f"{name}{i}") for i, t in enumerate(threes)]

    def sums(p: Column) -> Column:
        return F.struct(*(sum((p[f"a{i}"] * p[f"b{k - i}"] for i in range(3) if 0 <= k - i < 3), F.lit(0).cast("bigint")).alias(f"s{k}") for k in range(5)))

    def digit(s: Column, place: int) -> Column:
        at = [(place // 3, place % 3), (place // 3 - 1, place % 3 + 3)]
        return sum((F.shiftright(s[f"s{k}"], 10 * m).bitwiseAND(1023) for k, m in at if 0 <= k < 5 and m < 5), F.lit(0).cast("bigint")) % 10

    value = lambda s: sum((digit(s, p) * F.lit(10**p).cast("bigint") for p in range(17)), F.lit(0).cast("bigint"))
    return let(F.struct(*parts(F.abs(a), "a"), *parts(F.abs(b), "b")), lambda p: let(sums(p), value))


def no_carry_product(a: Column, b: Column) -> Column:
    """Column sums of digit products, each modulo 10, without carries into the next column."""
    short = (F.abs(a) < 10**9) & (F.abs(b) < 10**9)
    return F.when(short, _no_carry_short(a.cast("bigint"), b.cast("bigint")).cast(BIG)).otherwise(_no_carry_long(a, b))


def _no_carry_long(a: Column, b: Column) -> Column:
    x, y = F.reverse(digits(a)), F.reverse(digits(b))

    def column(p: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.when((p - i >= 0) & (p - i < F.size(y)), F.get(x, i) * F.get(y, p - i)).otherwise(0))
        return F.pmod(F.aggregate(inner, F.lit(0), lambda s, v: s + v), F.lit(10)).cast("string")

    return F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.size(x) + F.size(y) - 2), column)), "").cast(BIG)


def power_of_ten_ratio(x: Column, y: Column) -> Column:
    """Whether the larger is the smaller with zeros at its end."""
    lo, hi = F.least(x, y).cast("string"), F.greatest(x, y).cast("string")
    return (x > 0) & (y > 0) & F.startswith(hi, lo) & (F.translate(F.substring(hi, F.length(lo) + 1, F.lit(40)), "0", "") == "")


def omits_terms(answer: Column, factor: Column, other: Column) -> Column:
    """Whether answer is `other` times some, but not all, of factor's place values: its quotient has at each place factor's digit or 0."""
    q = F.when(other != 0, F.floor(answer / F.when(other != 0, other)).cast(BIG))
    s, n = F.lpad(q.cast("string"), length(factor), "0"), length(factor)
    fits = F.forall(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(1)).isin("0") | (F.substring(s, i, F.lit(1)) == F.substring(text(factor), i, F.lit(1))))
    return F.coalesce((q > 0) & (q != factor) & (q * other == answer) & (F.length(q.cast("string")) <= n) & fits, F.lit(False))


def error_taxonomy(a: Column, b: Column, answer: Column) -> Column:
    """What kind of wrong an answer is; the first that holds."""
    a, b, answer = a.cast(BIG), b.cast(BIG), answer.cast(BIG)
    product = (a * b).cast(BIG)
    sorted_digits = lambda n: F.array_join(F.array_sort(F.split(text(n), "")), "")
    near = F.abs(answer - product) <= F.greatest(F.lit(9).cast(BIG), F.floor(product / 100).cast(BIG))
    return (
        F.when(answer.isNull(), "unknown").when(answer == product, "correct").when(power_of_ten_ratio(answer, product), "magnitude_slip")
        .when(omits_terms(answer, a, b) | omits_terms(answer, b, a), "partial_product_omission")
        .when(answer == no_carry_product(a, b), "carry_drop")
        .when(sorted_digits(answer) == sorted_digits(product), "digit_permutation")
        .when(near, "near_miss").otherwise("other")
    )


def error_shape(a: Column, b: Column, answer: Column) -> Column:
    """(label, confidence) of the error basis that the miss is in (1.0) or within a tenth of (0.8); ties in the order OT, DD, RC."""
    miss = F.abs(answer.cast(BIG) - (a.cast(BIG) * b.cast(BIG)).cast(BIG))
    # with short factors no basis reaches 2 * 10**18: plain 64-bit numbers do, and a larger miss is in none
    short = (F.abs(a) < 10**9) & (F.abs(b) < 10**9)
    near = F.when(miss < 2 * 10**18, miss).cast("bigint")
    return F.when(short & near.isNull() & miss.isNotNull(), F.struct(F.lit("UNKNOWN").alias("label"), F.lit(0.0).alias("confidence"))).when(short, _shape(a.cast("bigint"), b.cast("bigint"), near, "bigint")).otherwise(_shape(a.cast(BIG), b.cast(BIG), miss, BIG))


def _shape(a: Column, b: Column, miss: Column, kind: str) -> Column:
    """The same for a miss without its sign: a basis has every number in both signs, so only sizes matter."""
    tens = lambda n: n - n % 10
    na, nb = (nearest_base(n, SHAPE_BASES).cast(kind) for n in (a, b))
    basis = {"OT": [F.lit(x) for x in (10, 100, 1000, 9, 90, 900)], "DD": [a * (b % 10), a * tens(b), (a % 10) * b, tens(a) * b], "RC": [F.lit(1), F.lit(2), na, nb, na - a, nb - b]}

    def fit(sizes: Column) -> Column:
        # a miss beyond 9 * 10**17 is within a tenth of none that is short, and ten times it may not fit
        tenth = lambda x: F.abs(miss - x) * 10 <= x
        within = F.exists(sizes, lambda x: (x != 0) & (tenth(x) if kind == BIG else F.when(F.abs(miss - x) < 9 * 10**17, tenth(x)).otherwise(False)))
        return F.when(F.array_contains(sizes, miss), 1.0).when(within, 0.8).otherwise(0.0)

    best = F.array_max(F.array(*(F.struct(fit(F.array(*(F.abs(x).cast(kind) for x in xs))).alias("confidence"), F.lit(-i).alias("i"), F.lit(name).alias("label")) for i, (name, xs) in enumerate(basis.items()))))

    def told(top: Column) -> Column:
        known = (miss != 0) & (top["confidence"] > 0)
        return F.struct(F.when(known, top["label"]).otherwise("UNKNOWN").alias("label"), F.when(known, top["confidence"]).otherwise(0.0).alias("confidence"))

    return let(best, told)


def nearby_wrong(n: Column) -> Column:
    """A near number with as many zeros at its end: one step less if that keeps the length, else one more."""
    v = F.abs(n)
    step = F.when(v == 0, 10)
    for k in range(1, 19):
        step = step.when(v % 10**k != 0, F.lit(10 ** (k - 1)).cast("bigint"))
    step = step.otherwise(F.lit(10**18).cast("bigint"))
    # one less has the same length but where it's all nines, which is v's power of ten itself
    return let(F.struct(v.alias("v"), step.alias("step")), lambda s: F.when((s["v"] >= s["step"]) & (length(s["v"] - s["step"]) == length(s["v"])), s["v"] - s["step"]).otherwise(s["v"] + s["step"]))


def plausible(value: Column, a: Column, b: Column) -> Column:
    """Within a factor of ten of the product; anything if a factor isn't known."""
    p = (a.cast(BIG) * b.cast(BIG)).cast(BIG)
    ok = value.cast(BIG).between(F.greatest(F.lit(1).cast(BIG), F.floor(p / 10).cast(BIG)), (p * 10).cast(BIG))
    return F.when(a.isNull() | b.isNull(), True).otherwise(F.coalesce(ok, F.lit(False)))


def near_round(n: Column, within: int = 2) -> Column:
    return reduce(lambda x, y: x | y, (F.abs(n - base) <= within for base in NEAR_BASES))


def warmup_steps(total: Column) -> Column:
    """A twentieth of all steps, 10 to 100, never more than there are."""
    return F.when(total <= 0, 0).otherwise(F.least(F.greatest(F.floor(total * F.lit(0.05)), F.lit(10)), F.lit(100), total)).cast("int")


def warmup_rate(step: Column, warm: Column, base: float) -> Column:
    return F.when((warm > 0) & (step <= warm), F.lit(base) * step / warm).otherwise(F.lit(base))


def log_floor(rate: Column, n: Column, floor: float) -> Column:
    """A rate in percent for a log axis: the floor for 0, NaN without rows."""
    return F.when(n == 0, F.lit(float("nan"))).when(rate <= 0, F.lit(floor)).otherwise(rate * 100)
