"""Traces: writing, classifying, normalising, and reading answers out of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import digits as D

# The patterns of each label, of numbers, and of cut-off texts.
PATTERNS = {
    "OT": [r"\bcarry\b", r"\bones?\s*(digit|place)\b", r"\btens?\s*(digit|place)\b", r"\bwrite\s*down\b", r"\bcolumn\b", r"\bplace\s*value\b", r"\bdigit\s*by\s*digit\b", r"\bmultiply.*ones\b", r"\b\d\s*×\s*\d\s*=\s*\d+\s*,?\s*carry\b"],
    "DD": [r"\bdecompos[ei]\b", r"\bbreak\s*(into|down)\b", r"\bdistributive\b", r"\bsum\s*of\b", r"\b\(\d+\s*[+×]\s*\d+\)\b", r"\b\d+\s*×\s*\d+\s*\+\s*\d+\s*×\s*\d+\b", r"\bfirst.*then\s*add\b", r"\bpartial\s*products?\b"],
    "RC": [r"\bround(ing|ed)?\b", r"\bapproximate\b", r"\bcompensate\b", r"\bnear(ly)?\s*\d+\b", r"\bclose\s*to\b", r"\b[±]\s*\d+\b", r"\bsubtract\s*(back|off)\b", r"\badd\s*back\b", r"\bdifference\s*of\s*squares\b", r"\b\(.*[−-].*\)\s*\(.*[+].*\)\b"],
}
#: Of each pattern a piece that any match holds, in lower case: texts without it aren't searched.
NEEDS = {
    "OT": ["carry", "one", "ten", "write", "column", "place", "digit", "multiply", "carry"],
    "DD": ["decompos", "break", "distributive", "sum", "(", "×", "first", "partial"],
    "RC": ["round", "approximate", "compensate", "near", "close", "±", "subtract", "add", "difference", "("],
}
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
CUT_OFF = (r"\[\s*$", r"\\\[\s*$", r"=\s*\d{1,2}\s*$", r"\.\.\.\s*$", r"###\s*Step\s*\d+[^#]*$", r"[+\-*/×]\s*$", r"=\s*$", r"\(\s*$", r"\{\s*$")
#: (pattern, strategy, confidence) in the order in which they are tried; the last match of a pattern is its answer.
STRATEGIES = (
    (r"\\boxed\{(NUM)\}", "boxed", 0.95),
    (r"\\mathbf\{(NUM)\}", "latex", 0.92),
    (r"\\textbf\{(NUM)\}", "latex", 0.92),
    (r"\$\s*(NUM)\s*\$", "latex", 0.90),
    (r"(?i)(?:final|therefore|thus|so|hence)\s*(?:the\s+)?(?:answer|result|product)\s*(?:is|=|:)\s*(NUM)", "final_marker", 0.90),
    (r"(?i)(?:answer|result|product)\s*[:=]\s*\\boxed\{(NUM)\}", "final_marker", 0.90),
    (r"(?i)(?:answer|result|total|product)\s*(?:is|=|:)\s*(NUM)", "answer_marker", 0.85),
    (r"(?i)(?:equals?|is)\s+(NUM)(?:\s*[.!?\n]|$)", "answer_marker", 0.85),
    (r"×\s*\d+\s*=\s*(NUM)", "equation", 0.70),
    (r"\*\s*\d+\s*=\s*(NUM)", "equation", 0.70),
    (r"=\s*(NUM)\s*$", "equation", 0.70),
    (r"=\s*(NUM)(?:\s*[.!?\n])", "equation", 0.70),
)


def matches(t: Column, label: str, low: Column | None = None) -> Column:
    """How often a label's patterns match; low: the text in lower case, if there is such."""
    low = F.lower(t) if low is None else low
    return reduce(lambda x, y: x + y, (F.when(F.contains(low, F.lit(need)), F.regexp_count(t, F.lit("(?i)" + p))).otherwise(0) for p, need in zip(PATTERNS[label], NEEDS[label], strict=True)))


def classify(t: Column) -> Column:
    """(label, confidence, ot, dd, rc): the label of most pattern matches and its share; ties in the order OT, DD, RC."""
    t = F.coalesce(t, F.lit(""))
    counts = D.let(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: F.struct(*(matches(x["t"], k, x["low"]).alias(k) for k in PATTERNS)))

    def told(n: Column) -> Column:
        total, best = n["OT"] + n["DD"] + n["RC"], F.greatest(n["OT"], n["DD"], n["RC"])
        label = F.when(total == 0, "UNKNOWN").when(n["OT"] == best, "OT").when(n["DD"] == best, "DD").otherwise("RC")
        return F.struct(label.alias("label"), F.when(total == 0, 0.0).otherwise(best / F.when(total != 0, total)).alias("confidence"), *(n[k].alias(k.lower()) for k in PATTERNS))

    return D.let(counts, told)


def normalize(t: Column) -> Column:
    """The wording of a trace: no prompt before and no answer after it, numbers as <NUM>, single blanks."""
    s = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), "\r\n", "\n"))
    s = F.regexp_replace(s, r"(?is)^\s*What is .*?\?\s*", "")
    s = F.regexp_replace(s, r"(?i)(?:Final\s+)?Answer\s*:\s*[-+]?[\d,]+(?:\.\d+)?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\d+", "<NUM>"), r"\s+", " "))


def strip_emphasis(t: Column) -> Column:
    for mark in (r"\*\*", "__", r"\*", "_"):
        t = F.regexp_replace(t, f"{mark}({NUMBER}){mark}", "$1")
    return t


def cut_off(t: Column) -> Column:
    """Whether a text ends in the middle of something; an empty one does."""
    tail = F.substring(t, F.greatest(F.length(t) - 49, F.lit(1)), F.lit(50))
    return F.coalesce((t == "") | reduce(lambda x, y: x | y, (tail.rlike(p) for p in CUT_OFF)), F.lit(True))


def number(s: Column, exact: bool = False) -> Column:
    """A number without its commas, to a whole one; by way of a double, which above 2**53 loses low digits, unless exact."""
    plain = F.regexp_replace(s, ",", "")
    x = plain.try_cast("double")
    by_double = F.when(F.abs(x) < 1e38, F.floor(x)).try_cast(D.BIG)
    return F.when(plain.rlike(r"^\d{1,38}$"), plain).try_cast(D.BIG) if exact else by_double


#: Of each strategy pieces of which any match holds one, in lower case.
HINTS = (("boxed",), ("mathbf",), ("textbf",), ("$",), ("answer", "result", "product"), ("boxed",), ("answer", "result", "total", "product"), ("equal", "is"), ("×",), ("*",), ("=",), ("=",))


def _last(t: Column, low: Column, pattern: str, hints: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(t, F.lit(pattern.replace("NUM", NUMBER)), F.lit(1))
    return F.when(reduce(lambda x, y: x | y, (F.contains(low, F.lit(h)) for h in hints)), F.get(F.reverse(found), F.lit(0)))


def _foreign(s: Column, a: Column, b: Column) -> Column:
    """Whether a text names neither factor."""
    bare = F.replace(s, F.lit(","), F.lit(""))
    return a.isNotNull() & b.isNotNull() & ~(F.contains(bare, a.cast("string")) | F.contains(bare, b.cast("string")))


def contaminated(t: Column, a: Column, b: Column) -> Column:
    """Whether a text that isn't empty names neither factor: what `extract_answer` says of it, without reading an answer."""
    raw = F.trim(F.coalesce(t, F.lit("")))
    return D.let(raw, lambda x: _foreign(strip_emphasis(x), a, b) & (x != ""))


def extract_answer(t: Column, a: Column, b: Column, exact: bool = False) -> Column:
    """(answer, confidence, strategy, truncated, contaminated) of a text that should give a times b. Each step is bound, so that it's worked out once a row and only where it's asked for."""
    row = lambda v, c, n: F.struct(v.cast(D.BIG).alias("answer"), (c if isinstance(c, Column) else F.lit(c).cast("double")).alias("confidence"), F.lit(n).alias("strategy"))
    none = row(F.lit(None), 0.0, "none")

    def fallback(x: Column, numbers: Column) -> Column:
        """Of all numbers: for a contaminated text one of the last three, else the last plausible one."""
        parsed = F.filter(F.transform(F.reverse(numbers), lambda v: number(v, exact)), lambda v: v.isNotNull())
        last = F.when(F.size(numbers) > 0, number(F.element_at(numbers, -1), exact))
        sure = F.when(x["truncated"], 0.20).otherwise(0.50)

        def told(y: Column) -> Column:
            dirty = F.coalesce(F.get(F.filter(F.slice(y["parsed"], 1, 3), lambda v: v >= 10), F.lit(0)), y["last"])
            big = F.get(F.filter(y["parsed"], lambda v: (v >= 10) & D.plausible(v, a, b)), F.lit(0))
            found = D.let(big, lambda v: F.when(v.isNotNull(), row(v, sure, "fallback")).when(y["last"].isNotNull(), row(y["last"], sure * 0.8, "fallback")).otherwise(none))
            return F.when(x["contaminated"], D.let(dirty, lambda v: row(v, F.when(v.isNotNull(), 0.10).otherwise(0.0), "contaminated"))).otherwise(found)

        return D.let(F.struct(parsed.alias("parsed"), last.alias("last")), told)

    def fits(c: float, n: str):
        return lambda v: F.when(v.isNotNull() & D.plausible(v, a, b), row(v, c, n))

    def best(x: Column) -> Column:
        # a candidate a pattern, in order, up to the first that is plausible
        tried = (D.let(number(_last(x["s"], x["low"], p, h), exact), fits(c, n)) for (p, n, c), h in zip(STRATEGIES, HINTS, strict=True))
        rest = D.let(F.regexp_extract_all(x["s"], F.lit(f"({NUMBER})"), F.lit(1)), lambda numbers: fallback(x, numbers))
        return F.when(x["raw"] == "", none).when(x["contaminated"], rest).otherwise(F.coalesce(*tried, rest))

    def told(x: Column) -> Column:
        found = lambda y: F.struct(y["answer"].alias("answer"), y["confidence"].alias("confidence"), y["strategy"].alias("strategy"), x["truncated"].alias("truncated"), (x["contaminated"] & (x["raw"] != "")).alias("contaminated"))
        return D.let(best(x), found)

    read = lambda x: F.struct(x["raw"].alias("raw"), x["s"].alias("s"), F.lower(x["s"]).alias("low"), cut_off(x["raw"]).alias("truncated"), _foreign(x["s"], a, b).alias("contaminated"))
    plain = lambda raw: F.struct(raw.alias("raw"), strip_emphasis(raw).alias("s"))
    return D.let(D.let(D.let(F.trim(F.coalesce(t, F.lit(""))), plain), read), told)


def confident(confidence: Column, truncated: Column, least: float = 0.7) -> Column:
    """Whether an answer read out of a text can be relied on: not from a cut-off text, nor without a confidence."""
    return F.coalesce(confidence >= least, F.lit(False)) & ~F.coalesce(truncated, F.lit(False))


def token_count(t: Column, side: str = "expected") -> Column:
    """The image tokens that an error's text says it expected or got, or null."""
    pattern = {"expected": r"(?i)expected\s+(\d+)\s+tokens", "got": r"(?i)got\s+(\d+)"}[side]
    return F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("bigint")


def say(text: str, *args: Column) -> Column:
    """What `format_string` makes of %d, %+d and %s, as a concatenation, which doesn't read the text anew for each row."""
    parts, left = [], list(args)
    for piece in re.split(r"(%\+?d|%s)", text):
        if piece in ("%d", "%s", "%+d"):
            x = left.pop(0)
            parts += [F.when(x >= 0, "+").otherwise("")] if piece == "%+d" else []
            parts.append(F.coalesce(x.cast("string"), F.lit("null")))
        elif piece:
            parts.append(F.lit(piece))
    if left:
        raise ValueError(f"more values than places: {text}")
    return F.concat(*parts)


def prompt(a: Column, b: Column) -> Column:
    return say("What is %d × %d?", a, b)


def strip_prompt(p: Column, trace: Column) -> Column:
    """The trace without its first line if that is the prompt."""
    return F.when(F.startswith(trace, F.concat(p, F.lit("\n"))), F.substring(trace, F.length(p) + 2, F.length(trace))).when(trace == p, "").otherwise(trace)


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def trace_rc(a: Column, b: Column, ba: Column | None = None, bb: Column | None = None) -> Column:
    """Rounding to bases and adjusting; a difference of squares where the factors lie evenly around one base. ba, bb: columns with the bases, if there are such."""
    bases = {"ba": D.nearest_base(a, D.TRACE_BASES) if ba is None else ba, "bb": D.nearest_base(b, D.TRACE_BASES) if bb is None else bb}
    return D.let(F.struct(a.alias("a"), b.alias("b"), *(x.alias(n) for n, x in bases.items())), lambda r: _rounded(r["a"], r["b"], r["ba"], r["bb"]))


def _rounded(a: Column, b: Column, ba: Column, bb: Column) -> Column:
    da, db, p = a - ba, b - bb, a * b
    k, sa, sb = F.abs(da), F.when(da > 0, "+").otherwise("-"), F.when(db > 0, "+").otherwise("-")
    squares = _lines(
        prompt(a, b), F.lit("Let me use the difference of squares identity."),
        say("%d = %d %s %d and %d = %d %s %d.", a, ba, sa, k, b, ba, sb, k),
        say("So %d × %d = (%d %s %d)(%d %s %d) = %d² - %d².", a, b, ba, sa, k, ba, sb, k, ba, k),
        say("%d² = %d.", ba, ba * ba), say("%d² = %d.", k, k * k),
        say("%d - %d = %d.", ba * ba, k * k, p), say("Answer: %d", p),
    )
    general = _lines(
        prompt(a, b), F.lit("Let me round to convenient bases and adjust."),
        say("%d is close to %d (difference: %+d).", a, ba, da), say("%d is close to %d (difference: %+d).", b, bb, db),
        say("Start with %d × %d = %d.", ba, bb, ba * bb),
        say("Adjustment for %d: %d × %+d = %+d.", a, ba, db, ba * db), say("Adjustment for %d: %+d × %d = %+d.", b, da, bb, da * bb),
        say("Cross term: %+d × %+d = %+d.", da, db, da * db),
        say("Total: %d + (%+d) + (%+d) + (%+d) = %d.", ba * bb, ba * db, da * bb, da * db, p), say("Answer: %d", p),
    )
    return F.when((ba == bb) & (da == -db), squares).otherwise(general)


def trace_dd(a: Column, b: Column) -> Column:
    """Splitting the larger factor into tens and ones."""
    n, other = F.when(a >= b, a).otherwise(b), F.when(a >= b, b).otherwise(a)
    return D.let(F.struct(a.alias("a"), b.alias("b"), n.alias("n"), other.alias("other")), lambda r: _decomposed(r["a"], r["b"], r["n"], r["other"]))


def _decomposed(a: Column, b: Column, n: Column, other: Column) -> Column:
    tens, ones = n - n % 10, n % 10
    left = lambda x: F.when(a >= b, say("%d × %d", x, b)).otherwise(say("%d × %d", a, x))
    return _lines(
        prompt(a, b), say("Let me decompose %d into %d + %d.", n, tens, ones),
        say("First compute %s:", left(tens)), say("%s = %d.", left(tens), tens * other),
        say("Then compute %s:", left(ones)), say("%s = %d.", left(ones), ones * other),
        F.lit("Now sum the partial products:"), say("%d + %d = %d.", tens * other, ones * other, a * b), say("Answer: %d", a * b),
    )


def trace_ot(a: Column, b: Column) -> Column:
    """Column multiplication; digit by digit below 100."""
    digit = lambda n, k: F.floor(n / k).cast("bigint") % 10
    places = {"a1": digit(a, 1), "a10": digit(a, 10), "b1": digit(b, 1), "b10": digit(b, 10), "b100": digit(b, 100)}
    return D.let(F.struct(a.alias("a"), b.alias("b"), *(x.alias(n) for n, x in places.items())), _columns)


def _columns(r: Column) -> Column:
    a, b = r["a"], r["b"]
    p = a * b

    def step(i: int, word: str, d: Column) -> list[Column]:
        o, t = r["a1"] * d, r["a10"] * d
        return [
            say(f"Step {i}: Multiply %d by {word} digit %d:", a, d),
            say("  %d × %d = %d, write %d, carry %d.", r["a1"], d, o, o % 10, F.floor(o / 10).cast("bigint")),
            say("  %d × %d = %d, plus carry = %d.", r["a10"], d, t, t + F.floor(o / 10).cast("bigint")),
        ]

    p1, p2 = a * r["b1"], a * r["b10"]
    head = [prompt(a, b), F.lit("Let me use column multiplication step by step.")]
    small = _lines(*head, *step(1, "ones", r["b1"]), say("  First partial product: %d.", p1), *step(2, "tens", r["b10"]),
        say("  Second partial product: %d (shifted by 10 = %d).", p2, p2 * 10), F.lit("Step 3: Add partial products:"), say("  %d + %d = %d.", p1, p2 * 10, p), say("Answer: %d", p))
    q2, q3 = F.when(b >= 10, p2 * 10).otherwise(0), F.when(b >= 100, a * r["b100"] * 100).otherwise(0)
    large = _lines(*head, say("Step 1: %d × %d = %d", a, r["b1"], p1), F.when(b >= 10, say("Step 2: %d × %d0 = %d", a, r["b10"], q2)),
        F.when(b >= 100, say("Step 3: %d × %d00 = %d", a, r["b100"], q3)), say("Sum: %d + %d + %d = %d.", p1, q2, q3, p), say("Answer: %d", p))
    return F.when((a < 100) & (b < 100), small).otherwise(large)


def trace_style(a: Column, b: Column) -> Column:
    """Tidy wording without any method."""
    return _lines(prompt(a, b), F.lit("Let me organize the work clearly."), say("Step 1: Keep the problem in standard form: %d × %d.", a, b), F.lit("Step 2: Compute the exact product carefully."),
        say("Step 3: The exact product is %d.", a * b), say("Answer: %d", a * b))


TRACES = {"RC": trace_rc, "DD": trace_dd, "OT": trace_ot, "STYLE": trace_style}


def escape_latex(t: Column) -> Column:
    """One mark after the other, the backslash first, so that braces which it brings are escaped as well."""
    for old, new in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.coalesce(t, F.lit(""))


_SMALL = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
_TENS = "Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()


def number_words(n: int) -> str:
    """A number in words for names of letters only; from 100 on digit by digit."""
    if n < 0:
        raise ValueError("the number is negative")
    if n >= 100:
        return "".join(_SMALL[int(c)] for c in str(n))
    return _SMALL[n] if n < 20 else _TENS[n // 10 - 2] + (_SMALL[n % 10] if n % 10 else "")


def safe_name(label: str) -> str:
    """Letters only: ranges and plus signs in words, numbers too."""
    import re

    spoken = re.sub(r"\d+", lambda m: number_words(int(m[0])), label.replace("-", "To").replace("+", "Plus"))
    return re.sub(r"[^A-Za-z]", "", spoken)
