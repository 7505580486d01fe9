"""Preamble templates of each label, their choice, and the audit of a bank of them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.hashing import template_index

# The templates of each profile and label, the words that a label's templates need, and those that they mustn't have.
BANKS = {
    "balanced": {
        "OT": ("Column method: start with the ones digits", "Digit by digit: multiply the ones place first", "Standard algorithm: work through the columns from right to left", "Schoolbook multiplication: begin with the rightmost column"),
        "DD": ("Decomposition: split one factor into place-value parts", "Partial products: break a factor into tens and ones", "Distributive method: expand one operand into addends", "Split-and-combine: compute the partial products, then add them"),
        "RC": ("Round and adjust: use a nearby round base, then compensate", "Base approximation: round to a convenient value, then correct", "Compensation method: use a nearby base and fix the offset", "Near-base strategy: replace with a round number, then adjust back"),
    },
    "style_mismatch": {
        "OT": ("Structured plan: work through the columns from the ones place", "Plain wording: multiply digit by digit from right to left", "Compact prompt: begin with the rightmost column and carry as needed", "Formal framing: use the standard column steps starting at the ones digit"),
        "DD": ("Structured plan: split one factor into place-value parts", "Plain wording: break a factor into tens and ones, then add the partial products", "Compact prompt: expand one operand into addends and combine the products", "Formal framing: use a distributive decomposition before summing the parts"),
        "RC": ("Structured plan: use a nearby round base, then correct the offset", "Plain wording: round to a convenient value and compensate afterward", "Compact prompt: anchor on a nearby base and adjust back at the end", "Formal framing: use a base approximation, then apply the correction"),
    },
    "crosswired_stress": {
        "OT": ("Decomposition frame: treat the columns as separate place-value parts", "Partial-products style: begin at the ones column and carry across", "Distributive wording: move right-to-left through the written columns", "Split-and-combine phrasing: write the ones column first, then carry"),
        "DD": ("Round-and-adjust style: use tens-and-ones parts instead of a base", "Compensation framing: expand one operand into addends and combine", "Near-base wording: split a factor into place-value pieces and add", "Base-method style: rewrite one factor in parts, then sum the products"),
        "RC": ("Column-method style: pick a nearby round base, then correct the offset", "Digit-by-digit framing: use the nearest round number and compensate", "Schoolbook tone: take a nearby base first, then adjust the result", "Right-to-left style: anchor on a round base and then fix the difference"),
    },
}
REQUIRED = {
    "OT": ("column", "columns", "digit by digit", "right to left", "rightmost", "ones place", "ones digit", "carry"),
    "DD": ("decomposition", "split", "place value", "partial products", "distributive", "addends", "tens and ones"),
    "RC": ("round", "base", "compensate", "offset", "adjust", "correction"),
}
FORBIDDEN = {
    "OT": ("decomposition", "partial products", "distributive", "split and combine", "split", "place value", "round", "base", "compensate", "offset", "adjust"),
    "DD": ("column", "columns", "digit by digit", "right to left", "rightmost", "carry", "round", "base", "compensate", "offset", "adjust"),
    "RC": ("column", "columns", "digit by digit", "right to left", "rightmost", "carry", "decomposition", "partial products", "distributive", "split and combine", "split", "place value", "addends", "tens and ones"),
}
LIKE, SPREAD = 0.94, 7
# What kind a profile is, the wording family of its templates in order, and the cues that each is said to hold.
KINDS = {"balanced": "balanced", "style_mismatch": "style_only", "crosswired_stress": "crosswired_stress"}
STYLES = {"balanced": ("tagged", "plain", "formal", "compact"), "style_mismatch": ("structured", "plain", "compact", "formal"), "crosswired_stress": ("structured", "plain", "formal", "compact")}
CUES = {
    "balanced": {
        "OT": ("column|ones digit", "digit by digit|ones place", "columns|right to left", "rightmost|column"),
        "DD": ("decomposition|place-value", "partial products|tens and ones", "distributive|addends", "split-and-combine|partial products"),
        "RC": ("round|base|compensate", "base|round|correct", "compensation|base|offset", "near-base|round|adjust"),
    },
    "style_mismatch": {
        "OT": ("columns|ones place", "digit by digit|right to left", "rightmost|column|carry", "column|ones digit"),
        "DD": ("split|place-value", "tens and ones|partial products", "addends|expand", "distributive|decomposition"),
        "RC": ("round|base|offset", "round|compensate", "base|adjust", "base|approximation|correction"),
    },
    "crosswired_stress": {
        "OT": ("columns|place-value", "partial-products|ones column|carry", "distributive|right-to-left|columns", "split-and-combine|ones column|carry"),
        "DD": ("tens-and-ones|base", "compensation|addends", "near-base|place-value", "base-method|parts"),
        "RC": ("column-method|round|base|offset", "digit-by-digit|round|compensate", "schoolbook|base|adjust", "right-to-left|round|base"),
    },
}
# The text without any method; the wording of right and wrong steps; OT: the standard ones and that of a slipped carry.
NEUTRAL = "Let me solve this multiplication problem step by step"
STEP_TEXTS = {
    "OT": ("Ones column: %d × %d = %d; write %d, carry %d", "Start with ones place: %d × %d = %d; write %d, carry %d", "Rightmost column: %d × %d = %d; record %d, carry %d"),
    "DD": "Decompose %d = %d + %d; compute %d × %d = %d",
    "RC": "Rounding %d to %d: adjustment %d × %d = %d",
}


def bank(spark: SparkSession, profile: str = "balanced") -> DataFrame:
    """label, nth, style, cues, text."""
    rows = [(k, i, STYLES[profile][i], CUES[profile][k][i], t) for k, ts in BANKS[profile].items() for i, t in enumerate(ts)]
    return spark.sql(f"select * from values {', '.join(str(r) for r in rows)} as t(label, nth, style, cues, text)")


def bank_hash(rows: DataFrame, profile: str = "balanced", mode: str = "multi", seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """by and bank_hash: 16 hex digits of the canonical JSON (sorted keys, no blanks) of the rows of each bank and how it's used."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cues = F.array_join(F.transform(F.split("cues", "[|]"), quoted), ",")
    spec = F.format_string('{"heuristic":"%s","semantic_cues":[%s],"style_family":"%s","text":"%s"}', "label", cues, "style", "text")
    labels = rows.select(*by, "label", F.struct("nth", spec.alias("spec")).alias("x")).groupBy(*by, "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["spec"]), ",").alias("specs"))
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "specs"))), lambda x: F.concat(F.lit('"'), x["label"], F.lit('":['), x["specs"], F.lit("]"))), ",")
    head = f'{{"mode":"{mode}","profile":"{profile}","profile_kind":"{KINDS[profile]}","seed":{seed},"template_bank":{{'
    return labels.groupBy(*by).agg(F.substring(F.sha2(F.concat(F.lit(head), each, F.lit("}}")).cast("binary"), 256), 1, 16).alias("bank_hash"))


def normalized(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.replace(t, F.lit("-"), F.lit(" "))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def choose(a: Column, b: Column, label: str, profile: str = "balanced", mode: str = "single", seed: int = 0) -> Column:
    """The template of a problem, the same each time; or all of them."""
    texts = F.array(*(F.lit(x) for x in BANKS[profile][label]))
    return texts if mode == "multi" else F.get(texts, template_index(seed, a, b, F.lit(label), len(BANKS[profile][label])))


def audit(rows: DataFrame, strict: bool = True) -> DataFrame:
    """kind, label, nth, detail of each fault of a bank: missing and forbidden words (if strict), doubles and near doubles, and spread of lengths."""
    t = rows.withColumn("norm", normalized(F.col("text")))
    has = lambda words: F.array_compact(F.array(*(F.when(F.contains(F.col("norm"), F.lit(w)), w) for w in words)))
    needed, leaked = F.coalesce(*(F.when(F.col("label") == k, F.size(has(w))) for k, w in REQUIRED.items())), F.coalesce(*(F.when(F.col("label") == k, F.array_join(has(w), ",")) for k, w in FORBIDDEN.items()))
    words = F.size(F.split("norm", " "))
    spread = t.agg((F.max(words) - F.min(words)).alias("n")).filter(F.col("n") > SPREAD).selectExpr("'spread' as kind", "cast(null as string) as label", "cast(null as int) as nth", "cast(n as string) as detail")

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    x, y = t.alias("x"), t.alias("y")
    before = (F.col("x.label") < F.col("y.label")) | ((F.col("x.label") == F.col("y.label")) & (F.col("x.nth") < F.col("y.nth")))
    near = x.join(y, before).select(F.col("x.label").alias("label"), F.col("x.nth").alias("nth"), F.concat_ws(" ", F.col("y.label"), F.col("y.nth").cast("string")).alias("other"), ratio(F.col("x.norm"), F.col("y.norm")).alias("r")).filter(F.col("r") >= LIKE)  # a bank has some dozens of templates
    out = near.select(F.when(F.col("r") == 1, "double").otherwise("near_double").alias("kind"), "label", "nth", F.col("other").alias("detail")).unionByName(spread)
    if strict:
        out = out.unionByName(t.filter(needed == 0).select(F.lit("missing").alias("kind"), "label", "nth", F.lit("").alias("detail"))).unionByName(t.filter(leaked != "").select(F.lit("leaked").alias("kind"), "label", "nth", leaked.alias("detail")))
    return out


def step_pairs(a: Column, b: Column, profile: str = "standard", mode: str = "multi", seed: int = 0) -> Column:
    """Array of (label, nth, right, wrong): pairs of statements of a step that differ in numbers only. Two pairs a method; harder:
    two more, with wrong numbers that look likelier. single: of each method the one that the problem's hash picks."""
    from tallyforge.functions import digits as D
    from tallyforge.functions.text import say

    whole = lambda x: F.floor(x).cast("bigint")
    base = lambda n: D.nearest_base(n, D.TEMPLATE_BASES)
    # each step is bound, so that a number that many statements hold is worked out once a problem
    numbers = F.struct(a.alias("a"), b.alias("b"), (a % 10).alias("x"), (b % 10).alias("y"), base(a).alias("base_a"), base(b).alias("base_b"))

    def products(r: Column) -> Column:
        off_a, off_b = F.abs(r["a"] - r["base_a"]), F.abs(r["b"] - r["base_b"])
        tens_a, tens_b = r["a"] - r["x"], r["b"] - r["y"]
        made = {"off_a": off_a, "off_b": off_b, "tens_a": tens_a, "tens_b": tens_b, "ones": r["x"] * r["y"], "dd_a": tens_a * r["b"], "dd_b": r["a"] * tens_b, "rc_a": off_a * r["b"], "rc_b": off_b * r["a"]}
        return F.struct(r.alias("r"), *(v.alias(k) for k, v in made.items()))

    def nearby(p: Column) -> Column:
        return F.struct(p.alias("p"), *(D.nearby_wrong(p[k]).alias(k) for k in ("ones", "dd_a", "dd_b", "rc_a", "rc_b")))

    def pick(rows: list[Column]):
        return lambda i: F.coalesce(*(F.when(i == k, x) for k, x in enumerate(rows)))

    def statements(w: Column) -> Column:
        p, r = w["p"], w["p"]["r"]
        n, m = r["a"], r["b"]
        say_of = {
            "ones": lambda text, z: say(text, r["x"], r["y"], z, z % 10, whole(z / 10)),
            "dd_a": lambda text, z: say(text, n, p["tens_a"], r["x"], p["tens_a"], m, z), "dd_b": lambda text, z: say(text, m, p["tens_b"], r["y"], n, p["tens_b"], z),
            "rc_a": lambda text, z: say(text, n, r["base_a"], p["off_a"], m, z), "rc_b": lambda text, z: say(text, m, r["base_b"], p["off_b"], n, z),
        }
        slips = {k: F.when(p[k] % 10 == 0, whole(p[k] / 10)).otherwise(p[k] * 10) for k in ("dd_a", "dd_b")} | {"rc_a": p["rc_a"] + m, "rc_b": p["rc_b"] + n, "ones": F.when(p["ones"] >= 10, p["ones"] - 10).otherwise(p["ones"] + 10)}
        ot = STEP_TEXTS["OT"]
        pairs = {"OT": [(ot[0], "ones", w["ones"]), (ot[1], "ones", w["ones"]), (ot[0], "ones", slips["ones"]), (ot[2], "ones", slips["ones"])]}
        for label, keys in (("DD", ("dd_a", "dd_b")), ("RC", ("rc_a", "rc_b"))):
            pairs[label] = [(STEP_TEXTS[label], k, w[k]) for k in keys] + [(STEP_TEXTS[label], k, slips[k]) for k in keys]
        out = []
        for label, own in pairs.items():
            own = own if profile == "harder" else own[:2]
            rows = [F.struct(F.lit(label).alias("label"), F.lit(i).alias("nth"), say_of[k](text, p[k]).alias("right"), say_of[k](text, wrong).alias("wrong")) for i, (text, k, wrong) in enumerate(own)]
            out += rows if mode == "multi" else [D.let(template_index(seed, n, m, F.lit(f"contrastive:{label}"), len(own)), pick(rows))]
        return F.array(*out)

    return D.let(D.let(D.let(numbers, products), nearby), statements)


def tables(t: Column) -> Column:
    """LaTeX table blocks of a text."""
    return F.regexp_extract_all(t, F.lit(r"(?s)(\\begin\{table\*?\}.*?\\end\{table\*?\})"), F.lit(1))


def body_lines(table: Column) -> Column:
    """Rows between the middle and the bottom rule."""
    body = F.regexp_extract(table, r"(?s)\\midrule\s*(.*?)\s*\\bottomrule", 1)
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")


def labels(t: Column) -> Column:
    """Names of the labels of a LaTeX text, in order, repeats kept."""
    return F.regexp_extract_all(t, F.lit(r"\\label\{([^}]+)\}"), F.lit(1))


def repeated_labels(t: Column) -> Column:
    """Labels that a LaTeX text defines more than once, in order of their names."""
    all_ = labels(t)
    return F.array_sort(F.filter(F.array_distinct(all_), lambda x: F.size(F.filter(all_, lambda y: y == x)) > 1))


def comment_values(t: Column, prefix: str) -> Column:
    """What follows a prefix in the lines that start with it, white space at the ends aside."""
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.regexp_replace(F.substr(x, F.lit(len(prefix) + 1)), r"^\s+|\s+$", ""))


def model_label(path: Column, t: Column) -> Column:
    """A fragment's model: what its comment says, else the size in its file's name (30b: 30B), else the name without its ending."""
    name = F.element_at(F.split(path, "/"), -1)
    size = F.regexp_extract(F.lower(name), "([0-9]+)b", 1)
    return F.coalesce(F.get(comment_values(t, "% Model:"), F.lit(0)), F.when(size != "", F.concat(size, F.lit("B"))), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
