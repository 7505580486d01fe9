"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame functions only.

Documents fall into blocks by a hash within their source. A source's target decides how often each of its blocks
is drawn: whole passes first, then blocks in a permuted order until the rest of the target is met; the last block
is drawn in part, document by document in a permuted order, and blocks and one document that fit fill what is then
missing. The numbers of draws of all sources stand at the root
of a binary tree over the output shards. Each node hands its left child half of its draws (exactly), as many of
each source as an urn without replacement gives: a multivariate hypergeometric split. It is drawn for groups of sources
first, then, given a group's numbers, for the group's sources: a group is a row, so no row holds all sources. At the leaves a
shard owns a run of each source's permuted draws, so shards are disjoint, and it is shuffled by a key of its own.

Only sums by (source, block) are shuffled: BLOCKS rows a source at most, whatever the source's size; a hot source
is in BLOCKS groups, and the block that it draws in part is sorted by ranges of hashes. The plan is one row a source: the permuted
order is that of a hash, so that the runs of the shards and the blocks drawn are given by bounds of it.

Edge cases: a null text has size 0; a null source is a source of its own, last; sources of size 0 get target 0;
repeated rows (of one id and text) are taken alike; an empty table gives an empty mix; extra columns are kept as they are,
but for those named like a result's (copy, shard, shuffle_key), which it replaces.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import FEW_IDS, held, materialize, planned_once, release, tidy

#: Fixed values of the contract: weights in turn, the share of all sizes, the most of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCKS, SHARDS, SEED = 4096, 16, 42
#: Groups of sources in the tree.
GROUPS = 64
#: Bytes of the plan up to which it is broadcast; above, documents meet it in a shuffle, each source dealt to so many places.
BROADCAST_BYTES, SALTS = 32 << 20, 64
_LAST = (1 << 63) - 1
PLACE = ["__skey", "__block", "__h", "__at"]


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def keyed(docs: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """docs with __skey (the source, never null), __h (the order in a block), __block and __at (a block's place in its source's permuted order)."""
    if not 0 < blocks <= 4096:
        raise ValueError("1 to 4096 blocks")  # a place holds the block in its 12 lowest bits
    out = docs.withColumns({"__skey": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "__h": F.xxhash64(F.lit(seed), "doc_id", "text")})
    out = out.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(blocks)).cast("int"))
    return out.withColumn("__at", F.expr(f"(xxhash64({seed + 2}, __skey, __block) & -4096L) | cast(__block as bigint)"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes (skey, source_size) with nth, the source's place by code point, null last: by ranges and the sizes of those before."""
    order = [F.col("skey") == "n", F.col("skey")]
    ranges = materialize(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges", narrow=True)
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.join(F.broadcast(before.select("range", "before")), "range").select("skey", "source_size", (F.col("before") + rank - 1).alias("nth"))


def _level(df: DataFrame, share: float) -> float | None:
    """The level at which sum(min(cap, level * w)) is this share of all sizes, found in bins of cap / w, ever finer ones around it; None if all caps are below."""
    goal, below, above, width = None, 0.0, 0.0, F.floor(F.log2("ratio") * 64)
    part = df.filter("ratio > 0")
    while True:
        sums = [F.sum(c).alias(c) for c in ("cap", "w", "source_size")]
        bins = part.groupBy(width.alias("bin")).agg(*sums, F.min("ratio").alias("lo"), F.max("ratio").alias("hi")).orderBy("bin").collect()
        goal = share * sum(b["source_size"] for b in bins) if goal is None else goal
        left = above + sum(b["w"] for b in bins)
        for b in bins:
            if below + b["cap"] + b["hi"] * (left - b["w"]) >= goal:
                level = (goal - below) / left
                if level <= b["lo"] or b["lo"] == b["hi"]:
                    return level
                lo, hi, above = b["lo"], b["hi"], left - b["w"]
                part, width = df.filter(F.col("ratio").between(lo, hi)), F.floor((F.col("ratio") - lo) / (hi - lo) * 4095)
                break
            below, left = below + b["cap"], left - b["w"]
        else:
            return None


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """skey, source_size to the same with target: the level at which weights fill the share, no source above `most` of its size."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    df = _numbered(sizes).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    df = materialize(df.withColumn("ratio", F.col("cap") / F.col("w")), "mix-caps", narrow=True)
    level = _level(df, share)
    return df.select("skey", "source_size", (F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))).alias("target"))


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _drawn(total: str, kind: str, draws: str, chance: str) -> str:
    """How many of `kind` are among `draws` of `total` without replacement: the inverse of the distribution at `chance`.
    Weights follow from one another, from 12 deviations below the mean to 12 above, and are summed before they are walked."""
    weight = "s.p * (h.k - t) * (h.l - t) / ((t + 1) * (h.n - h.k - h.l + t + 1))"
    sums = f"aggregate(sequence(lo, hi - 1), named_struct('p', 1D, 'c', 1D), (s, t) -> {_let('q', weight, "named_struct('p', q, 'c', s.c + q)")}, s -> s.c)"
    walk = f"aggregate(sequence(lo, hi - 1), named_struct('p', 1D, 'c', 1D, 'x', lo), (s, t) -> {_let('q', weight, "named_struct('p', q, 'c', s.c + q, 'x', if(s.c < goal, t + 1, s.x))")}, s -> s.x)"
    near = _let("d", "12 + 12 * sqrt(h.l * h.k / h.n * (1 - h.k / h.n))", _let("lo", "greatest(h.least, cast(floor(h.l * h.k / h.n - d) as bigint))", _let("hi", "least(h.most, cast(ceil(h.l * h.k / h.n + d) as bigint))", _let("goal", f"h.u * {sums}", walk))))
    number = ", ".join(f"'{n}', cast({x} as double)" for n, x in (("n", total), ("k", kind), ("l", draws), ("u", chance)))
    return _let("h", f"named_struct({number}, 'least', greatest(0L, {draws} + {kind} - {total}), 'most', least({kind}, {draws}))", f"if(h.least >= h.most, h.least, {near})")


def _left(seed: int, draws: str) -> str:
    """Of `ks`, an array of (s, k): how many of each are among the left child's draws, one kind after the other from what is left of the urn."""
    chance = f"(shiftrightunsigned(xxhash64({seed}, node, x.s), 11) + 0.5D) * {2.0**-53!r}D"
    took = _let("v", _drawn("acc.n", "x.k", "acc.l", chance), "named_struct('n', acc.n - x.k, 'l', acc.l - v, 'out', array_append(acc.out, v))")
    # an array that grows is copied at each step: parts of some square root of all are folded each for itself, then joined
    nothing = "cast(array() as array<bigint>)"
    part = f"aggregate(slice(ks, i * w + 1, w), named_struct('n', so_far.n, 'l', so_far.l, 'out', {nothing}), (acc, x) -> {took})"
    joined = _let("r", part, "named_struct('n', r.n, 'l', r.l, 'out', concat(so_far.out, r.out))")
    urn = f"named_struct('n', aggregate(ks, 0L, (a, x) -> a + x.k), 'l', {draws}, 'out', {nothing})"
    fold = f"aggregate(sequence(0, cast(ceil(size(ks) / w) as int) - 1), {urn}, (so_far, i) -> {joined}, so_far -> so_far.out)"
    return f"if(size(ks) = 0, {nothing}, {_let('w', 'cast(ceil(sqrt(size(ks))) as int)', fold)})"


def _children(nodes: DataFrame, keep: str = "") -> DataFrame:
    """A node's rows for both children; `left` says what goes to the left one."""
    half = lambda side, k: f"named_struct('node', 2 * node + {side}, 'ks', zip_with(ks, `left`, (x, y) -> named_struct('s', x.s, 'k', {k})){keep.format(side=side)})"
    return nodes.select(F.explode(F.expr(f"array({half(0, 'y')}, {half(1, 'x.k - y')})")).alias("c"), *(["g"] if keep else [])).select("c.*", *(["g"] if keep else []))


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED, groups: int = GROUPS, keep=held) -> DataFrame:
    """(skey, quota) to (skey, shard, q): the tree's leaves. shards is a power of 2.

    The tree is split for groups of sources, a node a row, then for each group's sources, a node of a group a row.
    Each level is kept, so that no plan holds the expressions of several.
    """
    depth = shards.bit_length() - 1
    if 1 << depth != shards:
        raise ValueError("shards is a power of 2")
    pair = F.struct(F.col("skey").alias("s"), F.col("quota").cast("bigint").alias("k"))
    urns = quotas.filter(F.col("quota") > 0).groupBy(F.pmod(F.xxhash64(F.lit(seed), "skey"), F.lit(groups)).cast("int").alias("g")).agg(F.sort_array(F.collect_list(pair)).alias("ks"))
    urns = materialize(urns, "mix-urns", narrow=True)
    all_ = urns.select(F.struct(F.col("g").alias("s"), F.expr("aggregate(ks, 0L, (a, x) -> a + x.k)").alias("k")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("ks"))
    nodes = all_.select(F.lit(1).cast("bigint").alias("node"), "ks")
    half = f"{_let('d', 'aggregate(ks, 0L, (a, x) -> a + x.k)', f'd div 2 + if(d % 2 = 1 and pmod(xxhash64({seed}, node), 2) = 0, 1L, 0L)')}"
    for _ in range(depth):
        nodes = keep(_children(nodes.withColumn("left", F.expr(_left(seed, half)))))
    leaves = nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.explode("ks").alias("x")).groupBy(F.col("x.s").alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "x.k"))), lambda x: x["k"]).alias("qs"))
    nodes = urns.join(leaves, "g").select("g", F.lit(1).cast("bigint").alias("node"), "ks", "qs")
    for i in range(depth):
        n = shards >> i + 1  # leaves below each child
        nodes = keep(_children(nodes.withColumn("left", F.expr(_left(seed + 1, f"aggregate(slice(qs, 1, {n}), 0L, (a, x) -> a + x)"))), f", 'qs', slice(qs, 1 + {n} * {{side}}, {n})"))
    return nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.explode("ks").alias("x")).select(F.col("x.s").alias("skey"), "shard", F.col("x.k").alias("q"))


def _meet(rows: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    """rows (with __skey and __h) with their source's row of side: broadcast if that is few, else each source dealt to SALTS places, as one may have most rows."""
    if few:
        return rows.join(F.broadcast(side), "__skey")
    side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int")).join(side, ["__skey", "__salt"]).drop("__salt")


class Plan(NamedTuple):
    rows: DataFrame  # doc_id, size and place (PLACE) of each document
    #: skey, source_size, target, full (whole passes), limit (blocks before this place are in the last pass, all without one), part_at and cut (of this place
    #: documents up to the cut are), fills (blocks that are), extra_h and extra_block (a document that is), bounds (pass and place at which each next shard begins)
    sources: DataFrame


def _cut(rows: DataFrame, part: DataFrame, keep) -> DataFrame:
    """Of part (skey, block, want): the last hash up to which documents in order fit into want, and their words. Ranges of hashes first, then one range's documents."""
    inner = rows.select(F.col("__skey").alias("skey"), F.col("__block").alias("block"), F.col("__h").alias("h"), "size").join(F.broadcast(part) if part.count() <= FEW_IDS else part, ["skey", "block"])
    inner = keep(inner.groupBy("skey", "want", "h").agg(F.sum("size").alias("size")).withColumn("range", F.shiftright("h", 52)))
    ranges = inner.groupBy("skey", "want", "range").agg(F.sum("size").alias("size"), F.max("h").alias("h")).withColumn("upto", F.sum("size").over(Window.partitionBy("skey").orderBy("range")))
    fits = F.col("upto") <= F.col("want")
    told = ranges.groupBy("skey", "want").agg(F.max(F.when(fits, F.col("h"))).alias("h0"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("base"), F.min(F.when(~fits, F.col("range"))).alias("range"))
    last = inner.join(told.select("skey", "range", "base"), ["skey", "range"]).withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("skey").orderBy("h")))
    last = last.filter(fits).groupBy("skey").agg(F.max("h").alias("h1"), F.max("upto").alias("upto"))
    return told.join(last, "skey", "left").select("skey", F.coalesce("h1", "h0").alias("cut"), (F.col("want") - F.coalesce("upto", "base")).alias("gap"))


def plan(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> Plan:
    """docs needs doc_id, text, source."""
    with planned_once(docs.sparkSession):
        return _plan(docs, shards, blocks, seed)


def _plan(docs: DataFrame, shards: int, blocks: int, seed: int) -> Plan:
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(held(df))
        return kept[-1]

    rows = materialize(keyed(docs.select("doc_id", "text", "source"), blocks, seed).select("doc_id", words_of(F.col("text")).alias("size"), *PLACE), "mix-rows")
    sums = keep(rows.groupBy(F.col("__skey").alias("skey"), F.col("__block").alias("block"), F.col("__at").alias("at")).agg(F.sum("size").alias("words")))
    sources = targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size")))
    fill = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    df = sums.join(sources, "skey").withColumn("full", fill.cast("bigint"))
    df = df.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    order = Window.partitionBy("skey").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("before", F.sum("words").over(order) - F.col("words"))
    df = df.withColumn("kind", F.when(F.col("before") + F.col("words") <= F.col("rest"), "whole").when(F.col("before") < F.col("rest"), "part").otherwise("none"))
    df = keep(df.drop("source_size", "target"))
    # the block that is drawn in part, at most one a source: its documents in order while they fit
    part = df.filter("kind = 'part'")
    gaps = _cut(rows, part.select("skey", "block", (F.col("rest") - F.col("before")).alias("want")), keep).join(part.select("skey", F.col("at").alias("part_at")), "skey")
    df = df.join(gaps, "skey", "left").withColumn("kind", F.when((F.col("kind") == "part") & F.col("cut").isNull(), "none").otherwise(F.col("kind")))
    # then later blocks that fit into what is missing, in the permuted order
    could = (F.col("kind") == "none") & F.col("words").between(1, F.col("gap")) & (F.col("at") != F.col("part_at"))
    df = df.withColumn("upto", F.when(could, F.sum(F.when(could, F.col("words"))).over(order)))
    filled = F.col("upto") <= F.col("gap")
    df = keep(df.withColumn("kind", F.when(filled, "fill").otherwise(F.col("kind"))).withColumn("filled", F.when(filled, F.col("words"))))
    drawn = F.col("kind") != "none"
    one = df.groupBy("skey").agg(
        F.max("full").alias("full"), F.min(F.when(F.col("kind") != "whole", F.col("at"))).alias("limit"), F.max(F.when(F.col("kind") == "part", F.col("at"))).alias("part_at"),
        F.max("cut").alias("cut"), F.sort_array(F.collect_list(F.when(F.col("kind") == "fill", F.col("block")))).alias("fills"), (F.max("gap") - F.coalesce(F.sum("filled"), F.lit(0))).alias("gap"),
        F.sum(F.col("full") + drawn.cast("int")).alias("quota"),
    )
    one = keep(one)
    # and at last the one document left whose size is nearest to what is still missing; repeated rows count together, each of them is smaller
    taken = F.coalesce(F.col("__at") < F.col("limit"), F.lit(True)) | F.coalesce((F.col("__at") == F.col("part_at")) & (F.col("__h") <= F.col("cut")), F.lit(False)) | F.array_contains("fills", F.col("__block"))
    short = one.filter("gap > 0").select(F.col("skey").alias("__skey"), "gap", "limit", "part_at", "cut", "fills")
    left = _meet(rows, short, short.count() <= FEW_IDS).filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & ~taken)
    left = left.groupBy("__skey", "__block", "__h", "gap").agg(F.sum("size").alias("size"))
    best = left.groupBy("__skey", "gap").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "__h", "__block")).alias("b")).filter("b.miss < gap")
    one = one.join(best.select(F.col("__skey").alias("skey"), F.col("b.__h").alias("extra_h"), F.col("b.__block").alias("extra_block")), "skey", "left")
    tidy(docs.sparkSession)
    one = keep(one.withColumn("quota", F.col("quota") + F.col("extra_h").isNotNull().cast("int")))
    # a source's draws in order, numbered without gaps; a shard's run begins where the runs of those before it end
    draws = df.select("skey", "at", F.explode(F.expr("sequence(0L, full)")).alias("pass"), "full", "kind").filter((F.col("pass") < F.col("full")) | drawn).select("skey", "pass", "at")
    draws = draws.unionByName(one.filter("extra_h is not null").select("skey", F.col("full").alias("pass"), F.lit(_LAST).alias("at")))
    draws = draws.withColumn("nth", F.row_number().over(Window.partitionBy("skey").orderBy("pass", "at")).cast("bigint") - 1)
    ends = keep(split_tree(one.select("skey", "quota"), shards, seed, keep=keep).withColumn("nth", F.sum("q").over(Window.partitionBy("skey").orderBy("shard"))))
    bounds = draws.join(ends.select("skey", "nth"), ["skey", "nth"]).groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("pass", "at"))).alias("bounds"))
    out = sources.join(one.drop("gap", "quota"), "skey").join(bounds, "skey", "left")
    out = materialize(out.withColumn("bounds", F.coalesce("bounds", F.expr("cast(array() as array<struct<pass:bigint,at:bigint>>)"))), "mix-plan", narrow=True)
    release(*kept)
    tidy(docs.sparkSession)
    return Plan(rows, out)


def _drawn_in(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with PLACE) with __plan, their source's row, and __draws: array of (pass, shard) in which the document is."""
    n_bytes = sources.agg(F.sum(F.octet_length("skey") + 200 + 48 * F.size("bounds") + 4 * F.size("fills"))).first()[0] or 0
    side = sources.select(F.col("skey").alias("__skey"), F.struct("*").alias("__plan"))
    got = _meet(rows, side, n_bytes <= BROADCAST_BYTES)
    extra = "coalesce(__h = __plan.extra_h and __block = __plan.extra_block, false)"
    last = f"(coalesce(__at < __plan.limit, true) or coalesce(__at = __plan.part_at and __h <= __plan.cut, false) or array_contains(__plan.fills, __block) or {extra})"
    passes = f"filter(transform(sequence(0L, __plan.full), p -> named_struct('pass', p, 'at', if(p = __plan.full and {extra}, {_LAST}L, __at))), d -> d.pass < __plan.full or {last})"
    shard = "size(filter(__plan.bounds, b -> b.pass < d.pass or (b.pass = d.pass and b.at <= d.at)))"
    return got.withColumn("__draws", F.expr(f"transform({passes}, d -> named_struct('pass', cast(d.pass as int), 'shard', {shard}))"))


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix: docs' columns with copy, shard and shuffle_key, a row for each draw of each document."""
    got = _drawn_in(keyed(docs, blocks, seed), plan(docs, shards, blocks, seed).sources)
    own = [c for c in docs.columns if c not in ("copy", "shard", "shuffle_key")]
    out = got.select(*own, "__h", F.explode("__draws").alias("__d"))
    return out.select(*own, F.col("__d.pass").alias("copy"), F.col("__d.shard").alias("shard"), F.xxhash64(F.lit(seed + 3), "__d.shard", "__d.pass", "__h").alias("shuffle_key"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix in its order: by shard, then by the shuffle key; ranges of both, so that no shard is one task."""
    return mixed.repartitionByRange("shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws (copy:shard, joined by commas) of every document."""
    made = plan(docs)
    return _drawn_in(made.rows, made.sources).select(
        "doc_id", "size", F.col("__plan.source_size").cast("bigint").alias("source_size"), F.col("__plan.target").cast("double").alias("target"), (F.col("size") * F.size("__draws")).cast("bigint").alias("taken"),
        F.array_join(F.transform("__draws", lambda d: F.concat(d["pass"], F.lit(":"), d["shard"])), ",").alias("draws"),
    )
