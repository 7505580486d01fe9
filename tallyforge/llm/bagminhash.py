"""Near-duplicates by BagMinHash signatures of word-shingle multisets.

A document is the multiset of its runs of SHINGLE words. For each shingle and each dyadic block of weights
[0,1], [1,2], [2,4], [4,8], ... a Poisson process, seeded by both, throws points (time, weight, slot); a point
counts if its weight is within the shingle's count. A slot of the signature is the earliest point that falls into
it, so that two documents agree in a slot with the probability of their weighted Jaccard similarity. Blocks aren't
split further; points are made in order of time up to a bound of the document that, for most, fills all slots; those it
doesn't fill run again with a larger one. The signature is exact either way, and of most shingles only the first
point's time is looked at.

Bands of ROWS slots propose pairs, the whole signature's estimate drops those below `hopeless` (0: none), and the exact
overlap of the multisets decides, for buckets of every size. Within a bucket not all pairs are made: all its documents
meet one pivot, the one of most company in all bands; those that aren't yet in one component then meet further pivots,
twice as many in each round, until every two documents of a bucket are in one component or have been compared (of two
documents of different components at least one has been a pivot). Components are the classes.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased; equal sequences of words are copies, and one
of them (a node) stands for all. A document of fewer words than SHINGLE is one shingle; one without words is alike to none.
A null text has no words. Rows are told apart by id and text, not by the id alone: repeated rows are copies, and of
one id's different texts each has a class. A class is named by its least doc_id, null ids aside; without any its name is null.
An empty table gives an empty one; extra columns are ignored by `classes` and kept by `dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import by_step, discard, held, known_few, materialize, release, small_batches, steps, tidy, utf8
from tallyforge.llm.textvec import PLAIN, U64, mix, powers, runs, uniform, words

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share aren't compared: over five standard errors below SIMILAR.
HOPELESS = 0.6
#: Pivots of a bucket in the first of the later rounds; documents, and bytes of them, that meet a lot of pivots in one task.
PIVOTS, CHUNK, CHUNK_BYTES = 128, 256, 4 << 20
#: Documents of a bucket up to which its pairs are rows.
SMALL = 32
#: Shared shingles that one vectorised step of such a meeting counts at once, and shingles whose points are made at once.
COUNTED, THROWN = 1 << 20, 1 << 18
#: Pairs whose ids (16 bytes a pair) may be broadcast.
FEW = 200_000


def shingles(data: np.ndarray, offsets: np.ndarray):
    """(text, shingle, count) without repeats, sorted by text; and the words."""
    w = words(data, offsets, PLAIN)
    n = np.diff(w.first)
    h, doc, _ = runs(w.hashes, w.first, SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.zeros(len(short), U64)
        for j in range(SHINGLE - 1):
            there = n[short] > j
            own[there] = own[there] * U64(0xC2B2AE3D27D4EB4F) + w.hashes[w.first[short[there]] + j]
        h, doc = np.concatenate([h, mix(own ^ U64(0x5851F42D4C957F2D))]), np.concatenate([doc, short])
    # one sort key of both; what it leaves of the hash only orders equal shingles apart in one case in 2**44
    order = np.argsort((doc.astype(U64) << U64(44)) | (h >> U64(20)))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[at], h[at], np.diff(np.append(at, len(h))), w


def _points(doc, key, low, width, count, bound, n_docs, out) -> None:
    """Lower `out` (texts x slots) by all points up to each text's bound; one row of the arrays is a block of a shingle."""
    time = np.zeros(len(key))
    i = 0
    flat = out.reshape(-1)
    while len(key):
        i += 1
        r = mix(key + U64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(uniform(r)) / width
        on = time <= bound[doc]
        if not on.all():
            doc, key, low, width, count, time, r = doc[on], key[on], low[on], width[on], count[on], time[on], r[on]
        q = mix(r ^ U64(0x2545F4914F6CDD1D))
        level = low + np.floor(uniform(mix(q)) * width)  # the unit of weight that the point falls into
        hit = level < count
        np.minimum.at(flat, doc[hit] * SLOTS + (q[hit] % U64(SLOTS)).astype(np.int64), time[hit])


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """Earliest times (texts x SLOTS); infinite for texts without shingles."""
    out = np.full((n_docs, SLOTS), np.inf)
    total = np.bincount(doc, count, n_docs)
    bound = np.where(total > 0, SLOTS * (np.log(SLOTS) + 2.3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        out[todo] = np.inf
        at = np.flatnonzero(todo[doc])
        for i in range(0, len(at), THROWN):
            part = at[i : i + THROWN]
            d, s, c = doc[part], shingle[part], count[part]
            # blocks of weights: the first for all, the k-th (from 2**(k-1) up to 2**k) for counts above its lower end
            blocks = [(d, mix(s), np.zeros(len(d)), np.ones(len(d)), c)]
            k = 0
            while (more := c > (1 << k)).any():
                d, s, c = d[more], s[more], c[more]
                blocks.append((d, mix(s + U64(k + 1)), np.full(len(d), float(1 << k)), np.full(len(d), float(1 << k)), c))
                k += 1
            _points(*(np.concatenate(x) for x in zip(*blocks, strict=True)), bound, n_docs, out)
        todo &= ~np.isfinite(out).all(1)
        bound = bound * 2
    return out


def _sequence_hash(w, n_docs: int, base: int) -> np.ndarray:
    """A hash of each text's words in order."""
    inverse = pow(base, -1, 1 << 64)
    n = len(w.hashes)
    sums = np.zeros(n + 1, U64)
    np.cumsum(w.hashes * powers(base, max(n, 1))[:n], out=sums[1:])
    h = (sums[w.first[1:]] - sums[w.first[:-1]]) * powers(inverse, n + 1)[w.first[:-1]]
    return mix(h + np.diff(w.first).astype(U64))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with 128 bits of each row's id and text, never null."""
    return docs.withColumns({f"__row{i}": F.xxhash64(F.lit(i), "doc_id", "text") for i in (1, 2)})


KEY = ["__row1", "__row2"]


def sign(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and n_bytes, n_words, e1 and e2 (128 bits of the words in order), bands (hashes), sig (16 bits of each slot)."""
    small_batches(docs.sparkSession)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        n = rows.num_rows
        doc, sh, count, w = shingles(data, offsets)
        bits = mix(signatures(doc, sh, count, n).view(U64))
        band = np.zeros((n, BANDS), U64)
        for r in range(ROWS):
            band = mix(band * U64(31) + bits[:, r * BANDS : (r + 1) * BANDS])
        band = mix(band + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        low = np.ascontiguousarray((bits >> U64(48)).astype(np.uint16))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel()))
        cols = [*rows.columns[:-1], pa.array(np.diff(offsets)), pa.array(np.diff(w.first)), pa.array(_sequence_hash(w, n, 0xD1342543DE82EF95).view(np.int64)), pa.array(_sequence_hash(w, n, 0xA0761D6478BD642F).view(np.int64)), lists, pa.array([x.tobytes() for x in low], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, [*rows.schema.names[:-1], "n_bytes", "n_words", "e1", "e2", "bands", "sig"])

    picked = docs.select(*keep, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(by_step(of), ", ".join([*kinds, "n_bytes bigint, n_words bigint, e1 bigint, e2 bigint, bands array<bigint>, sig binary"]))


def overlap(a: tuple, b: tuple, n: int) -> np.ndarray:
    """Weighted Jaccard of the n texts of two lots of (text, shingle, count)."""
    doc, sh, count = (np.concatenate([x, y]) for x, y in zip(a[:3], b[:3], strict=True))
    order = np.lexsort((sh, doc))
    doc, sh, count = doc[order], sh[order], count[order]
    twice = np.flatnonzero((doc[1:] == doc[:-1]) & (sh[1:] == sh[:-1])) if len(doc) else np.zeros(0, np.int64)
    both = np.bincount(doc[twice], np.minimum(count[twice], count[twice + 1]), n)
    total = np.bincount(doc, count, n)
    return np.where(total > both, both / np.maximum(total - both, 1), 0.0)


def _alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The share of slots in which signatures agree."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, SLOTS) for s in (a, b))
    return (x == y).mean(1)


def _verify(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, least: float, hopeless: float) -> DataFrame:
    """Of pairs (a, b): those of a weighted Jaccard similarity of `least` or more."""
    small_batches(pairs.sparkSession)

    def side(t: DataFrame, x: str, col: str) -> DataFrame:
        return t.select(F.col("node").alias(x), F.col(col).alias(f"{col}_{x}"))

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(_alike(batch.column(2), batch.column(3)) >= hopeless))

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                (x, at), (y, to) = utf8(batch.column(2)), utf8(batch.column(3))
                for i, j in steps(at + to):
                    score = overlap(shingles(x[at[i] : at[j]], at[i : j + 1] - at[i]), shingles(y[to[i] : to[j]], to[i : j + 1] - to[i]), j - i)
                    yield batch.slice(i, j - i).select([0, 1]).filter(pa.array(score >= least))

    sigs = _needed(sigs, pairs)
    signed = pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").select("a", "b", "sig_a", "sig_b")
    hopeful = materialize(signed.mapInArrow(alike, "a bigint, b bigint"), "hopeful")
    texts = _needed(texts, hopeful)
    told = hopeful.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").select("a", "b", "text_a", "text_b")
    return told.mapInArrow(exact, "a bigint, b bigint")


def _needed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of documents in pairs; without a shuffle of all rows if the ids are few, which is counted first."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return rows.join(F.broadcast(ids) if pairs.count() <= FEW else ids, "node", "left_semi")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, size of each text): a shingle's k-th occurrence is a token of its own, so that sets overlap as multisets do."""
    data, offsets = utf8(texts)
    parts = [(doc + i, sh, count) for i, j in steps(offsets) for doc, sh, count, _ in [shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]]
    doc, sh, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), mix(np.repeat(sh, count) + nth.astype(U64)), np.bincount(doc, count, len(texts))


def meet(pivots: pa.Array, others: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, other) of all pairs of texts of a similarity of `least` or more: exact overlaps by an index of the pivots' shingles."""
    owner, token, size_p = _tokens(pivots)
    order = np.argsort(token, kind="stable")
    only, first = np.unique(token[order], return_index=True)
    last = np.append(first[1:], len(order))
    owner = owner[order]
    doc, token, size_o = _tokens(others)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(only) or not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(only, token), len(only) - 1)
    hit = np.flatnonzero(only[at] == token)
    doc, at = doc[hit], at[hit]
    n = last[at] - first[at]
    work = np.concatenate([[0], np.cumsum(n)])
    edges = np.concatenate([np.searchsorted(doc, np.arange(len(size_o) + 1))])  # tokens of each text
    i = 0
    while i < len(size_o):
        j = max(i + 1, int(np.searchsorted(work[edges], work[edges[i]] + COUNTED, "right")) - 1)
        part = slice(edges[i], edges[j])
        m = n[part]
        place = np.repeat(first[at[part]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        both = np.bincount(np.repeat(doc[part] - i, m) * len(size_p) + owner[place], minlength=(j - i) * len(size_p)).reshape(j - i, -1)
        total = size_o[i:j, None] + size_p[None, :] - both
        x, y = np.nonzero((both > 0) & (both >= least * total))
        out.append((y, x + i))
        i = j
    return np.concatenate([p for p, _ in out]), np.concatenate([o for _, o in out])


def _lots(n: Column, n_bytes: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / most), F.ceil(n_bytes / CHUNK_BYTES)).cast("int")


def _meetings(members: DataFrame, pivots: DataFrame, texts: DataFrame, sigs: DataFrame, least: float, hopeless: float) -> DataFrame:
    """Links (a, b) between pivots (band, node, comp) and the documents of other components in their buckets (band, node, comp, chunks, lots).
    A bucket's documents are dealt to chunks by a hash and its pivots to lots; each chunk meets each lot, in a task of its own."""
    small_batches(members.sparkSession)

    def dealt(rows: DataFrame, pivot: bool) -> DataFrame:
        own, other = ("lots", "chunks") if pivot else ("chunks", "lots")
        to = rows.select("band", "node", "comp", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        return to.select("band", F.col("other" if pivot else "own").alias("chunk"), F.col("own" if pivot else "other").alias("lot"), F.lit(pivot).alias("pivot"), "node", "comp")

    rows = dealt(members, False).unionByName(dealt(pivots, True)).join(texts, "node").join(sigs, "node").select("band", "chunk", "lot", "pivot", "node", "comp", "text", "sig")

    def link(table: pa.Table) -> pa.Table:
        is_pivot = table.column("pivot").to_numpy()
        p, o = table.filter(pa.array(is_pivot)).combine_chunks(), table.filter(pa.array(~is_pivot)).combine_chunks()
        x, y = meet(p.column("text"), o.column("text"), least)
        comps = [t.column("comp").to_numpy() for t in (p, o)]
        apart = comps[0][x] != comps[1][y]
        x, y = pa.array(x[apart]), pa.array(y[apart])
        if len(x):
            ok = pa.array(_alike(p.column("sig").take(x), o.column("sig").take(y)) >= hopeless)
            x, y = x.filter(ok), y.filter(ok)
        return pa.table({"a": p.column("node").take(x), "b": o.column("node").take(y)})

    return rows.groupBy("band", "chunk", "lot").applyInArrow(link, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, comp) of every node in one, comp the least: alternating large and small stars
    until each edge leads to its component's least node. Each round is written to the shared folder."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", narrow=True)
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        last, e = e, materialize(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct(), "edges", narrow=True)
        discard(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after links (a, b) have joined components: only the components' own graph is searched."""
    side = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    moved = components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return comp.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def _linked(docs: DataFrame, nodes: DataFrame, least: float, hopeless: float) -> DataFrame:
    """(node, comp) of the nodes that share a band with another."""
    in_band = nodes.select("node", "n_bytes", F.explode("bands").alias("band"))
    # what is known of a bucket is held before rows meet it, so that a hot bucket's rows may be split among tasks
    full = held(in_band.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = materialize(in_band.join(known_few(full), "band"), "members", narrow=True)
    # the first pivot of a bucket is its document of most company over all bands: of a text and its altered copies, the text
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = held(shared.join(weight, "node").select("band", "node", "n_bytes", "weight"))
    first = held(weighed.groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot")))
    members = materialize(weighed.join(known_few(first), "band"), "members", narrow=True)
    wanted = materialize(members.select("node").distinct(), "wanted", narrow=True)
    keys = held(nodes.select("node", *KEY).join(known_few(wanted), "node", "left_semi"))
    texts = materialize(_keyed(docs.select("doc_id", "text")).join(known_few(keys), KEY).select("node", "text").dropDuplicates(["node"]), "texts")
    sigs = materialize(nodes.select("node", "sig").join(known_few(wanted), "node", "left_semi"), "sigs")
    pairs = materialize(members.filter("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct(), "pairs", narrow=True)
    release(full, weighed, first, keys)
    tidy(docs.sparkSession)
    links = materialize(_verify(pairs, sigs, texts, least, hopeless), "links")
    comp = materialize(_merged(wanted.withColumn("comp", F.col("node")), links), "comp", narrow=True)
    discard(shared, pairs, links)
    members = members.filter("node <> pivot").select("band", "node", "n_bytes")  # without pivots: they have met all others
    most = PIVOTS
    while True:
        known = members.join(comp, "node")
        open_ = known.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).filter("x <> y").select("band", "n", "bytes")
        open_ = held(open_)
        if open_.isEmpty():
            release(open_)
            break
        members = materialize(known.join(known_few(open_), "band"), "members", narrow=True)
        release(open_)
        sizes = members.groupBy("band", "comp").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("m_bytes"))
        main = sizes.groupBy("band").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max(F.struct("m", "comp", "m_bytes")).alias("of"))
        main = held(main.select("band", "main", F.col("of.m").alias("m"), F.col("of.m_bytes").alias("m_bytes")))
        # pivots are some `most` documents outside of a bucket's largest component, drawn by a hash: no bucket is sorted
        known = members.join(known_few(main), "band")
        share = F.least(F.lit(1.0), F.lit(float(most)) / (F.col("n") - F.col("m")))
        known = known.withColumn("chunks", _lots(F.col("n"), F.col("bytes"), CHUNK)).withColumn("lots", _lots((F.col("n") - F.col("m")) * share, (F.col("bytes") - F.col("m_bytes")) * share, PIVOTS))
        chosen = (F.col("comp") != F.col("main")) & (F.pmod(F.xxhash64(F.lit(most), "band", "node"), F.lit(1 << 30)) < share * (1 << 30))
        known = materialize(known.select("band", "node", "n_bytes", "comp", "n", "chunks", "lots", chosen.alias("pivot")), "rounds", narrow=True)
        release(main)
        # small buckets by pairs, which signatures thin out; large ones by meetings, which make no rows of pairs
        small = F.col("n") <= SMALL
        pivots = known.filter("pivot")
        pairs = materialize(known.filter(small).select("band", "node", "comp").join(pivots.filter(small).select("band", F.col("node").alias("p"), F.col("comp").alias("own")), "band").filter("comp <> own").select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).distinct(), "pairs", narrow=True)
        found = _verify(pairs, sigs, texts, least, hopeless)
        if not pivots.filter(~small).isEmpty():
            found = found.union(_meetings(known.filter(~small), pivots.filter(~small), texts, sigs, least, hopeless))
        links = materialize(found, "links")
        if not links.isEmpty():
            comp = materialize(_merged(comp, links), "comp", narrow=True)
        discard(members, pairs, links)
        members = known.filter("not pivot").select("band", "node", "n_bytes")
        most *= 2
    discard(texts, sigs, wanted)
    tidy(docs.sparkSession)
    return comp


def _classed(docs: DataFrame, least: float, hopeless: float) -> DataFrame:
    """doc_id, the row's key, class_id and `lead`, the key of the class's row that stays, of every row of docs."""
    signed = materialize(sign(_keyed(docs.select("doc_id", "text")), ("doc_id", *KEY)), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *KEY)
    alike = signed.filter("n_words > 0").groupBy("e1", "e2").agg(F.min(row).alias("lead"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(alike.select(F.monotonically_increasing_id().alias("node"), "e1", "e2", "lead", *(F.col(f"lead.{k}").alias(k) for k in KEY), "n_bytes", "bands", "sig"), "nodes")
    comp = _linked(docs, nodes, least, hopeless)
    heads = nodes.select("node", "lead").join(comp, "node").groupBy("comp").agg(F.min("lead").alias("head"))
    heads = materialize(comp.join(heads, "comp").select("node", "head"), "heads", narrow=True)
    named = nodes.select("e1", "e2", "node", "lead").join(heads, "node", "left").select("e1", "e2", F.coalesce("head", "lead").alias("lead"))
    out = signed.select("doc_id", *KEY, "e1", "e2", (F.col("n_words") > 0).alias("worded")).join(named, ["e1", "e2"], "left").withColumn("lead", F.when(F.col("worded"), F.col("lead")).otherwise(row))
    return out.select("doc_id", *KEY, F.col("lead.doc_id").alias("class_id"), F.struct(*(F.col(f"lead.{k}") for k in KEY)).alias("lead"))


def classes(docs: DataFrame, least: float = SIMILAR, hopeless: float = HOPELESS) -> DataFrame:
    """doc_id and class_id of every row of docs (doc_id, text). With hopeless = 0 every pair that shares a band is compared exactly or linked by others."""
    return _classed(docs, least, hopeless).select("doc_id", "class_id")


def dedup(docs: DataFrame, least: float = SIMILAR, hopeless: float = HOPELESS) -> DataFrame:
    """docs with one row of each class: of the least doc_id, null ids last."""
    of = materialize(_classed(docs, least, hopeless), "classes")
    key = F.struct(*KEY)
    gone = materialize(of.filter(key != F.col("lead")).select(*KEY).distinct(), "gone", narrow=True)
    repeated = materialize(of.filter(key == F.col("lead")).groupBy(*KEY).count().filter("count > 1").select(*KEY), "repeated", narrow=True)
    left = _keyed(docs).join(known_few(gone), KEY, "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    one = left.join(known_few(repeated), KEY, "left_semi").dropDuplicates(KEY)
    return left.join(known_few(repeated), KEY, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
