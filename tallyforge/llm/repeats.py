"""Removal of repeated passages: every byte that a string of `length` bytes covers which also starts anywhere else.

The strings of `length` bytes ("windows") don't become rows, but for step 4. A window's smaller hashes decide where it can meet its like:

1. Equal texts are one text from here on; one that is there twice is a repeat as a whole.
2. Of each W places in a row that with the least hash of its K bytes is an anchor. Anchors are counted over all texts. A
   window with an anchor that is there once can't be repeated; of the others the rarest anchor is the owner, which equal
   windows share. Neighbouring windows of one owner are a piece of text.
3. Equal pieces are one, and repeats if there are two. An owner's unlike pieces are sorted as suffixes of phrases (the
   bytes from an anchor to the next) by `suffixes`; windows are equal whose phrases have one place in the suffix array and
   whose rests at both ends are equal.
4. An owner of very many unlike pieces is dealt to lots; what lots couldn't tell meets by windows' hashes.

Texts are shuffled once, to a table in buckets of their key, which the later steps join with narrow rows. Equality of texts
is that of 128 bits of their sha256, of pieces that of 128 bits, of phrases within one lot that of 64 bits.

Null and empty texts have no bytes; texts shorter than a window stay as they are. Windows of one text may overlap their
likes (a text of one repeated byte loses all). Rows with the same id are kept apart, null ids stay; other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import by_step, discard, materialize, shared_dir, small_batches, steps, utf8
from tallyforge.llm.suffixes import classes
from tallyforge.llm.textvec import CODES, mix, powers

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: Windows of one piece at most; longer runs are cut. Unlike pieces of an owner in one lot, of 4 MB at most: windows of larger groups meet once more, by their hashes.
PIECE, LOT = 512, 4096
#: Bytes of texts, and of pieces, that are worked on at once; a longer text is taken alone and in parts.
STEP, PART = 1 << 18, 1 << 18


class Shape(NamedTuple):
    """Bytes of a window, of an anchor, and places in a row of which one is an anchor."""

    length: int
    k: int
    w: int

    @property
    def inner(self) -> int:
        """Ranges of w places that lie within a window, less one."""
        return self.length - self.k - self.w + 1


def shape(length: int) -> Shape:
    k = min(32, max(1, length // 8))
    return Shape(length, k, min(128, max(1, (length - k) // 3)))


def prefix(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(CODES[data] * powers(_BASES[which], len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hashes of data[lo:hi], of their lengths, too."""
    if not len(lo):
        return np.zeros(0, U64)
    return mix((sums[hi] - sums[lo]) * powers(_INVERSES[which], len(sums))[lo] + (hi - lo).astype(U64))


def sliding(a: np.ndarray, w: int, of=np.minimum) -> np.ndarray:
    """of over each w values in a row."""
    n, s, m = len(a) - w + 1, 1, a
    if n <= 0:
        return a[:0]
    while 2 * s <= w:
        m = of(m[: len(m) - s], m[s:])
        s *= 2
    return of(m[:n], m[w - s : w - s + n]) if s < w else m[:n]


class Places(NamedTuple):
    """Of each place of joined texts: the hash of the k bytes there, and the least of w in a row; 0 where they don't fit in the text."""

    sums: np.ndarray
    hashes: np.ndarray
    least: np.ndarray


def places(data: np.ndarray, offsets: np.ndarray, sh: Shape) -> Places:
    n = len(data)
    sums = prefix(data, 0)
    hashes, least = np.zeros(n, U64), np.zeros(n, U64)
    if n >= sh.k + sh.w - 1:
        at = n - sh.k + 1
        h = np.maximum(mix((sums[sh.k :] - sums[:at]) * powers(_INVERSES[0], n + 1)[:at]), U64(1))
        hashes[:at] = h
        m = sliding(h, sh.w)
        least[: len(m)] = m
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes from here to the text's end
        least[left < sh.k + sh.w - 1] = 0
    return Places(sums, hashes, least)


def anchors(p: Places, sh: Shape) -> np.ndarray:
    """Places whose hash is the least of any w in a row that they are among."""
    padded = np.concatenate([np.zeros(sh.w - 1, U64), p.least])
    return np.flatnonzero((sliding(padded, sh.w, np.maximum) == p.hashes) & (p.hashes > 0))


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def parts(data: np.ndarray, offsets: np.ndarray, over: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets) of joined texts; one longer than PART is cut to parts that overlap by `over` bytes."""
    for i, j in steps(offsets, STEP):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j > i + 1 or hi - lo <= PART + over:
            yield lo, data[lo:hi], offsets[i : j + 1] - lo
        else:
            for at in range(lo, hi, PART):
                end = min(hi, at + PART + over)
                yield at, data[at:end], np.array([0, end - at])
                if end == hi:
                    break


def anchor_rows(sh: Shape):
    """(h, k1, k2): an anchor's hash and its text, twice if it is there more than once in the text."""

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        k1, k2 = (rows.column(i).to_numpy() for i in (0, 1))
        hs, docs, at = [], [], []
        for lo, some, off in parts(data, offsets, 2 * sh.w + sh.k):
            found = places(some, off, sh)
            a = anchors(found, sh)
            hs.append(found.hashes[a])
            at.append(a + lo)
            docs.append(np.searchsorted(offsets, a + lo, "right") - 1)
        h, doc, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, docs, at))
        # overlapping parts give a place twice, and at their edges anchors that the whole text hasn't: more anchors do no harm
        h, doc, at = (x[np.unique(at, return_index=True)[1]] for x in (h, doc, at))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        second = np.append(False, first[:-1]) & ~first if len(h) else first
        keep = first | second
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(k1[doc[keep]]), pa.array(k2[doc[keep]])], ["h", "k1", "k2"])

    return by_step(of, most=STEP)


def piece_rows(sh: Shape):
    """Rows of texts with the anchors that are there more than once, to rows of pieces: owner, hashes, text, first window, number of windows, whether windows within may be equal."""

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        k1, k2 = (rows.column(i).to_numpy() for i in (0, 1))
        hashes, n = (x.to_numpy() for x in rows.column(rows.schema.get_field_index("good")).flatten().flatten())
        h, at = np.unique(hashes.view(U64), return_index=True)
        n = n[at]
        rare = (np.minimum(n, 65535).astype(U64) << U64(48)) | (h >> U64(16))
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for lo, some, off in parts(data, offsets, sh.length - 1):
            p = places(some, off, sh)
            begin = runs(p.least)
            value = p.least[begin]
            found = np.minimum(np.searchsorted(h, value), max(0, len(h) - 1))
            known = h[found] == value if len(h) else np.zeros(len(value), bool)
            size = np.diff(np.append(begin, len(some)))
            owner = np.repeat(np.where(known, rare[found] if len(h) else 0, U64(0)), size)
            # a range with an anchor that is there once, or beyond the text's end, is 0, and so is all that it is in
            of_window = sliding(owner, sh.inner + 1)
            left = (np.repeat(off[1:], np.diff(off)) - np.arange(len(some)))[: len(of_window)]
            alive = np.flatnonzero((of_window > 0) & (left >= sh.length))
            if not len(alive):
                continue
            new = np.append(True, (np.diff(alive) != 1) | (of_window[alive[1:]] != of_window[alive[:-1]]))
            start = np.flatnonzero(new)
            since = np.arange(len(alive)) - np.repeat(start, np.diff(np.append(start, len(alive))))
            start = np.flatnonzero(since % PIECE == 0)
            count = np.diff(np.append(start, len(alive)))
            first = alive[start]
            end = first + count - 1 + sh.length
            second = prefix(some, 1)
            # equal windows within a piece have an anchor at two places: in a run longer than w, or in two runs
            i, j = np.searchsorted(begin, first, "right") - 1, np.searchsorted(begin, first + count - 1, "right")
            piece = np.repeat(np.arange(len(first)), j - i)
            run = np.arange(len(piece)) - np.repeat(np.cumsum(j - i) - (j - i), j - i) + np.repeat(i, j - i)
            again = np.zeros(len(first), bool)
            again[piece[size[run] > sh.w]] = True
            order = np.lexsort((value[run], piece))
            same = (value[run][order][1:] == value[run][order][:-1]) & (piece[order][1:] == piece[order][:-1])
            again[piece[order][1:][same]] = True
            doc = np.searchsorted(offsets, first + lo, "right") - 1
            for x, y in zip(out, (of_window[first].view(np.int64), spans(p.sums, first, end, 0).view(np.int64), spans(second, first, end, 1).view(np.int64), doc, first + lo - offsets[doc], count, again), strict=True):
                x.append(y)
        if out[0]:
            owner, h1, h2, doc, first, count, again = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(h1), pa.array(h2), pa.array(k1[doc]), pa.array(k2[doc]), pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(again)], ["owner", "h1", "h2", "k1", "k2", "first", "count", "again"])

    return by_step(of, most=STEP)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts with the pieces that are to be compared, to rows of these with their bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        wanted = batch.column(batch.schema.get_field_index("pieces"))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        pieces = wanted.flatten()
        names = [f.name for f in pieces.type]
        field = dict(zip(names, pieces.flatten(), strict=True))
        lo = offsets[doc] + field["first"].to_numpy()
        hi = lo + field["bytes"].to_numpy()
        for i in range(0, len(lo), 4096):
            raw = [data[a:b].tobytes() for a, b in zip(lo[i : i + 4096].tolist(), hi[i : i + 4096].tolist(), strict=True)]
            kept = ["owner", "lot", "lots", "h1", "h2", "full", "count"]
            yield pa.RecordBatch.from_arrays([*(field[c].slice(i, len(raw)) for c in kept), pa.array(raw, pa.binary())], [*kept, "piece"])


def repeated(data: np.ndarray, offsets: np.ndarray, count: np.ndarray, weight: np.ndarray, sh: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined pieces: each window's place, the number of its class, and how often windows of each class are there (those of a piece count `weight` times)."""
    p = places(data, offsets, sh)
    a = anchors(p, sh)
    piece = np.searchsorted(offsets, a, "right") - 1
    # a piece's phrases lie between its anchors; the last anchor of each stands for a mark that ends the piece
    last = np.append(piece[1:] != piece[:-1], True) if len(a) else np.zeros(0, bool)
    phrase = spans(p.sums, a, np.where(last, a, np.append(a[1:], 0)), 0)
    _, symbol = np.unique(phrase, return_inverse=True)
    text = np.append(np.where(last, 1, symbol + 2), 0).tolist()
    at = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    first, end = np.searchsorted(a, at), np.searchsorted(a, at + sh.inner + sh.w) - 1
    # of a window's first w places the first least one, of its last w places the last least one
    for ref, places_, step in ((p.least[at], first, 1), (p.least[at + sh.inner], end, -1)):
        off = np.arange(len(at))
        while len(off := off[p.hashes[a[places_[off]]] != ref[off]]):
            places_[off] += step
    same = classes(text, first, end - first)
    key = mix(spans(p.sums, at, a[first], 0) * U64(0xC2B2AE3D27D4EB4F) + mix(spans(p.sums, a[end], at + sh.length, 0) + mix((same * (1 << 20) + (end - first)).astype(U64))))
    _, number = np.unique(key, return_inverse=True)
    return at, number, np.bincount(number, np.repeat(weight, count))


FOUND = "owner long, h1 long, h2 long, at int, size int, w1 long, w2 long, open boolean"


def compare(sh: Shape):
    """Rows of pieces, an owner's lot together, to rows (at, size) of their repeated windows; of a lot that has others beside it also each window, or class of windows, by its hashes (w1, w2), open where it isn't known to be repeated."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).combine_chunks()
        data, offsets = utf8(col("piece"))
        owner, h1, h2, count = (col(c).to_numpy() for c in ("owner", "h1", "h2", "count"))
        full, lots = col("full").to_numpy(zero_copy_only=False), col("lots").to_numpy()
        at, number, times = repeated(data, offsets, count, np.where(full, 2, 1), sh)
        piece = np.repeat(np.arange(len(count)), count)
        twice = times[number] >= 2
        nth = at - offsets[piece]
        hit = twice & ~full[piece]
        edge = hit & ~np.append(False, hit[:-1] & (piece[1:] == piece[:-1])) if len(hit) else hit
        begin = np.flatnonzero(edge)
        size = np.add.reduceat(hit.astype(np.int64), begin) if len(begin) else begin
        if len(begin):  # runs of hits only: the sum up to the next run's begin is the run's length
            yield batch_of(owner[piece[begin]], h1[piece[begin]], h2[piece[begin]], nth[begin], size, None, None, np.zeros(len(begin), bool))
        many = lots[piece] > 1
        if many.any():
            one = np.zeros(len(at), bool)
            one[np.unique(number, return_index=True)[1]] = True
            told = np.flatnonzero(many & (one | ~twice))
            w1, w2 = (spans(prefix(data, k), at[told], at[told] + sh.length, k).view(np.int64) for k in (0, 1))
            yield batch_of(owner[piece[told]], h1[piece[told]], h2[piece[told]], nth[told], np.ones(len(told), np.int64), w1, w2, ~twice[told])

    def batch_of(owner, h1, h2, at, size, w1, w2, open_):
        empty = pa.nulls(len(owner), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(h1), pa.array(h2), pa.array(at, pa.int32()), pa.array(size, pa.int32()), empty if w1 is None else pa.array(w1), empty if w2 is None else pa.array(w2), pa.array(open_)], [x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.nbytes
            if size < STEP:
                continue
            table = pa.Table.from_batches(waiting)
            edges = groups(table)
            while len(edges) > 1 and size >= STEP:  # whole lots only; the last may go on
                sizes = np.cumsum(np.append(0, pc.binary_length(table.column("piece")).to_numpy()))
                stop = edges[max(1, int(np.searchsorted(sizes[edges], STEP, "right")) - 1)]
                yield from work(table.slice(0, stop))
                table = table.slice(stop)
                size = int(sizes[-1] - sizes[stop])
                edges = groups(table)
            waiting = table.to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting)
            edges = np.append(groups(table), table.num_rows)
            sizes = np.cumsum(np.append(0, pc.binary_length(table.column("piece")).to_numpy()))
            i = 0
            while i < len(edges) - 1:
                j = max(i + 1, int(np.searchsorted(sizes[edges], sizes[edges[i]] + STEP, "right")) - 1)
                yield from work(table.slice(edges[i], edges[j] - edges[i]))
                i = j

    def groups(table: pa.Table) -> np.ndarray:
        owner, lot = table.column("owner").to_numpy(), table.column("lot").to_numpy()
        return np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (lot[1:] != lot[:-1])))

    return run


def removed(sh: Shape):
    """Rows of texts with the starts of repeated windows to k1, k2, n_removed, n_spans, kept_sha256."""

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = rows.column(rows.schema.get_field_index("found"))
        edges, pairs = found.offsets.to_numpy(), found.flatten()
        edges = edges - edges[0]
        at, size = (x.to_numpy() for x in pairs.flatten())
        n_removed, n_spans, kept = [], [], []
        for i in range(rows.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            begin = at[edges[i] : edges[i + 1]]
            stop = begin + size[edges[i] : edges[i + 1]] - 1 + sh.length
            depth = np.zeros(len(text) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, stop, -1)
            gone = np.cumsum(depth)[:-1] > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))))
            kept.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept)], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])

    return by_step(of)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """key, text, n_bytes, sha, and 128 bits of it as k1 and k2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    piece = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    out = docs.select(F.col(key).alias("key"), text.alias("text")).select("key", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return out.withColumns({"k1": piece(1), "k2": piece(16)})


def _bucketed(texts: DataFrame, name: str, path: str) -> DataFrame:
    """A table in buckets of (k1, k2): later joins on them move its rows no more. As many buckets as shuffle partitions, so that a task of the aggregate before it writes whole buckets."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.format("parquet").bucketBy(n, "k1", "k2").option("path", path).option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").saveAsTable(name)
    return spark.table(name)


def distinct(docs: DataFrame, length: int = 400, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sh = shape(length)
    rows = _keyed(docs, key)
    name = f"tallyforge_texts_{uuid.uuid4().hex}"
    long = rows.filter(F.col("n_bytes") >= length)
    path = f"{shared_dir(spark)}/{name}"
    texts = _bucketed(long.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies")), name, path)
    try:
        seen = texts.select("k1", "k2", "text").mapInArrow(anchor_rows(sh), "h long, k1 long, k2 long")
        often = seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
        good = seen.join(often, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "n")).alias("good"))
        pieces = materialize(texts.join(good, ["k1", "k2"]).select("k1", "k2", "text", "good").mapInArrow(piece_rows(sh), "owner long, h1 long, h2 long, k1 long, k2 long, first long, count long, again boolean"), "pieces")
        piece = ["owner", "h1", "h2"]
        copies = texts.filter("copies > 1").select("k1", "k2", F.lit(True).alias("copied"))
        unlike = pieces.groupBy(*piece).agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "first")).alias("at"), F.first("count").alias("count"))
        unlike = unlike.select(*piece, "at.*", "again", "count", "n").join(copies, ["k1", "k2"], "left").withColumn("full", (F.col("n") > 1) | F.coalesce("copied", F.lit(False))).drop("copied")
        unlike = materialize(unlike, "unlike")
        owners = unlike.groupBy("owner").agg(F.count("*").alias("m"), F.max(F.col("again") & ~F.col("full")).alias("again"), F.min("full").alias("all_full")).filter("again or (m > 1 and not all_full)")
        compared = unlike.drop("again").join(owners.select("owner", "m"), "owner")
        lots = F.ceil(F.col("m") / LOT).cast("int")
        compared = compared.withColumns({"lots": lots, "lot": F.pmod("h1", lots).cast("int"), "bytes": F.col("count") + length - 1})
        asked = compared.groupBy("k1", "k2").agg(F.collect_list(F.struct("owner", "lot", "lots", "h1", "h2", "full", "count", "first", "bytes")).alias("pieces"))
        raw = texts.join(asked, ["k1", "k2"]).select("text", "pieces").mapInArrow(cut, "owner long, lot int, lots int, h1 long, h2 long, full boolean, count long, piece binary")
        dealt = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "owner", "lot").sortWithinPartitions("owner", "lot")
        found = materialize(dealt.mapInArrow(compare(sh), FOUND), "windows")
        met = found.filter("w1 is not null")
        again = met.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1")
        late = met.filter("open").join(again, ["w1", "w2"], "left_semi").select(*piece, "at", "size")
        whole = unlike.filter("full").select(*piece, F.lit(0).alias("at"), F.col("count").cast("int").alias("size"))
        windows = found.filter("w1 is null").select(*piece, "at", "size").unionByName(late).unionByName(whole)
        hits = pieces.join(windows, piece).select("k1", "k2", (F.col("first") + F.col("at")).alias("at"), F.col("size").cast("long").alias("size"))
        by_text = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "size")).alias("found"))
        some = texts.filter("copies = 1").join(by_text, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(removed(sh), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
        nothing = hashlib.sha256(b"").hexdigest()
        all_ = texts.filter("copies > 1").select("k1", "k2", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"))
        told = materialize(some.unionByName(all_), "removed")
        texts.written_to = path
        discard(pieces, unlike, found, texts)
    finally:
        spark.sql(f"drop table if exists {name}")
    out = rows.drop("text").join(told, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
