"""Benchmark decontamination by greedy string tiling.

Documents and test items meet in a join on hashes of MIN_MATCH words in a row (seeds). Each pair that can count is
tiled: rounds of Karp-Rabin matching find common runs of words of falling length; the longest unmarked run becomes
a tile and is marked in both texts, so that tiles never overlap and their order doesn't matter; of runs of one length
the one that begins first in the text, and then in the item, is marked first. A pair counts if
tiles cover THRESHOLD of the item's words: reordered passages are found like whole ones.

Both sides of the join are rows, and there are two passes over the documents whatever the benchmark's size: one keeps the seeds
that a bit table of all items' seeds (of 2**MOST_BITS bits at most) lets through, the other fetches the texts of pairs that can count. A tile's words lie in common seeds. So only an
item's rarest seeds are joined: those left out, the most frequent in documents, cover too few of its words to make a
pair count by themselves. A seed that a third of all documents or of all items share joins nothing unless the item
consists of such seeds. Before a pair is tiled, the item's words within common seeds are counted in the same way.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased. Edge cases: null or empty texts and items
have no words and match nothing; an item of fewer words than MIN_MATCH is one seed of all its words; repeated rows
give repeated results; an empty table gives an empty one; extra columns are ignored. Ids may be of any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import Sent, by_step, discard, held, known_few, materialize, release, small_batches, tidy
from tallyforge.llm.textvec import PLAIN, U64, mix, runs, words

MIN_MATCH, THRESHOLD = 4, 0.5
#: Bits of the seeds' table for each seed, and the most that its size may be, as a power of 2 (8 MB to each executor).
BITS_A_SEED, MOST_BITS = 16, 26
#: Items that one row brings together with a document.
LOT = 256


def _keys(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin values of each k words in a row."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), U64)
    for j in range(k if n > 0 else 0):
        out = out * U64(0x100000001B3) + h[j : j + n]
    return out


def _free(marked: np.ndarray, k: int) -> np.ndarray:
    """Places from which k words in a row are unmarked."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[k:] == total[:-k]) if len(marked) >= k else np.zeros(0, np.int64)


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, words) of two arrays of word hashes, longest first."""
    least = max(1, min(least, len(item)))
    if not len(item) or not len(text):
        return []
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    length = len(item)
    while length >= least:
        # every common run of `length` unmarked words; none is longer, as longer lengths have been searched
        at_item, at_text = _free(used_item, length), _free(used_text, length)
        if len(at_item) and len(at_text):
            a, b = _keys(item, length)[at_item], _keys(text, length)[at_text]
            order = np.argsort(a, kind="stable")
            low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
            for k in np.flatnonzero(high > low):
                j = at_text[k]
                for i in at_item[order[low[k] : high[k]]]:
                    if not used_item[i : i + length].any() and not used_text[j : j + length].any() and (item[i : i + length] == text[j : j + length]).all():
                        used_item[i : i + length] = used_text[j : j + length] = True
                        tiles.append((int(i), int(j), length))
                        break
        longest = _longest(item, text, used_item, used_text, length - 1, least)
        length = min(length - 1, longest)
    return tiles


def _longest(item: np.ndarray, text: np.ndarray, used_item: np.ndarray, used_text: np.ndarray, most: int, least: int) -> int:
    """The longest length of up to `most` at which an unmarked run is common: by halving, as a common run holds shorter ones."""

    def common(k: int) -> bool:
        a, b = _free(used_item, k), _free(used_text, k)
        return bool(len(a) and len(b) and np.isin(_keys(item, k)[a], _keys(text, k)[b]).any())

    low, high = least - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if common(mid) else (low, mid - 1)
    return low


def _covered(places: np.ndarray, n: int, k: int) -> int:
    """How many of n words lie in runs of k from these places."""
    step = np.zeros(n + k + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + k, -1)
    return int((np.cumsum(step)[:n] > 0).sum())


def _seeds(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, place) of all k words in a row; seeds of different lengths differ."""
    h, doc, at = runs(w, first, k)
    return mix(h + U64(k)), doc, at


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """item (a number), item_id, words (their hashes) and seeds, an array with one seed a place, of items that have words."""

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        w = words(data, offsets, PLAIN)
        hashes, seeds = [], []
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            own = w.hashes[a:b]
            hashes.append(own.tobytes())
            seeds.append(_seeds(own, np.array([0, len(own)]), min(least, len(own)))[0].view(np.int64).tolist() if len(own) else [])
        cols = [rows.column(0), pa.array(np.diff(w.first), pa.int32()), pa.array(hashes, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["item_id", "n", "words", "seeds"]).filter(pa.array(np.diff(w.first) > 0))

    picked = benchmark.select("item_id", F.col("text").alias("__text"))
    rows = picked.mapInArrow(by_step(of, "__text"), f"item_id {picked.schema['item_id'].dataType.simpleString()}, n int, words binary, seeds array<bigint>")
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "*"), "items")


def _filter_of(items: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """A bit table of all seeds, its number of bits as a power of 2, and the seeds' lengths that occur below the usual one."""
    told = items.agg(F.sum(F.size("seeds")).alias("n"), F.collect_set(F.when(F.size("seeds") == 1, F.col("n"))).alias("short")).first()
    bits = max(16, min(MOST_BITS, int((told["n"] or 1) * BITS_A_SEED).bit_length()))

    def run(batches):
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[(batch.column(0).flatten().to_numpy().view(U64) >> U64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(table)
        at = [i for i in range(0, len(packed), 4096) if packed[i : i + 4096].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[i : i + 4096].tobytes() for i in at], pa.binary())], ["at", "part"])

    def either(rows: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.column("part").to_pylist()])
        return pa.table({"at": rows.column("at").slice(0, 1), "part": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in items.select("seeds").mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(either, "at int, part binary").collect():
        out[r["at"] : r["at"] + len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    return out, bits, sorted(told["short"])


#: 128 bits of a text.
KEY = ["__text1", "__text2"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *(F.xxhash64(F.lit(i), "text").alias(k) for i, k in enumerate(KEY)))


def _met(docs: DataFrame, table: np.ndarray, bits: int, lengths: list[int]) -> DataFrame:
    """KEY and seeds (distinct) of the documents with a seed that the table lets through."""
    sent = Sent(docs.sparkSession, table)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        w = words(data, offsets, PLAIN)
        found = [(np.zeros(0, U64), np.zeros(0, np.int64))]
        for k in lengths:
            seed, doc, _ = _seeds(w.hashes, w.first, k)
            at = (seed >> U64(64 - bits)).astype(np.int64)
            ok = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            found.append((seed[ok], doc[ok]))
        seed, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((seed, doc))
        seed, doc = seed[order], doc[order]
        new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])]) if len(seed) else np.zeros(0, bool)
        seed, doc = seed[new], doc[new]
        first = np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(first), pa.array(seed.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*rows.columns[:2], lists], [*KEY, "seeds"]).filter(pa.array(np.diff(first) > 0))

    rows = _keyed(docs).select(*KEY, "text").mapInArrow(by_step(of), f"{KEY[0]} bigint, {KEY[1]} bigint, seeds array<bigint>")
    return materialize(rows, "met")


def _rarest(items: DataFrame, seeds: DataFrame, least: int, threshold: float) -> DataFrame:
    """(seed, item): of each item the seeds that documents have, rarest first, without the last ones that cover too little by themselves."""
    df = seeds.groupBy("seed").agg(F.count("*").alias("df"))
    places = items.select("item", "n", F.posexplode("seeds").alias("at", "seed"))
    told = places.join(df, "seed").groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("df", "seed", "at"))).alias("found"))

    def choose(batches):
        for batch in batches:
            item, out = [], []
            found = batch.column(2)
            for i in range(batch.num_rows):
                n = batch.column(1)[i].as_py()
                own = found[i].values
                at, seed = own.field("at").to_numpy().astype(np.int64), own.field("seed").to_numpy()
                k, need = min(least, n), threshold * n
                # the most of the frequent end that covers less than what is needed: by halving, as more seeds cover more
                low, high = 0, len(at)
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if _covered(at[len(at) - mid :], n, k) < need else (low, mid - 1)
                rare = np.unique(seed[: len(at) - low])
                item += [batch.column(0)[i].as_py()] * len(rare)
                out.append(rare)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *out])), pa.array(item, pa.int64())], ["seed", "item"])

    return told.mapInArrow(choose, "seed bigint, item bigint")


def _tiled(rows: DataFrame, least: int, threshold: float) -> DataFrame:
    """KEY, text, items (array of item, words) to KEY, item, item_words, matched_words, n_tiles, coverage of the pairs that count."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(2)[i].as_py() or "").encode("utf-8", "replace")
                w = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), PLAIN).hashes
                own, out = {}, []
                for item, raw in zip(*(batch.column(3)[i].values.field(f).to_pylist() for f in ("item", "words")), strict=True):
                    h = np.frombuffer(raw, U64)
                    k = min(least, len(h))
                    if k not in own:
                        own[k] = np.unique(_keys(w, k))
                    places = np.flatnonzero(np.isin(_keys(h, k), own[k]))
                    if _covered(places, len(h), k) >= threshold * len(h):
                        got = tile(h, w, least)
                        matched = sum(t[2] for t in got)
                        if matched >= threshold * len(h) and matched:
                            out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), item, len(h), matched, len(got), matched / len(h)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [*KEY, "item", "item_words", "matched_words", "n_tiles", "coverage"])

    return rows.select(*KEY, "text", "items").mapInArrow(run, f"{KEY[0]} bigint, {KEY[1]} bigint, item bigint, item_words int, matched_words int, n_tiles int, coverage double")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item that it covers: doc_id, item_id, item_words, matched_words, n_tiles, coverage."""
    small_batches(docs.sparkSession)
    items = _items(benchmark, least)
    table, bits, short = _filter_of(items)
    met = _met(docs, table, bits, sorted({*(k for k in short if k < least), least}))
    seeds = met.select(*KEY, F.explode("seeds").alias("seed"))
    rare = held(_rarest(items, seeds, least, threshold))
    pairs = materialize(seeds.join(known_few(rare), "seed").select(*KEY, "item").distinct(), "pairs", narrow=True)
    # a text's items in lots, so that no row holds all items of a text that has many
    lots = pairs.groupBy(*KEY).agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, KEY).withColumn("lot", F.pmod(F.xxhash64("item"), F.col("lots")))
    dealt = dealt.join(items.select("item", "words"), "item").groupBy(*KEY, "lot").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    wanted = held(pairs.select(*KEY).distinct())
    rows = materialize(_keyed(docs).join(known_few(wanted), KEY, "left_semi"), "candidates")
    release(rare, wanted)
    found = _tiled(dealt.join(rows.select(*KEY, "text").dropDuplicates(KEY), KEY), least, threshold)
    found = materialize(found.join(items.select("item", "item_id"), "item"), "tiled")
    discard(met)
    tidy(docs.sparkSession)
    return rows.select("doc_id", *KEY).join(found, KEY).select("doc_id", "item_id", "item_words", "matched_words", "n_tiles", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no item is found in, told by their texts: rows of a null or repeated id are judged each by its own."""
    key = F.md5(F.col("text").cast("binary"))
    found = materialize(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("__md5")).distinct(), "contaminated", narrow=True)
    return docs.join(known_few(found), key == F.col("__md5"), "left_anti").select(*docs.columns)
