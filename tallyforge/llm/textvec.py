"""Words of whole texts as numpy arrays of 64-bit hashes, without a Python object for each word.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the batch
(a difference of two sums, divided by the power at the word's start), then mixed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """base**0 .. base**(n - 1) modulo 2**64, kept while no longer row is asked for; not sent to executors."""

    def __init__(self) -> None:
        self.kept: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"kept": {}}

    def __call__(self, base: int, n: int) -> np.ndarray:
        if len(self.kept.get(base, ())) < n:
            full = np.full(max(n, 1 << 16), base, U64)
            full[0] = 1
            self.kept[base] = np.multiply.accumulate(full)
        return self.kept[base][:n]


powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: A random-looking 64-bit number for each byte.
CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))


def _lut(keep) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if keep(b):
            out[b] = b + 32 if 65 <= b <= 90 else b
    return out


#: Lower-cased bytes, 0 between words: words of anything but ASCII white space; words of ASCII letters, digits and all non-ASCII.
SPACED = _lut(lambda b: b != 32 and not 9 <= b <= 13)
PLAIN = _lut(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


#: The bytes between words of SPACED.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    doc: np.ndarray  # its text's place in the batch
    first: np.ndarray  # n + 1: the first word of each text
    start: np.ndarray  # its first byte


#: Bytes that one pass over bytes takes at once, in some 50 times the room; longer input is cut between words.
PASS_BYTES = 1 << 18


def _cuts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray):
    """Ranges of some PASS_BYTES that no word lies across: they end at a byte of no word or at a text's end."""
    at, n = 0, len(data)
    while at < n:
        end = at + PASS_BYTES
        if end < n:
            text_end = int(offsets[np.searchsorted(offsets, end)])
            while end < text_end:
                found = np.flatnonzero(gap[data[end : min(end + 4096, text_end)]])
                if len(found):
                    end += int(found[0])
                    break
                end = min(end + 4096, text_end)
        yield at, min(end, n)
        at = end


def _pass(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, gap: np.ndarray):
    b = lut[data]
    inside = ~gap[data]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.empty(len(b) + 1, U64)
    sums[0] = 0
    np.cumsum(CODES[b] * powers(_BASE, len(b)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_INVERSE, len(b))[start]
    return mix(h + (end - start).astype(U64)), start, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = SPACED) -> Words:
    n_docs = len(offsets) - 1
    # NUL bytes are part of words of SPACED, but 0 marks the space between words
    gap = SPACE if lut is SPACED else lut == 0
    hashes, starts, first = [np.zeros(0, U64)], [np.zeros(0, np.int64)], np.zeros(n_docs + 1, np.int64)
    for at, end in _cuts(data, offsets, gap):
        h, start, part = _pass(data[at:end], np.clip(offsets, at, end) - at, lut, gap)
        hashes.append(h)
        starts.append(start + at)
        first += part
    return Words(np.concatenate(hashes), np.repeat(np.arange(n_docs), np.diff(first)), first, np.concatenate(starts))


def runs(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each k words in a row: (hashes, text, place of the first word). Texts of fewer words have none."""
    n = len(h) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[j : j + n]
    length = np.diff(first)
    doc = np.repeat(np.arange(len(length)), length)[:n]
    ok = np.arange(n) + k <= first[doc + 1]
    at = np.flatnonzero(ok)
    return mix(out[at]), doc[at], at


def word_hash(text: str, lut: np.ndarray = SPACED) -> np.ndarray:
    """Hashes of the words of one text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words(data, np.array([0, len(data)]), lut).hashes


class Members:
    """A set of 64-bit hashes, each with its place in the given order; most absent ones are dropped by a bit table."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.bits = max(10, int(len(hashes)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(hashes >> U64(64 - self.bits)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.sorted):
            at = np.flatnonzero(self.table[(h >> U64(64 - self.bits)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
            hit = self.sorted[found] == h[at]
            out[at[hit]] = self.order[found[hit]]
        return out
