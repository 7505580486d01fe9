"""Suffix arrays by linear grouping (after U. Baier, 2016): suffixes are grouped by their Lyndon prefixes, groups are taken
in descending order, and the order within groups follows from the groups alone, without renaming and recursion.

A suffix's Lyndon prefix ends where the next smaller suffix begins. It is the suffix's first symbol and the Lyndon
prefixes of the suffixes that it is the previous smaller one of, in the text's order. So, when a group is taken, all that
can lengthen the prefixes of its members has been taken before; each member lengthens its previous smaller suffix's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _grouped(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """For each suffix its group (the place where it starts in the order of groups), for each group its prefix's length, and each suffix's previous smaller one (-1: none)."""
    n = len(text)
    symbols = np.asarray(text)
    by_symbol = np.argsort(symbols, kind="stable")
    sorted_ = symbols[by_symbol]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    starts = np.repeat(first, np.diff(np.append(first, n)))
    group, place, order = np.empty(n, np.int64), np.empty(n, np.int64), by_symbol.tolist()
    group[by_symbol], place[by_symbol] = starts, np.arange(n)
    group, place = group.tolist(), place.tolist()
    end, length, before = [0] * n, [1] * n, [-1] * n
    for s, e in zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True):
        end[s] = e
    top = n
    while top:
        here = group[order[top - 1]]
        members = order[here:top] if top - here < 2 else sorted(order[here:top])
        longer = length[here]
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= here:  # taken already, or a member: what lies between it and its previous smaller one is no smaller
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, c in times.items():
            by_times.setdefault(c, []).append(j)
        for c in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for j in by_times[c]:  # to the upper end of its group
                g = group[j]
                e = end[g] - 1
                other, at = order[e], place[j]
                order[at], place[other] = other, at
                order[e], place[j] = j, e
                end[g] = e
                moved[g] = moved.get(g, 0) + 1
            for g, m in moved.items():
                new = end[g]
                length[new] = length[g] + c * longer
                end[new] = new + m
                if new != g:
                    for j in order[new : new + m]:
                        group[j] = new
        top = here
    return group, length, before


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes in order. The last symbol must be smaller than all others."""
    n = len(text)
    if not n:
        return []
    group, length, before = _grouped(text)
    free = list(range(n))  # of each group the next place
    out = [n - 1] * n
    for at in range(n):
        x = out[at]
        j = x - 1
        while j >= 0 and j + length[group[j]] == x:  # x follows j's prefix, and of j's group all with a smaller rest are placed
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
    return out


def common_prefixes(text: Sequence[int], order: list[int]) -> np.ndarray:
    """Of each suffix in order, how many symbols it shares with the one before."""
    n = len(text)
    rank = [0] * n
    for at, i in enumerate(order):
        rank[i] = at
    out, k = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if not r:
            k = 0
            continue
        j = order[r - 1]
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return np.array(out, np.int64)


def classes(text: Sequence[int], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the strings text[start : start + size]: equal for equal strings of one size."""
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out = np.zeros(len(start), np.int64)
    by = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(size[by]) != 0)) if len(by) else np.zeros(0, np.int64)
    for i, j in zip(edges, np.append(edges[1:], len(by)), strict=True):
        some = by[i:j]
        out[some] = np.cumsum(shared < size[some[0]])[rank[start[some]]]
    return out
