"""Quotas of strata: small plans made on the driver, in whole numbers, before any rows exist."""

from __future__ import annotations

from math import ceil, comb

from tallyforge.functions.digits import BANDS

DIGITS = (1, 9)


def strata(most: int = 18) -> list[tuple[int, int]]:
    """(digits, non-zero digits) of pairs that can be."""
    return [(d, n) for d in range(2, most + 1) for n in range(2, d + 1)]


def splits(total: int, nonzero: int, digits: tuple[int, int] = DIGITS) -> list[tuple[int, int, int, int]]:
    """(digits of a, non-zero ones of a, digits of b, non-zero ones of b) of a stratum, a not after b."""
    lo, hi = digits
    return [(da, na, db, nb) for da in range(lo, hi + 1) if lo <= (db := total - da) <= hi for na in range(1, da + 1) if 1 <= (nb := nonzero - na) <= db and (da, na) <= (db, nb)]


def numbers(length: int, nonzero: int) -> int:
    """How many numbers of a length have so many non-zero digits; the first is one of them."""
    return comb(length - 1, nonzero - 1) * 9**nonzero


def capacity(total: int, nonzero: int, digits: tuple[int, int] = DIGITS) -> int:
    """How many pairs, in either order, a stratum has."""
    out = 0
    for da, na, db, nb in splits(total, nonzero, digits):
        x, y = numbers(da, na), numbers(db, nb)
        out += x * (x + 1) // 2 if (da, na) == (db, nb) else x * y
    return out


def reachable(band: tuple[int, int] = (10, 324)) -> dict[int, list[tuple[int, int]]]:
    """Complexities in a band and their strata."""
    out: dict[int, list[tuple[int, int]]] = {}
    for d, n in strata():
        if band[0] <= d * n <= band[1] and capacity(d, n):
            out.setdefault(d * n, []).append((d, n))
    return dict(sorted(out.items()))


def even(caps: dict, total: int) -> dict:
    """As even as the capacities allow; what is left over goes to the first keys."""
    if total > sum(caps.values()):
        raise ValueError("the capacities don't hold so many")
    out, left, open_ = dict.fromkeys(caps, 0), total, list(caps)
    while left:
        share, rest = divmod(left, len(open_))
        for i, k in enumerate(open_):
            give = min(share + (i < rest), caps[k] - out[k])
            out[k] += give
            left -= give
        open_ = [k for k in open_ if out[k] < caps[k]]
    return out


def weighted(caps: dict, total: int, weights: dict, least: int = 0) -> dict:
    """In proportion to weights by largest remainders, within capacities, each key `least` first."""
    if total > sum(caps.values()):
        raise ValueError("the capacities don't hold so many")
    out = {k: min(least, c) for k, c in caps.items()}
    left = total - sum(out.values())
    if left < 0:
        raise ValueError("the least share of all keys is too much")
    while left:
        open_ = [k for k in caps if out[k] < caps[k]]
        scale = sum(weights[k] for k in open_)
        ideal = {k: left * weights[k] / scale if scale > 0 else left / len(open_) for k in open_}
        given = {k: min(int(ideal[k]), caps[k] - out[k]) for k in open_}
        over = left - sum(given.values())
        for k in sorted(open_, key=lambda k: (int(ideal[k]) - ideal[k], k)):
            if over and out[k] + given[k] < caps[k]:
                given[k] += 1
                over -= 1
        for k, n in given.items():
            out[k] += n
        left = over
    return out


def by_complexity(count: int, caps: dict[int, int], mean: float, least: int = 1, band_share: float = 0.1) -> dict[int, int]:
    """A quota of each complexity: every one is there, every band has its share, and the mean is as near to `mean` as weights c**e come."""
    if count < least * len(caps):
        raise ValueError("too few rows for all complexities")

    def at(exponent: float) -> dict[int, int]:
        w = {c: float(c) ** exponent for c in caps}
        out = {c: min(least, caps[c]) for c in caps}
        for lo, hi in BANDS:
            keys = [c for c in caps if lo <= c <= hi]
            want = max(ceil(count * band_share), len(keys) * least) if keys else 0
            need = want - sum(out[c] for c in keys)
            if need > 0:
                for c, n in weighted({c: caps[c] - out[c] for c in keys}, need, w).items():
                    out[c] += n
        rest = count - sum(out.values())
        if rest < 0:
            raise ValueError("the bands' shares are more than the count")
        for c, n in weighted({c: caps[c] - out[c] for c in caps}, rest, w).items():
            out[c] += n
        return out

    def centre(q: dict[int, int]) -> float:
        return sum(c * n for c, n in q.items()) / sum(q.values())

    lo, hi = -1.0, 8.0
    best = min((at(lo), at(hi)), key=lambda q: abs(centre(q) - mean))
    if not centre(at(lo)) < mean < centre(at(hi)):
        return best
    for _ in range(32):
        mid = (lo + hi) / 2
        q = at(mid)
        best = min(best, q, key=lambda x: abs(centre(x) - mean))
        lo, hi = (mid, hi) if centre(q) < mean else (lo, mid)
    return best


def digit_mix(text: str) -> dict[int, float]:
    """'2:0.1,3=0.9' to shares that add up to 1."""
    parts = [p.replace("=", ":").split(":") for p in text.split(",") if p.strip()]
    out = {int(k): float(v) for k, v in parts}
    total = sum(out.values())
    if total <= 0:
        raise ValueError("the shares add up to nothing")
    return {k: v / total for k, v in out.items()}


def length_quotas(available: dict[int, int], total: int, mix: dict[int, float]) -> dict[int, int]:
    """Rows of each digit length by the mix, halves to even, corrected by the largest fractions; what a length lacks others fill."""
    ideal = {k: total * v for k, v in mix.items()}
    out = {k: min(round(v), available.get(k, 0)) for k, v in ideal.items()}
    order = sorted(ideal, key=lambda k: (-(ideal[k] - int(ideal[k])), k))
    while (gap := total - sum(out.values())) != 0:
        moved = False
        for k in order if gap > 0 else order[::-1]:
            if gap > 0 and out[k] < available.get(k, 0):
                out[k] += 1
            elif gap < 0 and out[k] > 0:
                out[k] -= 1
            else:
                continue
            moved = True
            gap += -1 if gap > 0 else 1
            if gap == 0:
                break
        if not moved:
            break
    return out
