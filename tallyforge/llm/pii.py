"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Runs on UTF-8 bytes: every pattern is ASCII, and offsets become code points by counting lead bytes.
A text without any '@' or digit takes no pattern at all.

Edge cases: a null text is empty and has no spans; extra columns pass through `find` untouched only if
listed in `keep`; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.shared import by_step, small_batches

#: Fixed values of the contract: kinds in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: The regular expressions of the contract on bytes. Possessive, and not started within a run that has failed: the same matches in linear time.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACK = re.compile(rb"[A-Za-z0-9._%+-]*+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country; that length is tried first.
_IBAN_LENGTHS = {
    c: n for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items() for c in cs.encode().split()
}
#: Words that, near a proposal, make it likelier or less likely.
CONTEXT = {
    "email": (b"mail", b"contact", b"write"), "ip": (b"address", b"server", b"host"), "card": (b"card", b"visa", b"payment", b"credit"),
    "phone": (b"phone", b"call", b"tel", b"mobile"), "iban": (b"iban", b"account", b"bank"), "ssn": (b"ssn", b"social", b"security"),
}
AGAINST = (b"version", b"order", b"invoice", b"example", b"serial")
#: The score of a confirmed proposal without context; what a word near it adds or takes; bytes that count as near; what extra kinds need.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4}
STEP, NEAR, LEAST = 0.3, 48, 0.6


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: bytes) -> bool:
    s = iban.replace(b" ", b"").decode()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: bytes) -> list[tuple[int, int]]:
    """A match, or what of it ends at a blank, that the checksum confirms: of the country's length, or else the longest. Words after an IBAN may look like more of it."""
    out, m = [], _IBAN.search(text)
    while m:
        found = m[0]
        ends = [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] == 32)]
        sizes = {e: len(found[:e].replace(b" ", b"")) for e in ends}
        ends = sorted((e for e in ends if sizes[e] >= 15), key=lambda e: sizes[e] != _IBAN_LENGTHS.get(found[:2]))
        end = next((e for e in ends if mod97(found[:e])), 0)
        if end:
            out.append((m.start(), m.start() + end))
        m = _IBAN.search(text, m.start() + (end or 1))
    return out


def _digits(span: bytes) -> bytes:
    return bytes(c for c in span if 48 <= c <= 57)


def _emails(text: bytes) -> list[tuple[int, int]]:
    """Each '@' takes the run of local characters before it, back to the last match's end, and a domain after it."""
    out, end, at = [], 0, text.find(b"@")
    while at >= 0:
        head = text[end:at][::-1]
        start = at - _LOCAL_BACK.match(head).end()
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find(b"@", end)
        else:
            end = at + 1
            at = text.find(b"@", at + 1)
    return out


def score(kind: str, text: bytes, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : end + NEAR].lower()
    return min(1.0, max(0.0, PRIOR[kind] + STEP * any(w in near for w in CONTEXT[kind]) - STEP * any(w in near for w in AGAINST)))


def spans(text: bytes) -> dict[str, list[tuple[int, int, float]]]:
    """Confirmed spans of each kind in bytes, with scores. Base kinds stay whatever their score; others need LEAST."""
    found: dict[str, list[tuple[int, int]]] = {"email": _emails(text) if b"@" in text else []}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := q.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for q in m[0].split(b"."))]
    found["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found["iban"] = _ibans(text)
    found["ssn"] = [m.span() for m in _SSN.finditer(text)]
    scored = {k: [(s, e, score(k, text, s, e)) for s, e in v] for k, v in found.items()}
    return {k: [x for x in v if k in BASE or x[2] >= LEAST] for k, v in scored.items()}


def _rows(data: np.ndarray, offsets: np.ndarray) -> list[dict[str, list[tuple[int, int, float]]] | None]:
    """Spans in code points of each text; None where there can be none."""
    cheap = np.zeros(256, bool)
    cheap[[64, *range(48, 58)]] = True
    hits = np.concatenate([[0], np.cumsum(cheap[data])])
    out: list = [None] * (len(offsets) - 1)
    for i in np.flatnonzero(hits[offsets[1:]] > hits[offsets[:-1]]):
        raw = data[offsets[i] : offsets[i + 1]]
        found = spans(raw.tobytes())
        if any(found.values()):
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            out[i] = {k: [(int(points[s]), int(points[e]), p) for s, e, p in v] for k, v in found.items()}
    return out


def _joined(found: dict | None, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e, _ in found[k]) if found else ""


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep`, counts of the base kinds, the digest of base spans, all spans, and the lowest score of any."""
    small_batches(docs.sparkSession)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        found = _rows(data, offsets)
        cols = [rows.column(i) for i in range(rows.num_columns - 1)]
        cols += [pa.array([len(f[k]) if f else 0 for f in found], pa.int64()) for k in BASE]
        cols.append(pa.array([hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found]))
        cols.append(pa.array([_joined(f, KINDS) for f in found]))
        cols.append(pa.array([min((p for v in f.values() for *_, p in v), default=None) if f else None for f in found], pa.float64()))
        yield pa.RecordBatch.from_arrays(cols, [*rows.schema.names[:-1], *(f"n_{k}" for k in BASE), "base_sha256", "spans", "least_score"])

    picked = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), *(f"n_{k} bigint" for k in BASE), "base_sha256 string, spans string, least_score double"])
    return picked.mapInArrow(by_step(of), schema)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with each confirmed span replaced by its kind in brackets; overlapping spans become one, named by the first. n_chars, where there is one, is the new length."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        at = rows.schema.get_field_index("text")
        found, texts, changed = _rows(data, offsets), rows.column(at).to_pylist(), {}
        for i, f in enumerate(found):
            if f:
                parts, end, t = [], 0, texts[i]
                for s, e, k in sorted((s, e, k) for k, v in f.items() for s, e, _ in v):
                    if s >= end:
                        parts += [t[end:s], f"[{k.upper()}]"]
                    end = max(end, e)
                texts[i] = changed[i] = "".join([*parts, t[end:]])
        cols = list(rows.columns)
        if changed:
            cols[at] = pa.array(texts, rows.schema.field(at).type)
            if "n_chars" in names:
                c = rows.schema.get_field_index("n_chars")
                n = rows.column(c).to_pylist()
                for i, t in changed.items():
                    n[i] = len(t)
                cols[c] = pa.array(n, rows.schema.field(c).type)
        yield pa.RecordBatch.from_arrays(cols, schema=rows.schema)

    return docs.mapInArrow(by_step(of), docs.schema)
