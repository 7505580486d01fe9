"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM blocks decoded across blocks, resampled to linear PCM.

A stored form is a WAVE file whose data chunk holds one byte a sample (mu-law, A-law) or IMA ADPCM blocks.
Decoding of ADPCM runs step by step through the block, for all blocks of a batch's files at once: state arrays have one
entry a block. Resampled PCM is stored as WAVE too (16-bit linear) and its features are of what is read back.

Edge cases: a null or empty payload is padded to one unit; repeated rows give equal values; an unknown or
damaged file raises ValueError, as silence would hide the loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.shared import by_step, small_batches

LINEAR, MULAW, ALAW, ADPCM = 1, 7, 6, 17
#: The forms in which a payload of whole units can be stored, and their bytes a block; any unit is an ADPCM block.
FORMS = {"mulaw": (MULAW, 1), "alaw": (ALAW, 1), "adpcm": (ADPCM, 192)}
UNIT = 192
RATE = 8000


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    value = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


# Fixed values of the IMA ADPCM format: 89 step sizes, and what each 3-bit magnitude adds to the step's index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


#: What each code adds at each index of the step, and the index that follows: 89 x 16 entries, by the format's rule.
_CODE = np.arange(16)
_SIZE = STEPS[:, None]
_CHANGE = (_SIZE >> 3) + np.where(_CODE & 4, _SIZE, 0) + np.where(_CODE & 2, _SIZE >> 1, 0) + np.where(_CODE & 1, _SIZE >> 2, 0)
CHANGE = np.where(_CODE & 8, -_CHANGE, _CHANGE).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_CODE & 7], 0, 88) << 4).astype(np.int32).ravel()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) of mono IMA ADPCM, each with a 4-byte head, to (n, samples): one step of the loop decodes a nibble of every block."""
    now = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) << 4
    body = np.ascontiguousarray(blocks[:, 4:].T)
    nibbles = (body & 15, body >> 4)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = now
    for t in range(2 * len(body)):
        index += nibbles[t & 1][t >> 1]
        now += CHANGE[index]
        np.clip(now, -32768, 32767, out=now)
        index = NEXT[index]
        out[t + 1] = now
    return np.ascontiguousarray(out.T)


def adpcm_encode(pcm: np.ndarray, block: int = 256) -> np.ndarray:
    """Blocks of 1 + 2 * (block - 4) samples of (n, samples) rows; the counterpart of adpcm_decode, used for storing and tests."""
    now = pcm[:, 0].astype(np.int64)
    index = np.zeros(len(pcm), np.int64)
    out = np.zeros((len(pcm), block), np.uint8)
    out[:, 0], out[:, 1] = now & 255, now >> 8 & 255
    for t in range(2 * (block - 4)):
        size = STEPS[index]
        miss = pcm[:, t + 1].astype(np.int64) - now
        code = np.minimum(7, (np.abs(miss) << 2) // size)
        change = (size >> 3) + np.where(code & 4, size, 0) + np.where(code & 2, size >> 1, 0) + np.where(code & 1, size >> 2, 0)
        now = np.clip(now + np.where(miss < 0, -change, change), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[:, 4 + (t >> 1)] |= ((code | np.where(miss < 0, 8, 0)) << (4 * (t & 1))).astype(np.uint8)
    return out


def wave(payload: bytes, kind: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A WAVE file of the payload as it is."""
    bits = {ADPCM: 4, LINEAR: 16}.get(kind, 8)
    per = 1 + 2 * (block - 4) if kind == ADPCM else 1  # samples a block
    extra = {ADPCM: struct.pack("<HH", 2, per), LINEAR: b""}.get(kind, struct.pack("<H", 0))
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload) // block * per) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(stored: bytes) -> tuple[int, int, int, bytes]:
    """(kind, rate, block, payload) of a WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate, block = 12, 0, 0, 0
    while at + 8 <= len(stored):
        name, n = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if at + 8 + n > len(stored):
            raise ValueError("the file is cut off")
        if name == b"fmt ":
            kind, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif name == b"data":
            return kind, rate, block, stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def pcm(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(rate, 16-bit samples) of stored files; ADPCM blocks of one size are decoded together."""
    out: list = [None] * len(files)
    together: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, stored in enumerate(files):
        kind, rate, block, payload = unwave(stored)
        raw = np.frombuffer(payload, np.uint8)
        if kind == LINEAR and block == 2:
            out[i] = rate, raw.view("<i2")
        elif kind in TABLES:
            out[i] = rate, TABLES[kind][raw]
        elif kind == ADPCM and block > 4:
            if len(raw) % block:
                raise ValueError("the last block is cut off")
            out[i] = rate, None
            together.setdefault(block, []).append((i, raw.reshape(-1, block)))
        else:
            raise ValueError(f"format {kind} isn't one of telephony")
    for blocks in together.values():
        samples = adpcm_decode(np.concatenate([b for _, b in blocks]))
        at = 0
        for i, b in blocks:
            out[i] = out[i][0], samples[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def _half_band(taps: int = 6) -> np.ndarray:
    """Windowed-sinc weights, in 1/4096, of the samples around a midpoint."""
    k = np.arange(-taps + 0.5, taps)
    w = np.sinc(k) * (0.5 + 0.5 * np.cos(np.pi * k / taps))
    return np.round(w / w.sum() * 4096).astype(np.int64)


HALF = _half_band()


def double_rate(x: np.ndarray) -> np.ndarray:
    """Twice the samples: old ones stay, a symmetric filter in whole numbers makes those between. Edges repeat the end samples."""
    m = len(HALF) // 2
    wide = np.pad(x.astype(np.int32), (m - 1, m), mode="edge")
    mid = np.full(len(x), 2048, np.int32)  # 32768 times the weights' absolute sum is below 2**31
    for i in range(m):  # the filter is symmetric
        mid += (wide[i : i + len(x)] + wide[2 * m - 1 - i : 2 * m - 1 - i + len(x)]) * np.int32(HALF[i])
    mid >>= 12
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip(mid, -32768, 32767, out=mid)
    return out


def feature(x: np.ndarray) -> str:
    """Length, peak, sum of squares, sign changes and checksum of PCM: whole numbers, the same on every machine."""
    v = x.astype(np.int64)
    return f"n={len(x)};peak={int(np.abs(v).max(initial=0))};power={int((v * v).sum())};zc={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};crc={zlib.crc32(x.astype('<i2').tobytes()):08x}"


def resampled(files: list[bytes]) -> list[bytes]:
    """Stored files to files of linear PCM at twice the rate."""
    return [wave(double_rate(x).astype("<i2").tobytes(), LINEAR, 2 * rate, 2) for rate, x in pcm(files)]


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(docs: DataFrame, key: str = "doc_id", form: str = "mulaw") -> DataFrame:
    """One row per document: key, n_bytes, stored (binary, a WAVE file of the padded text)."""
    small_batches(docs.sparkSession)
    kind, block = FORMS[form]

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        files = [wave(padded(data[a:b].tobytes()), kind, block=block) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], [key, "n_bytes", "stored"])

    picked = docs.select(key, "text")
    return picked.mapInArrow(by_step(of), f"`{key}` {picked.schema[key].dataType.simpleString()}, n_bytes bigint, stored binary")


def to_pcm(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stored files to PCM of twice the rate: keep, rate, pcm (binary, a WAVE file of 16-bit samples); null for null."""
    small_batches(media.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                files = rows.column(rows.num_columns - 1).to_pylist()
                made = iter(resampled([f for f in files if f is not None]))
                got = [None if f is None else next(made) for f in files]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([g and unwave(g)[1] for g in got], pa.int32()), pa.array(got, pa.binary())], [*rows.schema.names[:-1], "rate", "pcm"])

    picked = media.select(*keep, "stored")
    return picked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "rate int, pcm binary"]))


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """store, read back and to_pcm in one pass for each of FORMS, keeping only sums and features of what was stored: the payload's and the file's
    of the mu-law form, and in `feature`, for each form, those of its resampled PCM."""
    small_batches(docs.sparkSession)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        payloads = [padded(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        features: list[list[str]] = [[] for _ in payloads]
        media: list[bytes] = []
        for form, (kind, block) in FORMS.items():
            stored = [wave(p, kind, block=block) for p in payloads]
            media = media or stored
            for i, (rate, x) in enumerate(pcm(resampled(stored))):
                features[i].append(f"{form}:rate={rate};{feature(x)}")
        read = [unwave(m)[3] for m in media]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        cols = [pa.array(np.diff(offsets)), pa.array(list(map(len, read)), pa.int64()), pa.array(list(map(sha, read)), pa.string()), pa.array([zlib.crc32(p[-16:]) for p in read], pa.int64())]
        cols += [pa.array(list(map(len, media)), pa.int64()), pa.array(list(map(sha, media)), pa.string()), pa.array(list(map("|".join, features)), pa.string())]
        yield pa.RecordBatch.from_arrays([rows.column(0), *cols], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    picked = docs.select(key, "text")
    return picked.mapInArrow(by_step(of, most=1 << 18), f"`{key}` {picked.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
