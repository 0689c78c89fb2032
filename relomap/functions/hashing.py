"""Hashes and move ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash: offset basis and prime.
_BASIS, _PRIME = 14695981039346656037, 1099511628211
# Fixed values of the move-id mixer: seed, two multipliers with the shifts 30, 27 and 31, and the bits that are shown.
_SEED, _MULTIPLY_1, _MULTIPLY_2, _SHOWN = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 36) - 1


def _fnv1a64(texts: list[bytes]) -> np.ndarray:
    """Hashes of all texts, byte by byte: all texts at once while many go on, then those that are left one by one."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8).astype(np.uint64)
    begin = np.cumsum(lengths) - lengths
    state = np.full(len(texts), _BASIS, dtype=np.uint64)
    at, live = 0, int((lengths > 0).sum())
    while live >= 40:
        state[:live] = (state[:live] ^ flat[begin[:live] + at]) * np.uint64(_PRIME)
        at += 1
        live = int(np.searchsorted(-lengths, -at, side="left"))
    for k in range(live):
        h = int(state[k])
        for byte in texts[order[k]][at:]:
            h = (h ^ byte) * _PRIME & 0xFFFFFFFFFFFFFFFF
        state[k] = h
    out = np.empty(len(texts), dtype=np.uint64)
    out[order] = state
    return out


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as DECIMAL(20, 0); null for null. For display and comparison with stored hashes, not for keys."""

    @F.arrow_udf("string")  # type: ignore[call-overload]
    def hashed(texts: pa.Array) -> pa.Array:
        known = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
        values = iter(_fnv1a64([t for t in known if t is not None]).tolist())
        return pa.array([None if t is None else str(next(values)) for t in known], type=pa.string())

    return hashed(text.cast("string")).cast("decimal(20,0)")


def combine(seed: Column, value: Column) -> Column:
    return F.xxhash64(seed, value)


def move_id(ordinal: Column) -> Column:
    """Nine hexadecimal digits for the n-th move, from 0: the low 36 bits of a mixed counter; null for null."""

    @F.arrow_udf("string")  # type: ignore[call-overload]
    def mixed(numbers: pa.Array) -> pa.Array:
        known = numbers.is_valid().to_numpy(zero_copy_only=False)
        x = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(_SEED)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MULTIPLY_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MULTIPLY_2)
        x = x ^ (x >> np.uint64(31))
        return pa.array([f"{v:09x}" if k else None for v, k in zip((x & np.uint64(_SHOWN)).tolist(), known, strict=True)], type=pa.string())

    return mixed(ordinal)
