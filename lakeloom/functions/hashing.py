"""xxHash of value lists, equal bit for bit to the published algorithm with seed 0.

Spark's own xxhash64 starts from another seed and mixes types differently, so these run on Arrow
batches in Python: rows' bytes are put together by numpy, the library hashes them. Use Spark's where
only equality matters.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_bytes(v: object) -> bytes:
    """What a value adds to the hash: null and booleans one byte, integers and doubles eight."""
    if v is None or v is pd.NaT:
        return b"\0"
    if isinstance(v, bool):
        return b"\1" if v else b"\0"
    if isinstance(v, int):
        return struct.pack("<q", v)
    if isinstance(v, float):
        return struct.pack("<d", v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, Decimal):
        sign, digits, exponent = v.as_tuple()
        number = int("".join(map(str, digits)) or "0")
        return struct.pack("<IIII", (max(0, -exponent) << 16) | (sign << 31), number >> 64 & 0xFFFFFFFF, number & 0xFFFFFFFF, number >> 32 & 0xFFFFFFFF)
    if isinstance(v, str):
        return v.encode()
    if isinstance(v, dict):
        return b"".join(value_bytes(k) + value_bytes(x) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return b"".join(map(value_bytes, v))
    raise TypeError(f"can't hash {type(v).__name__}")


#: 100 ns ticks from 0001-01-01 to 1970-01-01.
TICKS_TO_EPOCH = 621_355_968_000_000_000


def _plain(v):
    if isinstance(v, datetime.datetime):
        return int(pd.Timestamp(v).value // 100) + TICKS_TO_EPOCH
    if isinstance(v, dict):  # a struct: its values
        return [_plain(x) for x in v.values()]
    if isinstance(v, (list, tuple)):  # also the pairs of a map
        return [_plain(x) for x in v]
    return v


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length per row) of what a column adds to the hash.

    Integers, doubles, booleans, text and binary are taken from the column's buffers; other types
    value by value.
    """
    kind, n = column.type, len(column)
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(kind) or pa.types.is_float64(kind):
        wide = "<f8" if pa.types.is_float64(kind) else "<i8"
        raw = column.fill_null(0).to_numpy(zero_copy_only=False).astype(wide).view(np.uint8).reshape(n, 8)
        lengths = np.where(null, 1, 8)
        raw[null] = 0
        return raw[np.arange(8) < lengths[:, None]], lengths
    if pa.types.is_boolean(kind):
        return column.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8), np.ones(n, np.int64)
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)):
        column = pa.array([value_bytes(_plain(v)) for v in column.to_pylist()], pa.large_binary())
        null = np.zeros(n, bool)
    one = column.cast(pa.large_binary())
    if null.any():
        one = pc.fill_null(one, b"\0")
    _, offsets, data = one.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, one.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, np.diff(at)


def _joined(columns: tuple[pa.Array, ...]) -> tuple[bytes, list[int]]:
    """(all rows' bytes, where each row starts and the last ends)."""
    parts = [_buffers(c) for c in columns]
    lengths = np.stack([n for _, n in parts], 1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1, -1]) if ends.size else 0, np.uint8)
    for i, (raw, n) in enumerate(parts):
        begin = ends[:, i] - n
        own = np.cumsum(n) - n
        out[np.repeat(begin - own, n) + np.arange(len(raw))] = raw
    return out.tobytes(), [0, *ends[:, -1].tolist()]


@F.arrow_udf(T.LongType())
def _xxhash64(*columns: pa.Array) -> pa.Array:
    import xxhash

    data, at = _joined(columns)
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    return pa.array(np.array([digest(view[s:e]) for s, e in zip(at, at[1:])], np.uint64).view(np.int64))


@F.arrow_udf(T.StringType())
def _xxhash128(*columns: pa.Array) -> pa.Array:
    import xxhash

    data, at = _joined(columns)
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return pa.array([str(uuid.UUID(bytes_le=digest(view[s:e]))) for s, e in zip(at, at[1:])], pa.string())


def xxhash64(*values: Column) -> Column:
    return _xxhash64(*values)


def xxhash128_guid(*values: Column) -> Column:
    """The 128-bit hash as an identifier."""
    return _xxhash128(*values)
