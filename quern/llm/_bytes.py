"""Whole Arrow batches of text as one byte array: splitting, hashing and grouping without a loop over words.

Every helper works on the concatenated UTF-8 bytes of a batch plus the offsets of its rows, so a
word, a shingle or a segment costs a few vectorised operations instead of a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds at most ``most`` text bytes, or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if n == 0:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum([len(x) if x else 0 for x in binary(text).to_pylist()]) if n > 1 else np.zeros(1)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def binary(text: pa.Array) -> pa.Array:
    """A text column as bytes; nulls stay null."""
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        return text.cast(pa.large_binary())
    return text.cast(pa.binary())


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as bytes, null as empty."""
    return [x or b"" for x in binary(batch.column(batch.schema.get_field_index(column))).to_pylist()]


def joined(parts: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The parts end to end (each followed by ``gap``) and the n + 1 offsets of their starts."""
    lengths = np.fromiter((len(x) for x in parts), np.int64, len(parts)) + len(gap)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    data = gap.join(parts) + gap if parts else b""
    return np.frombuffer(data, np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64), in place on a copy."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _random_table(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed)) * _ODD)


_BYTE = _random_table(256, 1 << 20)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_grown: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for reuse up to a few MB."""
    if (have := _grown.get(base)) is None or len(have) < n:
        have = _powers(base, max(n, 1 << 16))
        if len(have) <= 1 << 22:
            _grown[base] = have
    return have[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_P, n), out=self.sums[1:])
        self.back = powers(_P_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def class_table(members: bytes) -> np.ndarray:
    """A boolean table over byte values."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that ``inside`` marks; rows must be kept apart by a gap byte outside."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def schema(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The kept columns of ``df`` and then those of a DDL string."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(more).fields])
