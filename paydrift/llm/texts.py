"""Words and n-grams of whole Arrow text columns as numpy arrays; work tables in the shared folder.

A word is a run of bytes other than 0x20 and 0x09-0x0D, as the contracts of the word operators say.
All hashes are 64 bits wide and depend on bytes only, so every task and executor agrees on them.
Texts are handled in blocks of a few megabytes, so memory follows the block and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

BLOCK_BYTES = 2 << 20
GOLDEN = 0x9E3779B97F4A7C15
GRAM_STEP = np.uint64(0xD6E8FEB86659FD93)
BYTE_STEP = 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (shift-xor-multiply rounds)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


with np.errstate(over="ignore"):
    BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, step: int = BYTE_STEP) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SHORT = powers(256)


@dataclass
class Words:
    """Words of a block of texts: byte ranges in ``buf``, hashes, and ``bounds[d]:bounds[d+1]`` of text d."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text each (one row at least), with their bytes and offsets."""
    buf, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, lower: bool = False, member: np.ndarray = WORD_BYTE) -> Words:
    """Runs of ``member`` bytes of every text, hashed; ``lower`` folds A-Z only."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    w = member[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edges = off[(off > 0) & (off < n)]
    first[edges] = w[edges]
    starts = np.flatnonzero(first)
    last = w
    last[:-1] &= ~w[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return Words(buf, starts, ends, bounds, np.zeros(0, np.uint64))
    lengths = ends - starts
    span = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    longest = int(lengths.max())
    steps = _SHORT if longest <= len(_SHORT) else powers(longest)
    np.minimum(place, len(steps) - 1, out=place)
    codes = np.where(member, BYTE_CODES[LOWER] if lower else BYTE_CODES, np.uint64(0))[buf[starts[0]:]]
    codes *= steps[place]
    h = np.add.reduceat(codes, starts - starts[0])
    return Words(buf, starts, ends, bounds, mix(h + lengths.astype(np.uint64) * np.uint64(GOLDEN)))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one text."""
    h = w.hashes
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= GRAM_STEP
        acc += h[j:j + m]
    doc = w.doc_of()
    return mix(acc), doc[:m] == doc[n - 1:]


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (doubling steps)."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the cluster's shared folder and read it back: cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
