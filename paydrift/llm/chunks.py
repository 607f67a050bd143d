"""Chunks of documents and counts of keys over all of them.

Documents are dealt by a hash of their id into chunks of a few megabytes, whose number follows the data. A chunk
sends its distinct keys, cut by their high bits into one packed array per bucket; a bucket counts them over all
chunks and answers each array with one byte per key. So a hot key is one entry per chunk, a key costs four bytes,
and the chunk, dealt out again by the same exchange, knows for each of its own keys how many documents have it.
Keys are compared by 32 bits and the bucket's bits: a collision raises a count, it never lowers one, and callers
use counts only to leave out what nothing else has.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, LEAST_CHUNKS = 4 << 20, 64
KEYS = "bucket int, chunk int, keys binary, counts binary"
CODES = "chunk int, bucket int, codes binary"


def chunk_count(docs: DataFrame, text: str = "text") -> int:
    """A power of two near the text's bytes over ``CHUNK_BYTES``; one cheap aggregation over all rows."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return 1 << max(LEAST_CHUNKS - 1, -(-total // CHUNK_BYTES) - 1).bit_length()


def in_chunks(docs: DataFrame, n: int) -> DataFrame:
    """chunk, doc_id, text of the rows that have an id."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text")


def pieces(keys: np.ndarray, n: int) -> np.ndarray:
    """Borders of the buckets in sorted keys."""
    bits = n.bit_length() - 1
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange(n + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])


def count_code(counts: np.ndarray) -> np.ndarray:
    """0 for one document, then rising with the logarithm of the count."""
    return np.where(counts <= 1, 0, 1 + np.floor(4 * np.log2(np.maximum(counts, 2)))).astype(np.uint8)


def code_count(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 1, np.ceil(2.0 ** ((codes.astype(float) - 1) / 4)))


def key_counts(chunked: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], n: int) -> DataFrame:
    """For each chunk and bucket the count codes of the chunk's keys, in their order.

    ``keys_of`` gives a chunk's distinct keys, sorted, and in how many of its documents each occurs.
    """
    shift = np.uint64(32 - (n.bit_length() - 1))

    def send(table: pa.Table) -> pa.Table:
        keys, counts = keys_of(table)
        at, small = pieces(keys, n), (keys >> shift).astype(np.uint32)
        codes = count_code(counts)
        full = np.flatnonzero(np.diff(at))
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), table["chunk"][0].as_py()), pa.int32()),
            "keys": pa.array([small[at[b]:at[b + 1]].tobytes() for b in full], pa.binary()),
            "counts": pa.array([zlib.compress(codes[at[b]:at[b + 1]].tobytes(), 1) for b in full], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        seen = [code_count(np.frombuffer(zlib.decompress(x), np.uint8)) for x in table["counts"].to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        total = np.add.reduceat(np.concatenate(seen)[order], first)
        codes = np.empty(len(every), np.uint8)
        codes[order] = np.repeat(count_code(total), np.diff(np.append(first, len(every))))
        at = np.append(0, np.cumsum([len(k) for k in keys]))
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "codes": pa.array([zlib.compress(codes[at[i]:at[i + 1]].tobytes(), 1) for i in range(len(keys))], pa.binary())})

    return chunked.groupBy("chunk").applyInArrow(send, KEYS).groupBy("bucket").applyInArrow(count, CODES)


def joined_codes(answers: pa.Table, total: int) -> np.ndarray:
    """The codes of a chunk's sorted keys from its buckets' answers."""
    parts = sorted(zip(answers["bucket"].to_pylist(), answers["codes"].to_pylist()))
    codes = np.frombuffer(b"".join([zlib.decompress(c) for _, c in parts]), np.uint8)
    if len(codes) != total:
        raise ValueError(f"{len(codes)} answers for {total} keys")
    return codes


def with_codes(chunked: DataFrame, codes: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each chunk's documents together with the answers to its keys."""
    return chunked.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(fn, schema)
