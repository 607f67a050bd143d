"""Token-id output: best-fit-decreasing packing with a segment tree over free capacities.

Documents are encoded and packed where they are read, in blocks of at most ``BLOCK_TOKENS`` tokens (or one
longer document), so nothing is shuffled and memory is a block's. Documents longer than the context are split
into whole contexts and a rest. Pieces are placed by falling length, each into the open row with the least
free room that holds it; the segment tree over capacities finds that room in logarithmic time.

One row per packed context: ``ids`` and ``positions`` are ``context`` little-endian 32-bit integers, padded with
``pad_id`` and 0; ``cu_seqlens`` are cumulative segment lengths from 0, at whose entries positions restart;
``doc_ids`` and ``doc_starts`` name each segment's document and its first token there. ``pack_id`` numbers the
rows of a partition. Which documents share a row follows the partitions of the input; a lost task packs the same
rows again. Null and empty texts have no tokens and no segment; null doc_ids stay null; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PATTERN, read_model, replaced, tokenizer_path
from .texts import blocks, column_bytes, table

CONTEXT, BLOCK_TOKENS, PAD = 2048, 2_000_000, 0
SCHEMA = "pack_id long, n_tokens long, n_segments long, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


RANKS = "byte_bpe_50k.tiktoken"
_LOADED: dict[bytes, tiktoken.Encoding] = {}


def token_ids(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Adds ``ids`` of the whole text as ordinary text (no special tokens), from a file of tokens and ranks.

    Packing takes ids from any encoder; this one is the library's, since tokens are not what is dealt here.
    """
    model = read_model(path or tokenizer_path(RANKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, model.splitlines())}
            _LOADED[model] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = _LOADED[model]
        for batch in batches:
            for part, _, _ in blocks(batch, text):
                column = part.column(part.schema.get_field_index(text)).to_pylist()
                yield replaced(part, {"ids": pa.array([np.array(own.encode_ordinary(x or ""), "<u4").tobytes() for x in column], pa.binary())})

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != "ids"] + [T.StructField("ids", T.BinaryType())]))


class Capacities:
    """Open rows by free room; a segment tree tells the least room of at least a given size."""

    def __init__(self, largest: int):
        self.leaves = 1 << max(0, (largest + 1 - 1).bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of a row with the least room that is at least ``need``, removed; None if none is open."""
        at = need + self.leaves
        if need >= self.leaves:
            return None
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self.change(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], context: int) -> list[list[int]]:
    """Rows of piece numbers; equal lengths keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(context)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[piece]
        found = open_rows.take(need)
        if found:
            room, row = found
            rows[row].append(piece)
        else:
            room, row = context, len(rows)
            rows.append([piece])
        if room > need:
            open_rows.put(room - need, row)
    return rows


def pack_block(doc_ids: list, tokens: np.ndarray, off: np.ndarray, context: int, pad: int) -> Iterator[tuple]:
    """Packed rows of documents whose tokens are ``tokens[off[i]:off[i + 1]]``."""
    pieces = [(d, s, min(s + context, int(off[d + 1]))) for d in range(len(doc_ids)) for s in range(int(off[d]), int(off[d + 1]), context)]
    for row in best_fit([b - a for _, a, b in pieces], context):
        ids, positions = np.full(context, pad, "<u4"), np.zeros(context, "<u4")
        ends = [0]
        for p in row:
            _, a, b = pieces[p]
            ids[ends[-1]:ends[-1] + b - a] = tokens[a:b]
            positions[ends[-1]:ends[-1] + b - a] = np.arange(b - a)
            ends.append(ends[-1] + b - a)
        yield ends[-1], len(row), [doc_ids[pieces[p][0]] for p in row], [int(pieces[p][1] - off[pieces[p][0]]) for p in row], ends, ids.tobytes(), positions.tobytes()


def pack(coded: DataFrame, context: int = CONTEXT, pad_id: int = PAD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packs rows with ``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    def flush(held: list[tuple[list, np.ndarray, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        doc_ids = [d for ids, _, _ in held for d in ids]
        tokens = np.concatenate([t for _, t, _ in held])
        off = np.append(0, np.cumsum(np.concatenate([n for _, _, n in held])))
        rows = []
        for row in pack_block(doc_ids, tokens, off, context, pad_id):
            rows.append((first, *row))
            first += 1
            if len(rows) == 256:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["pack_id", "n_tokens", "n_segments", "doc_ids", "doc_starts", "cu_seqlens", "ids", "positions"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, held, size = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            i = 0
            while i < len(ids):
                room = max(1, block_tokens - size)
                j = int(np.searchsorted(off, off[i] + 4 * room, "right")) - 1
                if j <= i:
                    if held:
                        for out in flush(held, next_id):
                            next_id += out.num_rows
                            yield out
                        held, size = [], 0
                        continue
                    j = i + 1
                held.append((ids[i:j], np.frombuffer(raw[off[i]:off[j]].tobytes(), "<u4"), np.diff(off[i:j + 1]) // 4))
                size += int(off[j] - off[i]) // 4
                i = j
        if held:
            yield from flush(held, next_id)

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The id matrix, positions and segment boundaries as Parquet; a row of the matrix is one packed context."""
    packed.write.parquet(path)


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(token_ids(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return packed.select("pack_id", "n_tokens", "n_segments", "doc_ids", "doc_starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


QUERIES = {"op4_token_packing": op4_token_packing}
