"""Alignment of two tokenizers' tokens on the bytes of each text, with counts of linked ids over the whole corpus.

The ends of the A tokens and of the B tokens of a block of texts are two rising lists. Their merge is cut by diagonals at
equal steps; a binary search on each diagonal finds how many ends of each list lie before it, so all pieces are independent
and of equal work, whatever the lengths of the texts. A piece emits the ends that both of its lists have; where a diagonal
falls between two equal ends the boundary pieces are stitched. Common ends cut the tokens into groups.

A block is a chunk: it sends its distinct linked pairs of ids with their counts once, and a text refers to them by place. The
pairs of all chunks are summed, at most one row for a pair and chunk, so a hot pair is not a hot key. Their number is bounded
by the vocabularies, yet they are joined and not broadcast, at every size. The chunks get the counts of their pairs back.

Tokenizer A is a byte-level file of the library ``tokenizers``, applied to a space and the text; its ids come from ``tiktoken``,
fed with the file's own vocabulary, whose ids must rise with its merges. B is a sentencepiece model, applied to the text.
Special tokens are not added, and their strings inside a text are plain text. Model files are read by the driver from paths
that are parameters, and travel with the tasks.

Null and empty texts have no tokens, nor have texts whose tokens of A or B do not spell a space and the text. A text of
any length is one alignment in one task. Rows that repeat are counted each; rows with a null doc_id are documents as any
other and come back. Equal counts are all the highest. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, Decoder, read_model, tokenizer_path
from .texts import blocks, table, work_table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES, CALL_BYTES = 8 << 20, 256 << 10
#: Ends in one piece of the merge.
PIECE = 1 << 15
ROW = "doc_id long, n_a long, n_b long, n_groups long, groups string, chunk long, links binary, pairs binary, counts binary"
ROW_NAMES = [x.split(" ")[0] for x in ROW.split(", ")]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of the merge of two rising lists begin and end in each; of equal values a's comes first."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        lo, hi = np.where(before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return lo, d - lo


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both have, from independent pieces of their merge."""
    at_a, at_b = diagonals(a, b, piece)
    in_a, in_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, i_end, j, j_end in zip(at_a, at_a[1:], at_b, at_b[1:]):
        mine, other = a[i:i_end], b[j:j_end]
        place = np.searchsorted(other, mine)
        hit = np.flatnonzero(place < len(other))
        hit = hit[other[place[hit]] == mine[hit]]
        in_a.append(i + hit)
        in_b.append(j + place[hit])
        # the next piece begins with the other end of this piece's last one
        if i_end and j_end < len(b) and a[i_end - 1] == b[j_end]:
            in_a.append(np.array([i_end - 1]))
            in_b.append(np.array([j_end]))
    return np.concatenate(in_a), np.concatenate(in_b)


class Pair:
    """Both tokenizers of a worker, with the bytes of every id."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        own = Decoder(a)
        model = json.loads(a)["model"]
        formed = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        if any(x >= y for x, y in zip(formed, formed[1:])):
            raise ValueError("ids of this vocabulary do not rise with its merges")
        added = set(own.added.values())
        self.a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks={t: i for i, t in own.pieces.items() if i not in added}, special_tokens={})
        self.bytes_a = [own.pieces.get(i, b"") for i in range(max(own.pieces) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        # an id as it is written inside its group and at the end of its side
        self.written = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for end in ends]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of every text; none where they do not spell it."""
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        nothing = np.zeros(0, np.uint32)
        for some in _calls(texts):
            for text, b in zip(some, self.b.encode(some, num_threads=1)):
                raw = (" " + text).encode()
                ids = self.a.encode_ordinary(" " + text)
                if len(raw) > 1 and b"".join(map(spell_a, ids)) == raw and b"".join(map(spell_b, b)) == raw:
                    yield np.array(ids, np.uint32), np.array(b, np.uint32)
                else:
                    yield nothing, nothing


def _calls(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= CALL_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


_LOADED: dict[bytes, Pair] = {}


def loaded(a: bytes, b: bytes) -> Pair:
    """The worker's tokenizers, built once."""
    key = hashlib.sha256(a + b).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(a, b)
    return _LOADED[key]


class Block:
    """Tokens of a block of texts one after the other, and the groups that their common ends make."""

    def __init__(self, pair: Pair, texts: list[str], piece: int = PIECE):
        ids = list(pair.encode(texts))
        self.pair = pair
        self.a, self.b = (np.concatenate([np.zeros(0, np.uint32), *[x[k] for x in ids]]) for k in (0, 1))
        self.at_a, self.at_b = (np.append(0, np.cumsum([len(x[k]) for x in ids], dtype=np.int64)) for k in (0, 1))
        ends_a, ends_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        # ids spell whole texts, so the lists meet at the end of every text and no group crosses it
        self.last_a, self.last_b = overlaps(ends_a, ends_b, piece)
        self.at_group = np.searchsorted(self.last_a, self.at_a)

    def links(self) -> np.ndarray:
        """The linked pair of each group as one number; tokens have bytes, so at each end stands one of A and one of B."""
        return self.a[self.last_a].astype(np.uint64) << np.uint64(32) | self.b[self.last_b].astype(np.uint64)

    def written(self) -> Iterator[str]:
        """The groups of each text."""
        count = np.arange(len(self.last_a))
        group_a = np.repeat(count, np.diff(self.last_a, prepend=-1))
        group_b = np.repeat(count, np.diff(self.last_b, prepend=-1))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        i, j = np.arange(len(self.a)), np.arange(len(self.b))
        codes[i + np.append(0, self.last_b + 1)[group_a]] = 2 * self.a.astype(np.int64) + (i == self.last_a[group_a])
        codes[j + self.last_a[group_b] + 1] = 2 * (len(self.pair.bytes_a) + self.b.astype(np.int64)) + (j == self.last_b[group_b])
        word = self.pair.written.__getitem__
        for lo, hi in zip(self.at_a[:-1] + self.at_b[:-1], self.at_a[1:] + self.at_b[1:]):
            yield "".join(map(word, codes[lo:hi].tolist()))[:-1]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False, piece: int = PIECE) -> DataFrame:
    """A row for each document with its counts, groups (``a1,a2|b1;a3|b2,b3``, or the SHA-256 of that) and links, and one for each chunk with its pairs."""
    a, b = read_model(path_a or tokenizer_path(TOKENIZER_A)), read_model(path_b or tokenizer_path(TOKENIZER_B))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk = loaded(a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, _, _ in blocks(batch, size=CHUNK_BYTES):
                block = Block(pair, [x or "" for x in part.column(1).to_pylist()], piece)
                which, pairs = pd.factorize(block.links())
                counts = np.bincount(which, minlength=len(pairs))
                order = np.argsort(pairs)
                which = np.argsort(order).astype(np.uint32)[which]
                pairs, counts = pairs[order], counts[order]
                groups = [hashlib.sha256(x.encode()).hexdigest() if x and digest else x for x in block.written()]
                n = np.diff(block.at_group)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(block.at_a)), pa.array(np.diff(block.at_b)), pa.array(n), pa.array(groups, pa.string()), pa.array(np.full(len(n), chunk)),
                    pa.array([pa.compress(which[lo:hi].tobytes(), "zstd", asbytes=True) for lo, hi in zip(block.at_group, block.at_group[1:])], pa.binary()),
                    pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], ROW_NAMES)
                if len(pairs):
                    nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*nothing, pa.array([chunk], pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs.tobytes()], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())], ROW_NAMES)
                chunk += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            key = np.frombuffer(pairs, np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(key), chunk)), pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(np.frombuffer(counts, np.int64))],
                ["chunk", "a", "b", "n"])


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    order = np.lexsort((np.asarray(answers["b"]), np.asarray(answers["a"])))
    count, best = np.asarray(answers["count"])[order], np.asarray(answers["best"])[order]
    sums, bests = [], []
    for raw, n in zip(docs["links"].to_pylist(), docs["n_groups"].to_pylist()):
        which = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint32) if n else np.zeros(0, np.uint32)
        sums.append(int(count[which].sum()))
        bests.append(int(best[which].sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "groups"])
    return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count over the whole corpus, and whether no other a has a higher count with b."""
    pairs = aligned.where("pairs is not null").select("chunk", "pairs", "counts").mapInArrow(_unpacked, "chunk long, a int, b int, n long")
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = summed.groupBy("b").agg(F.max("count").alias("top"))
    return summed.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False, piece: int = PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best and count_sum of every row."""
    aligned = work_table(align(docs, path_a, path_b, digest, piece), "aligned")
    counts = work_table(pair_counts(aligned), "linked_pairs")
    own = aligned.where("pairs is not null").select("chunk", "pairs", "counts").mapInArrow(_unpacked, "chunk long, a int, b int, n long")
    answers = own.join(counts, ["a", "b"]).select("chunk", "a", "b", "count", "best")
    rows = aligned.where("pairs is null").select("doc_id", "n_a", "n_b", "n_groups", "groups", "chunk", "links")
    scored = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long")
    return scored.withColumn("n_links", F.col("n_groups"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
