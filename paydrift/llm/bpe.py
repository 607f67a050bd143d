"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The last token of every prefix of a word fixes the word's encoding: the last token of ``w[:d]`` is the
one token ``t`` that ends there and may follow the last token of ``w[:d - len(t)]``. The distinct words
of a batch, in byte order, are the depth-first order of their trie; the states of the path to the
current node stand on a stack, so prefixes that words share are worked out once. Two tokens may stand
side by side when no merge across their border comes before the merges inside them that consume its
sides; that is read off the right edge of the first and the left edge of the second token.

Words come from the byte-level pre-tokenizer's pattern; added tokens in a text (``<|endoftext|>``) become
their own id, as in the library the files come from. The vocabulary file is read by the driver from the
path given and travels with the tasks. Memory: one batch of texts and a cache of bounded size per worker.

Null texts are empty and have no tokens; texts of any length are encoded whole. Ids are little-endian
unsigned 32-bit integers in one binary value. Other columns pass through unchanged; ``n_tokens``,
``ids`` and ``decoded`` are replaced if they exist.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import blocks, table

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "byte_bpe_50k.json"
#: Entries of each of a worker's caches; emptied when full, which changes no result.
CACHE = 150_000
NEVER = 1 << 60
BATCH_BYTES = 4 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Decoder:
    """The bytes of every id of a byte-level vocabulary file."""

    def __init__(self, model: bytes):
        self.read(json.loads(model))

    def read(self, data: dict) -> None:
        letters = byte_letters()
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.pieces.__getitem__, tokens)).decode("utf-8", "replace")


class Encoder(Decoder):
    """A byte-level vocabulary with its merges."""

    def read(self, data: dict) -> None:
        super().read(data)
        vocab = data["model"]["vocab"]
        added = set(self.added.values())
        self.ids: dict[bytes, int] = {t: i for i, t in self.pieces.items() if i not in added}
        self.longest = max(map(len, self.ids))
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merges[a, b] = rank
            self.parts.setdefault(c, (rank, a, b))
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        """Empties the caches."""
        self.edges: tuple[dict, dict] = ({}, {})
        self.beside: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    # ------------------------------------------------------------------ the merge rules as a relation of neighbours
    def edge(self, token: int, right: int) -> list[tuple[int, int]]:
        """Symbols at the token's left (0) or right (1) end while it forms, each with the rank that consumes it."""
        known = self.edges[right]
        if token not in known:
            out, end = [(token, NEVER)], token
            while end in self.parts:
                rank, a, b = self.parts[end]
                end = b if right else a
                out.append((end, rank))
            known[token] = out
        return known[token]

    def fits(self, first: int, second: int) -> bool:
        """True if the two tokens stay apart: no merge across their border comes in time."""
        key = first << 20 | second
        known = self.beside.get(key)
        if known is None:
            known = True
            for a, a_until in self.edge(first, 1):
                for b, b_until in self.edge(second, 0):
                    rank = self.merges.get((a, b))
                    # of equal merges the leftmost comes first: one inside the first token, before one inside the second
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
            if len(self.beside) > CACHE:
                self.beside.clear()
            self.beside[key] = known
        return known

    # ------------------------------------------------------------------ the trie
    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Token ids of distinct words; a depth-first walk over the trie of the sorted words."""
        out: dict[bytes, bytes] = {}
        ids, beside, fits, longest = self.ids, self.beside, self.fits, self.longest
        last: list[int] = [-1]  # last token of the path's prefixes, by depth
        start_of: list[int] = [0]  # and where it starts
        before = b""
        for word in sorted(words):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1:], start_of[depth + 1:]
            for d in range(depth + 1, len(word) + 1):
                # exactly one token qualifies, so the order of trial is free: a longer form of the last one is likely
                likely = start_of[d - 1]
                token = ids.get(word[likely:d])
                if token is not None and (likely == 0 or beside.get(last[likely] << 20 | token, None) or fits(last[likely], token)):
                    start = likely
                else:
                    for start in range(d - 1, max(0, d - longest) - 1, -1):
                        token = ids.get(word[start:d])
                        if token is not None and start != likely and (start == 0 or fits(last[start], token)):
                            break
                    else:
                        raise ValueError(f"no token ends {word[:d]!r}")
                last.append(token)
                start_of.append(start)
            tokens, d = [], len(word)
            while d:
                tokens.append(last[d])
                d = start_of[d]
            tokens.reverse()
            out[word] = _PACK[len(tokens)](*tokens) if len(tokens) < len(_PACK) else struct.pack(f"<{len(tokens)}I", *tokens)
            before = word
        return out

    # ------------------------------------------------------------------ texts
    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts.

        The pattern never joins a letter and the space after it, so texts are cut before each space and the parts
        are encoded apart. A text with two white spaces in a row is cut by the pattern itself, which splits such a
        run before its last.
        """
        jobs: list[list] = []
        wanted: set[str] = set()
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for text in texts:
            parts: list = []
            for k, span in enumerate(self.split_added.split(text) if self.split_added else [text]):
                if k % 2:
                    parts.append(struct.pack("<I", self.added[span]))
                elif not span:
                    continue
                elif _TWO_SPACES.search(span):
                    parts.append(self.pattern.findall(span))
                    wanted.update(parts[-1])
                else:
                    head, *rest = span.split(" ")
                    keys = ([head] if head else []) + [" " + x for x in rest]
                    parts.append(keys)
                    wanted.update(keys)
            jobs.append(parts)
        missing = [x for x in wanted if x not in cache]
        cut = {x: self.pattern.findall(x) for x in missing}
        known = self.words
        if len(known) > CACHE:
            known.clear()
        new = {y.encode(): y for x in cut.values() for y in x if y not in known}
        for y, code in self.encode_words(list(new)).items():
            known[new[y]] = code
        for x, ys in cut.items():
            cache[x] = known[ys[0]] if len(ys) == 1 else b"".join([known[y] for y in ys])
        get = cache.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts]) for parts in jobs]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]
_TWO_SPACES = re.compile(r"\s\s")
_LOADED: dict[tuple[type, bytes], Decoder] = {}


def loaded(kind: type, model: bytes) -> Decoder:
    """The worker's encoder or decoder for a vocabulary file, built once."""
    key = (kind, hashlib.sha256(model).digest())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(model)
    return _LOADED[key]


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + list(columns.values()), kept + list(columns))


def _schema(df: DataFrame, add: list[T.StructField]) -> T.StructType:
    names = {f.name for f in add}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + add)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` of the whole text; with ``decoded`` also what the ids decode to, by the same worker."""
    model = read_model(path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(Encoder, model)
        for batch in batches:
            for part, _, _ in blocks(batch, text, BATCH_BYTES):
                column = part.column(part.schema.get_field_index(text))
                ids = own.encode_batch([x or "" for x in column.to_pylist()])
                back = {"decoded": pa.array([own.decode(x) for x in ids], pa.string())} if decoded else {}
                yield replaced(part, {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())} | back)
        own.forget()  # the worker may idle while other stages need the memory

    back = [T.StructField("decoded", T.StringType())] if decoded else []
    return docs.mapInArrow(run, _schema(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *back]))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; invalid UTF-8 becomes replacement characters, null ids an empty text."""
    model = read_model(path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(Decoder, model)
        for batch in batches:
            for part, _, _ in blocks(batch, "ids"):
                column = part.column(part.schema.get_field_index("ids"))
                yield replaced(part, {"decoded": pa.array([own.decode(x or b"") for x in column.to_pylist()], pa.string())})

    return coded.mapInArrow(run, _schema(coded, [T.StructField("decoded", T.StringType())]))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe_round_trip": op1_bpe_round_trip}
