"""Passages that documents share: what the two substring operators have in common.

A window is ``width`` consecutive symbols (words or bytes) of one document. It is filed under the least hash of
the grams inside it, so equal windows are filed together wherever they stand, and a document falls into
segments, runs of windows filed under one hash (``MOST`` windows at most). First the hashes that only one document
has are ruled out by counting them over all documents; then the segments of the others go to a bucket of their
hash, once per chunk and content, with the smallest document that has them there. A bucket's method says for
each segment which of its windows also start in a document with a smaller id, one bit a window, and the chunk
puts the bits together.

Segments at the edges of a shared passage hold the document's own words, so a hash with many segments would bring
them all to one bucket. Segments of a hash with ``HOT`` of them or more are not sent: each of their windows goes by
itself to the bucket of its 128-bit digest, once per chunk with the smallest document that has it there. So a
window that every document has is one entry per chunk, and no bucket holds all documents of a passage. No pair of
documents is ever formed; below ``HOT`` texts are compared by their own bytes, above it windows by their digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_count, count_code, in_chunks, joined_codes, key_counts, pieces
from .texts import BYTE_CODES, GRAM_STEP, blocks, grams, mix, window_min, words

MOST = 64
#: Text scanned at once: its arrays of eight bytes a symbol stay near the processor.
SCAN_BYTES = 512 << 10
#: Buckets of segments for each bucket of keys; segments are many times as long as keys.
FINER = 4
#: From so many segments of one hash on, by the codes of its count, windows are filed one by one.
HOT = 1024
SENT = "bucket int, chunk int, kind int, keys binary, docs binary, sizes binary, body binary"
BACK = "chunk int, bucket int, kind int, codes binary"
FULL = (1 << MOST) - 1


@dataclass
class Block:
    """Windows of a block of documents. ``at[d]:at[d + 1]`` are the symbols of document d."""

    doc_ids: list[int]
    at: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    content: Callable[[int, int], bytes]
    kept: Callable[[int, np.ndarray], bytes]


_SPACES = bytes(0x20 if b in (9, 10, 11, 12, 13) else b for b in range(256))


@dataclass(frozen=True)
class Scheme:
    """``width`` symbols in a window, ``gram`` symbols under a hash; symbols are words or single bytes."""

    width: int
    gram: int
    of_words: bool

    def scan(self, docs: pa.Table) -> Iterator[Block]:
        for batch in docs.combine_chunks().to_batches():
            for part, buf, off in blocks(batch, size=SCAN_BYTES):
                yield self.block(part.column(part.schema.get_field_index("doc_id")).to_pylist(), buf, off)

    def block(self, doc_ids: list[int], buf: np.ndarray, off: np.ndarray) -> Block:
        raw = buf.tobytes()
        if self.of_words:
            w = words(buf, off)
            at, hashes = w.bounds, grams(w, self.gram)[0]
            raw = raw.translate(_SPACES)
            begin, end = w.starts, w.ends

            def content(a: int, b: int) -> bytes:
                s = raw[begin[a]:end[b - 1]]
                return b" ".join(s.split()) if b"  " in s else s

            def kept(d: int, removed: np.ndarray) -> bytes:
                own = raw[off[d]:off[d + 1]].split()
                return b" ".join(own if not removed.any() else [own[i] for i in np.flatnonzero(~removed)])
        else:
            at = off
            hashes, have = BYTE_CODES[buf], 1
            while have < self.gram:
                step = min(have, self.gram - have)
                # a gram of have + step bytes from the grams at its start and ``step`` further on
                hashes = hashes[:-step] * (GRAM_STEP << np.uint64(1) ^ np.uint64(2 * have + 1)) + hashes[step:] if len(hashes) > step else hashes[:0]
                have += step
            hashes = mix(hashes)

            def content(a: int, b: int) -> bytes:
                return raw[a:b]

            def kept(d: int, removed: np.ndarray) -> bytes:
                own = raw[off[d]:off[d + 1]]
                return own if not removed.any() else np.frombuffer(own, np.uint8)[~removed].tobytes()
        values = window_min(hashes, self.width - self.gram + 1)
        n = len(values)
        lengths = np.diff(at)
        ok = np.flatnonzero(lengths >= self.width)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, at[ok], 1)
        np.add.at(edge, at[ok + 1] - self.width + 1, -1)
        valid = np.cumsum(edge[:n]) > 0
        places = np.flatnonzero(valid)
        if not len(places):
            z = np.zeros(0, np.int64)
            return Block(doc_ids, at, np.zeros(0, np.uint64), z, z, content, kept)
        held = values[places]
        new = np.append(True, (places[1:] != places[:-1] + 1) | (held[1:] != held[:-1]))
        first = np.flatnonzero(new)
        if len(first) < len(places):
            run = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
            first = np.flatnonzero(run % MOST == 0)
        return Block(doc_ids, at, held[first], places[first], np.diff(np.append(first, len(places))), content, kept)

    def windows(self, body: bytes) -> list[bytes]:
        """The windows of a segment's content, in order."""
        if not self.of_words:
            return [body[i:i + self.width] for i in range(len(body) - self.width + 1)]
        own = body.split(b" ")
        return [b" ".join(own[i:i + self.width]) for i in range(len(own) - self.width + 1)]

    def keys(self, docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of a chunk and the number of its segments that have each; one for a lone document with few."""
        values, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in self.scan(docs):
            doc = np.searchsorted(b.at, b.starts, "right") - 1
            values.append(b.values)
            of.append(np.asarray(b.doc_ids, np.int64)[doc] if len(doc) else doc)
        v, d = np.concatenate(values), np.concatenate(of)
        order = np.lexsort((d, v))
        v, d = v[order], d[order]
        if not len(v):
            return v, d
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        ends = np.append(first[1:], len(v))
        segments = ends - first
        return v[first], np.where((d[first] != d[ends - 1]) | (segments >= MOST), segments, 1)


def by_content(value: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """The order of ``value``, and of the contents where values are equal."""
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(order) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(order))
    for a, z in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist()):
        order[a:z] = sorted(order[a:z].tolist(), key=bodies.__getitem__)
    return order


def digest_order(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of digests given as two numbers each, and where a new one begins in it."""
    by = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ranked = pairs[by]
    return by, np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))[:len(by)]


def answered(answers: pa.Table, kind: type, total: int) -> np.ndarray:
    """What the buckets answer to a chunk, put together in the order of the buckets."""
    parts = sorted(zip(answers["bucket"].to_pylist(), answers["codes"].to_pylist()))
    out = np.frombuffer(b"".join([zlib.decompress(c) for _, c in parts]), kind)
    if len(out) != total:
        raise ValueError(f"{len(out)} answers for {total} segments or windows")
    return out


class Segments:
    """A chunk's distinct segments that other documents may share, in one fixed order, and where they occur."""

    def __init__(self, scheme: Scheme, docs: pa.Table, answers: pa.Table, n: int, hot: int = HOT):
        self.blocks = list(scheme.scan(docs)) if docs.num_rows else []
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[b.values for b in self.blocks]]))
        codes = joined_codes(answers, len(keys))
        shared = keys[codes > 0]
        many = codes[codes > 0] >= count_code(np.array([hot]))[0]
        known: dict[bytes, int] = {}
        self.values: list[int] = []
        self.docs: list[int] = []
        self.sizes: list[int] = []
        #: per block: document, first window, windows and number of the content of each shared segment
        self.places: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for b in self.blocks:
            spot = np.minimum(np.searchsorted(shared, b.values), max(0, len(shared) - 1))
            own = np.flatnonzero(shared[spot] == b.values) if len(shared) else np.zeros(0, np.int64)
            doc = np.searchsorted(b.at, b.starts[own], "right") - 1
            which = np.zeros(len(own), np.int64)
            for i, (d, a, c, v) in enumerate(zip(doc.tolist(), b.starts[own].tolist(), b.counts[own].tolist(), b.values[own].tolist())):
                body = b.content(a, a + c + scheme.width - 1)
                k = known.setdefault(body, len(known))
                if k == len(self.docs):
                    self.docs.append(b.doc_ids[d])
                    self.sizes.append(c)
                    self.values.append(v)
                elif b.doc_ids[d] < self.docs[k]:
                    self.docs[k] = b.doc_ids[d]
                which[i] = k
            self.places.append((doc, b.starts[own], b.counts[own], which))
        self.bodies = list(known)
        value = np.array(self.values, np.uint64)
        apart = many[np.searchsorted(shared, value)] if len(shared) else np.zeros(0, bool)
        #: contents by bucket; equal hashes are ordered by content, as a chunk's rows come in another order when read again
        cold = np.flatnonzero(~apart)
        self.order = cold[by_content(value[cold], [self.bodies[i] for i in cold])]
        self.borders = pieces(value[self.order], FINER * n)
        self.keys = (value >> np.uint64(32 - ((FINER * n).bit_length() - 1))).astype(np.uint32)
        #: contents of hot hashes, their windows one after the other: content, place in it, number of the digest
        self.apart = np.flatnonzero(apart)
        digests, count = [b""], np.zeros(len(self.apart), np.int64)
        for i, k in enumerate(self.apart.tolist()):
            own = [hashlib.blake2b(w, digest_size=16).digest() for w in scheme.windows(self.bodies[k])]
            digests.append(b"".join(own))
            count[i] = len(own)
        pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        self.content = np.repeat(self.apart, count)
        self.step = np.arange(len(pairs)) - np.repeat(np.cumsum(count) - count, count)
        by, new = digest_order(pairs)
        self.digest = np.empty(len(pairs), np.int64)
        self.digest[by] = np.cumsum(new) - 1
        self.digests = pairs[by[new]]
        self.least = np.minimum.reduceat(np.array(self.docs, np.int64)[self.content[by]], np.flatnonzero(new)) if len(by) else np.zeros(0, np.int64)
        self.digest_borders = pieces(self.digests[:, 0], FINER * n)

    def sent(self, chunk: int) -> pa.Table:
        at, order = self.borders, self.order
        full = np.flatnonzero(np.diff(at))
        docs, sizes = np.array(self.docs, np.int64), np.array([len(x) for x in self.bodies], np.uint32)
        segments = pa.table({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int32()), "kind": pa.array(np.full(len(full), 1), pa.int32()),
            "keys": pa.array([self.keys[order[at[b]:at[b + 1]]].tobytes() for b in full], pa.binary()),
            "docs": pa.array([docs[order[at[b]:at[b + 1]]].tobytes() for b in full], pa.binary()),
            "sizes": pa.array([sizes[order[at[b]:at[b + 1]]].tobytes() for b in full], pa.binary()),
            "body": pa.array([zlib.compress(b"".join([self.bodies[i] for i in order[at[b]:at[b + 1]]]), 1) for b in full], pa.binary())})
        at = self.digest_borders
        full = np.flatnonzero(np.diff(at))
        windows = pa.table({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int32()), "kind": pa.array(np.full(len(full), 2), pa.int32()),
            "keys": pa.array([self.digests[at[b]:at[b + 1]].tobytes() for b in full], pa.binary()), "docs": pa.array([self.least[at[b]:at[b + 1]].tobytes() for b in full], pa.binary()),
            "sizes": pa.array([b""] * len(full), pa.binary()), "body": pa.array([b""] * len(full), pa.binary())})
        return pa.concat_tables([segments, windows])

    def removed(self, answers: pa.Table, windows: pa.Table) -> Iterator[tuple[Block, np.ndarray]]:
        """Each block with a flag for every window that also starts in an earlier document."""
        mask = np.zeros(len(self.bodies), np.uint64)
        mask[self.order] = answered(answers, np.uint64, len(self.order))
        earlier = answered(windows, np.uint8, len(self.digests))
        # the chunk's own smallest document of a window may be earlier than that of a content it stands in
        hit = (earlier[self.digest] > 0) | (self.least[self.digest] < np.array(self.docs, np.int64)[self.content])
        np.bitwise_or.at(mask, self.content[hit], np.uint64(1) << self.step[hit].astype(np.uint64))
        first = np.array(self.docs, np.int64)
        for b, (doc, start, count, which) in zip(self.blocks, self.places):
            own = np.asarray(b.doc_ids, np.int64)[doc] if len(doc) else doc
            bits = np.where(own > first[which], np.uint64(FULL), mask[which]) if len(doc) else np.zeros(0, np.uint64)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hit = (np.repeat(bits, count) >> step.astype(np.uint64)) & np.uint64(1)
            yield b, (np.repeat(start, count) + step)[hit == 1]


#: What a bucket does: contents in order of their smallest document, those documents, and the mask of each content.
Method = Callable[[list[bytes], list[int]], list[int]]


def earlier_digests(rows: pa.Table) -> pa.Table:
    """For each window of each row, whether another chunk has it in an earlier document."""
    own = [np.frombuffer(x, np.int64) for x in rows["docs"].to_pylist()]
    docs = np.concatenate([np.zeros(0, np.int64), *own])
    by, new = digest_order(np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64).reshape(-1, 2))
    out = np.zeros(len(docs), np.uint8)
    if len(docs):
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[by], first)
        out[by] = docs[by] > np.repeat(least, np.diff(np.append(first, len(docs))))
    at = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int64)
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "kind": rows["kind"], "codes": pa.array([zlib.compress(out[at[i]:at[i + 1]].tobytes(), 1) for i in range(rows.num_rows)], pa.binary())})


def bucket_task(method: Method):
    def task(rows: pa.Table) -> pa.Table:
        kind = np.array(rows["kind"].to_pylist(), np.int64)
        return pa.concat_tables([compared(rows.filter(pa.array(kind == 1))), earlier_digests(rows.filter(pa.array(kind == 2)))])

    def compared(rows: pa.Table) -> pa.Table:
        origin, bodies, docs, keys = [], [], [], []
        for r, (raw_keys, raw_docs, raw_sizes, raw) in enumerate(zip(*(rows[c].to_pylist() for c in ("keys", "docs", "sizes", "body")))):
            body, at = zlib.decompress(raw), 0
            for size in np.frombuffer(raw_sizes, np.uint32).tolist():
                bodies.append(body[at:at + size])
                at += size
            own = np.frombuffer(raw_docs, np.int64).tolist()
            docs += own
            keys += np.frombuffer(raw_keys, np.uint32).tolist()
            origin += [r] * len(own)
        least: dict[bytes, int] = {}
        contents: dict[int, int] = {}
        key_of: dict[bytes, int] = {}
        for body, doc, key in zip(bodies, docs, keys):
            known = least.get(body)
            if known is None:
                contents[key] = contents.get(key, 0) + 1
                key_of[body] = key
                least[body] = doc
            elif doc < known:
                least[body] = doc
        # equal windows are filed under one hash: a hash with one content left has nothing to compare
        mask = dict.fromkeys(least, 0)
        ordered = sorted([x for x in least if contents[key_of[x]] > 1], key=lambda x: (least[x], x))
        mask.update(zip(ordered, method(ordered, [least[x] for x in ordered])))
        out = np.array([FULL if doc > least[body] else mask[body] for body, doc in zip(bodies, docs)], np.uint64)
        at = np.searchsorted(origin, np.arange(rows.num_rows + 1))
        return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "kind": pa.array(np.ones(rows.num_rows), pa.int32()),
                         "codes": pa.array([zlib.compress(out[at[i]:at[i + 1]].tobytes(), 1) for i in range(rows.num_rows)], pa.binary())})

    return task


def shared_passages(docs: DataFrame, scheme: Scheme, method: Method, hot: int = HOT) -> DataFrame:
    """doc_id, n (symbols), spans (from, to, by symbol) of what is removed, kept bytes; rows without an id keep all."""
    n = chunk_count(docs)
    chunked = in_chunks(docs, n)
    codes = key_counts(chunked, scheme.keys, n).select("chunk", "bucket", F.lit(0).alias("kind"), "codes")

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return Segments(scheme, rows, answers, n, hot).sent(rows["chunk"][0].as_py() if rows.num_rows else 0)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kind = np.array(answers["kind"].to_pylist(), np.int64)
        found = Segments(scheme, rows, answers.filter(pa.array(kind == 0)), n, hot)
        doc_ids, sizes, spans, kept = [], [], [], []
        for b, windows in found.removed(answers.filter(pa.array(kind == 1)), answers.filter(pa.array(kind == 2))):
            total = int(b.at[-1])
            edge = np.zeros(total + 1, np.int32)
            edge[windows] += 1
            edge[windows + scheme.width] -= 1
            gone = np.cumsum(edge[:total]) > 0
            for d, doc_id in enumerate(b.doc_ids):
                own = gone[b.at[d]:b.at[d + 1]]
                doc_ids.append(doc_id)
                sizes.append(len(own))
                kept.append(b.kept(d, own))
                border = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                spans.append([{"from": a, "to": z} for a, z in zip(border[::2].tolist(), border[1::2].tolist())])
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n", "spans", "kept"])

    asked = chunked.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(send, SENT)
    masks = asked.groupBy("bucket").applyInArrow(bucket_task(method), BACK)
    schema = "doc_id long, n long, spans array<struct<`from`:long,`to`:long>>, kept binary"
    return chunked.groupBy("chunk").cogroup(codes.union(masks).groupBy("chunk")).applyInArrow(finish, schema)


def whole(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The rows without an id, which are neither earlier nor later than others, in the same shape."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in blocks(batch):
                b = scheme.block([None] * part.num_rows, buf, off)
                lengths = np.diff(b.at)
                yield pa.RecordBatch.from_arrays([pa.array([None] * part.num_rows, pa.int64()), pa.array(lengths, pa.int64()), pa.array([[]] * part.num_rows, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                                                  pa.array([b.kept(d, np.zeros(int(lengths[d]), bool)) for d in range(part.num_rows)], pa.binary())], ["doc_id", "n", "spans", "kept"])

    schema = "doc_id long, n long, spans array<struct<`from`:long,`to`:long>>, kept binary"
    return docs.where(F.col("doc_id").isNull()).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def deduplicated(docs: DataFrame, scheme: Scheme, method: Method, hot: int = HOT) -> DataFrame:
    return shared_passages(docs, scheme, method, hot).union(whole(docs, scheme))


def removed_count() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
