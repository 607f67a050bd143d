"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens whose zeros are ignored, so a hit survives substituted
tokens at those places. All benchmark items are hashed under every mask into sorted key arrays, every
window of every document is hashed the same way and looked up, and around each hit the item and the
document are laid side by side: the best run of matches, a substitution costing ``MISMATCH``, is tested, then the
best runs left and right of it, down to stretches with too few equal tokens. Between the runs that pass, the
stretches that meet both limits though no best run does are overlaps too, so nothing is lost to the score.

The masks together ignore each pair of positions of a window of eight, and three in a row between five and one: any
stretch of ten equal tokens or more of which three quarters agree has a window that one of them hits.
Items are taken in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_TOKENS`` tokens at most (one item at least); each
block's index is bounded by them and the longest item. Its items are sent to the tasks, which sort the keys, and it
is searched against all documents by workers of its own job part, so no table size is assumed.

Tokens are runs of letters, digits and bytes beyond ASCII, with A-Z lowered; everything else separates,
so punctuation and line breaks never hide a passage. Items with fewer tokens than a mask match when all of their
tokens occur in a row; items without tokens match nothing. Null texts are empty. Repeated item ids are
told apart by their text and reported once. Null item ids are ignored. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import GRAM_STEP, Words, blocks, column_bytes, mix, table, words, work_table

MASKS = tuple("".join("01"[i not in pair] for i in range(8)) for pair in combinations(range(8), 2)) + ("111110001",)
BLOCK_ITEMS, BLOCK_TOKENS = 20_000, 200_000
#: Places of flags for each window of a block's items.
FLAGS = 16
#: A run is an overlap when it has at least so many equal tokens (or the whole shorter item) ...
LEAST_TOKENS = 10
#: ... of which this share agrees; a substitution takes this much from the score of a run.
LEAST_SHARE, MISMATCH = 0.75, 2
ROW = "decontam_row"
SCHEMA = "doc_id long, n_tokens long, n_items long, n_contaminated long, item_ids array<long>, spans string"

_INNER = np.zeros(256, bool)
_INNER[128:] = True
for _range in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _INNER[list(_range)] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> Words:
    return words(buf, off, lower=True, member=_INNER)


def seed_keys(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the tokens under the ones of ``mask``, for the window from each token on."""
    m = len(hashes) - len(mask) + 1
    acc = np.full(max(m, 0), np.uint64(salt + 1), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and m > 0:
            acc = acc * GRAM_STEP + hashes[j:j + m]
    return mix(acc)


def progressions(key: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and step of runs of equally distant places with one key and group; places rise within those."""
    n = len(place)
    if not n:
        return place, place, place
    first = np.ones(n, bool)
    first[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    gap = np.diff(place, prepend=place[:1])
    new = first.copy()
    # a place begins a run when the distance to the place before is not that of the run
    new[2:] |= ~first[1:-1] & (gap[2:] != gap[1:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    return place[start], length, np.where(length > 1, gap[np.minimum(start + 1, n - 1)], 0)


def _singled(pair: np.ndarray) -> np.ndarray:
    """Pairs of runs with different steps as pairs of a place of the shorter and the longer run."""
    p, k, s, q, l, t = pair
    left = k <= l
    n = np.where(left, k, l)
    which = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    out = pair[:, which].copy()
    mine = left[which]
    out[0] += np.where(mine, j * s[which], 0)
    out[3] += np.where(mine, 0, j * t[which])
    out[1], out[4] = np.where(mine, 1, k[which]), np.where(mine, l[which], 1)
    return out


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct columns of three rows of integers."""
    low = rows.min(1)
    span = [int(x) for x in rows.max(1) - low + 1]
    if span[0] * span[1] * span[2] >= 1 << 62:
        return np.unique(rows, axis=1)
    a, b, c = rows - low[:, None]
    code = np.unique((a * span[1] + b) * span[2] + c)
    return np.stack([code // span[2] // span[1], code // span[2] % span[1], code % span[2]]) + low[:, None]


class Index:
    """Sorted seed keys of a block of items with item and position, and the items' token hashes."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...]):
        self.ids, self.masks = ids, masks
        w = tokens(*column_bytes(pa.array(texts, pa.large_string())))
        self.hashes, self.bounds = w.hashes, w.bounds

    @cached_property
    def item(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))

    @cached_property
    def tables(self) -> list[tuple]:
        """(mask, salt, key of each run in order, runs, flags), built where they are used; short items get a mask of their own length."""
        masks, item, lengths = self.masks, self.item, np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], lengths) - np.arange(len(self.hashes))
        out = []
        wide = len(masks[0])
        jobs = [(m, s, None) for s, m in enumerate(masks)]
        jobs += [("1" * n, 100 + n, n) for n in sorted(set(lengths[(lengths > 0) & (lengths < wide)].tolist()))]
        for mask, salt, only in jobs:
            keys = seed_keys(self.hashes, mask, salt)
            place = np.arange(len(keys))
            fits = left[:len(keys)] >= len(mask)
            if only:
                fits &= lengths[item[:len(keys)]] == only
            place = place[fits]
            order = np.argsort(keys[place], kind="stable")
            # a flag for the low bits of every key rules out nearly all windows before the binary search
            flags = np.zeros(1 << max(10, (FLAGS * len(order)).bit_length()), bool)
            flags[(keys[place] & np.uint64(len(flags) - 1)).astype(np.int64)] = True
            place = place[order]
            runs = progressions(keys[place], item[place], place)
            out.append((mask, salt, keys[runs[0]], runs, flags))
        return out

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> set[tuple[int, int, int]]:
        """Distinct (document, item, token shift) with at least one equal seed.

        Places of one key that stand at equal distances, as in repeated words or lines, are one run on either side. A pair
        of runs is a range of shifts, so a repetitive text beside a repetitive item costs its shifts and not its pairs of places.
        """
        found: set[tuple[int, int, int]] = set()
        for mask, salt, keys, (place, length, step), flags in self.tables:
            m = len(hashes) - len(mask) + 1
            if m <= 0 or not len(keys):
                continue
            mine = seed_keys(hashes, mask, salt)
            hit = np.flatnonzero(flags[(mine & np.uint64(len(flags) - 1)).astype(np.int64)])
            hit = hit[doc[hit] == doc[hit + len(mask) - 1]]
            near = np.minimum(np.searchsorted(keys, mine[hit]), len(keys) - 1)
            hit = hit[keys[near] == mine[hit]]
            if not len(hit):
                continue
            hit = hit[np.lexsort((hit, mine[hit], doc[hit]))]
            at, many, every = progressions(mine[hit], doc[hit], hit)
            lo = np.searchsorted(keys, mine[at])
            n = np.searchsorted(keys, mine[at], "right") - lo
            one = np.repeat(np.arange(len(at)), n)
            two = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pair = np.stack([at[one], many[one], every[one], place[two], length[two], step[two]])
            # runs of different steps: the places of the shorter one are runs of their own
            odd = (pair[1] > 1) & (pair[4] > 1) & (pair[2] != pair[5])
            if odd.any():
                pair = np.concatenate([pair[:, ~odd], _singled(pair[:, odd])], 1)
            p, k, s, q, l, t = pair
            s = np.where(k > 1, s, t)
            count = k + l - 1
            shifts = np.repeat(p - q - (l - 1) * s, count) + np.repeat(s, count) * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
            rows = np.stack([np.repeat(doc[p], count), np.repeat(self.item[q], count), shifts])
            found.update(map(tuple, _distinct(rows).T.tolist()))
        return found

    def overlaps(self, hashes: np.ndarray, lo: int, hi: int, item: int, shift: int) -> list[tuple[int, int]]:
        """Token ranges of the document (between lo and hi) that overlap the item at this shift."""
        a, b = int(self.bounds[item]), int(self.bounds[item + 1])
        x, y = max(lo, a + shift), min(hi, b + shift)
        same = hashes[x:y] == self.hashes[x - shift:y - shift]
        return [(x + s, x + e) for s, e in agreeing(same, min(LEAST_TOKENS, b - a))]


def best_run(same: np.ndarray) -> tuple[int, int]:
    gain = np.cumsum(np.where(same, 1, -MISMATCH))
    low = np.minimum.accumulate(np.append(0, gain))[:-1]
    end = int(np.argmax(gain - low))
    return int(np.argmin(np.append(0, gain)[:end + 1])), end + 1


def stretches(same: np.ndarray, need: int) -> list[tuple[int, int]]:
    """The places, as ranges, of all stretches between equal tokens that have ``need`` of them and ``LEAST_SHARE``."""
    n = len(same)
    equal = np.append(0, np.cumsum(same))
    # a stretch has the share when this is no less at its end than at its start
    level = equal - LEAST_SHARE * np.arange(n + 1)
    beyond = np.maximum.accumulate(level[::-1])[::-1]
    last = n - np.searchsorted(beyond[::-1], level[:-1])
    starts = np.flatnonzero(same & (equal[last] - equal[:-1] >= need))
    out: list[tuple[int, int]] = []
    # what lies behind the last equal token is not part of a stretch
    ends = np.append(0, np.maximum.accumulate(np.where(same, np.arange(n) + 1, 0)))
    for a, z in zip(starts.tolist(), ends[last[starts]].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def agreeing(same: np.ndarray, need: int) -> list[tuple[int, int]]:
    """All overlaps in a comparison token by token, in order."""
    total = np.append(0, np.cumsum(same))
    found, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if total[hi] - total[lo] < need:
            continue
        a, z = best_run(same[lo:hi])
        equal = int(total[lo + z] - total[lo + a])
        if equal >= need and equal >= LEAST_SHARE * (z - a):
            found.append((lo + a, lo + z))
        todo += [(lo, lo + a), (lo + z, hi)]
    found.sort()
    free = zip([0, *(z for _, z in found)], [*(a for a, _ in found), len(same)])
    return sorted(found + [(lo + a, lo + z) for lo, hi in free if total[hi] - total[lo] >= need for a, z in stretches(same[lo:hi], need)])


def _runs(index: Index, w: Words) -> dict[int, list[tuple[int, int, int]]]:
    """Overlaps (token from, to, item id) of each document of a block that has any."""
    per: dict[int, list[tuple[int, int, int]]] = {}
    for d, item, shift in sorted(index.hits(w.hashes, w.doc_of())):
        for run in index.overlaps(w.hashes, int(w.bounds[d]), int(w.bounds[d + 1]), item, shift):
            per.setdefault(d, []).append((int(run[0] - w.bounds[d]), int(run[1] - w.bounds[d]), index.ids[item]))
    return per


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("item", pa.int64())]))


def _searcher(index: Index, every: bool = True):
    """All columns but the text, n_tokens and spans, of every row or of those with an overlap."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in blocks(batch):
                w = tokens(buf, off)
                per = _runs(index, w)
                which = [d for d in range(part.num_rows) if every or d in per]
                spans = [[{"from": a, "to": b, "item": i} for a, b, i in sorted(set(per.get(d, ())))] for d in which]
                own = part.drop_columns(["text"]).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.diff(w.bounds)[which], pa.int64()), pa.array(spans, _SPANS)], [*own.schema.names, "n_tokens", "spans"])

    return search


def item_blocks(items: DataFrame, size: int = BLOCK_ITEMS, most: int | None = None) -> Iterator[list]:
    """Distinct items in order, in lists of ``size`` items and ``most`` tokens (``BLOCK_TOKENS``)."""
    ordered = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy("item_id", "text")
    block, total, most = [], 0, most or BLOCK_TOKENS
    for row in ordered.toLocalIterator():
        own = len(tokens(*column_bytes(pa.array([row["text"]], pa.large_string()))).hashes)
        if block and (len(block) == size or total + own > most):
            yield block
            block, total = [], 0
        block.append(row)
        total += own
    if block:
        yield block


def _indexes(items: DataFrame, masks: tuple[str, ...], block_items: int) -> list[Index]:
    return [Index([r["item_id"] for r in b], [r["text"] for r in b], masks) for b in item_blocks(items, block_items)]


def numbered(rows: DataFrame, name: str = ROW) -> DataFrame:
    """The rows with a number each, written so that every reader sees the same one."""
    return work_table(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, n_tokens, spans (token from, to, item) of every document row, with any number of blocks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = "n_tokens long, spans array<struct<`from`:long,`to`:long,item:long>>"
    indexes = _indexes(items, masks, block_items)
    if len(indexes) < 2:
        return rows.mapInArrow(_searcher(*indexes or [Index([], [], masks)]), f"doc_id long, {found}")
    # the first block gives every row, the others rows with an overlap; a row is known by its number, not by its id
    rows = numbered(rows)
    both = reduce(DataFrame.unionAll, [rows.mapInArrow(_searcher(x, k == 0), f"doc_id long, {ROW} long, {found}") for k, x in enumerate(indexes)])
    every = both.groupBy(ROW).agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return every.select("doc_id", "n_tokens", "spans")


def contamination(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document: its tokens, the items found, tokens covered by overlaps, and the spans as text."""
    found = overlaps(docs, items, masks, block_items)
    # spans are sorted by start, so the covered tokens are the parts beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                          lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["to"] - F.greatest(a["end"], s["from"]))).alias("n"), F.greatest(a["end"], s["to"]).alias("end")),
                          lambda a: a["n"])
    items_of = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["item"], s["from"], s["to"])), ",")
    return found.select("doc_id", "n_tokens", F.size(items_of).cast("long").alias("n_items"), covered.alias("n_contaminated"), items_of.alias("item_ids"), text.alias("spans"))


def clean(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` without an overlap with any item, with all their columns; no shuffle with one block of items."""
    def keeper(index: Index):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, buf, off in blocks(batch):
                    found = _runs(index, tokens(buf, off))
                    yield part.filter(pa.array([d not in found for d in range(part.num_rows)], pa.bool_()))

        return keep

    indexes = _indexes(items, masks, block_items)
    if len(indexes) < 2:
        return docs.mapInArrow(keeper(indexes[0]), docs.schema) if indexes else docs
    # each block has workers of its own: a chain of blocks would hold all indexes at once
    number = ROW
    while number.lower() in [c.lower() for c in docs.columns]:
        number += "_"
    rows = numbered(docs, number)
    found = reduce(DataFrame.unionAll, [rows.select(number, "text").mapInArrow(_searcher(x, False), f"{number} long, n_tokens long, spans array<struct<`from`:long,`to`:long,item:long>>").select(number) for x in indexes])
    return rows.join(found, number, "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
