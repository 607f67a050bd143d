"""Suffix-array dedup with deep-shallow sorting.

The suffixes are the windows of the segments filed in one bucket (see ``passages``), ordered to the window's depth.
The shallow part is a multikey quicksort with eight bytes as one character: every step sorts the suffixes that are
still tied by their next character, to ``SHALLOW`` bytes. Groups that stay tied have a long prefix in common; a group
whose members agree to the full depth is in order as it is, the others are ordered by a blind trie, which keeps
only the depths at which members part and compares one member in full per insertion. Neighbours that agree to the
full depth are one string, and its windows are duplicates for every document but the smallest that has it.

Texts are UTF-8 bytes; null is empty; matches never cross documents. Repeated rows of one id keep their bytes, null
doc_ids neither remove nor lose bytes, extra columns are not read. ``kept`` may end in the middle of a character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passages import HOT, Scheme, deduplicated, removed_count
from .texts import table

WIDTH, GRAM = 50, 20
STEP, SHALLOW = 8, 24


class BlindTrie:
    """Orders strings of one length by their bytes from ``depth`` on.

    An inner node is [depth, children by byte]; a leaf is the list of the members equal to full depth.
    """

    def __init__(self, text: bytes, depth: int, width: int):
        self.text, self.depth, self.width = text, depth, width
        self.root: list | None = None

    def leaf_below(self, node: list) -> list:
        while isinstance(node[-1], dict):
            node = next(iter(node[-1].values()))
        return node

    def insert(self, start: int) -> None:
        text, width = self.text, self.width
        if self.root is None:
            self.root = [start]
            return
        # blind descent: bytes between the branching depths are not looked at
        node = self.root
        while isinstance(node[-1], dict):
            node = node[1].get(text[start + node[0]]) or next(iter(node[1].values()))
        other = self.leaf_below(node)[0]
        common = self.depth
        while common < width and text[start + common] == text[other + common]:
            common += 1
        # second descent to the node where the member parts from the one compared
        parent, key, node = None, -1, self.root
        while isinstance(node[-1], dict) and node[0] < common:
            parent, key = node, text[start + node[0]]
            node = node[1][key]
        if common == width:
            node.append(start)
        elif isinstance(node[-1], dict) and node[0] == common:
            node[1][text[start + common]] = [start]
        else:
            split = [common, {text[other + common]: node, text[start + common]: [start]}]
            if parent is None:
                self.root = split
            else:
                parent[1][key] = split

    def groups(self) -> list[list[int]]:
        """Members in order, equal ones together."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[-1], dict):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def order_windows(text: np.ndarray, starts: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of ``starts`` to depth ``width``, and for each place whether a new string begins there."""
    padded = np.append(text, np.zeros(2 * STEP, np.uint8)).astype(np.uint64)
    wide = padded
    for have in (1, 2, 4):
        wide = (wide[:-have] << np.uint64(8 * have)) | wide[have:]

    def character(at: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes from ``depth`` on as a number; bytes past ``width`` count as nothing."""
        c, beyond = wide[at + depth], depth + STEP - width
        return c >> np.uint64(8 * beyond) if beyond > 0 else c

    order = np.argsort(character(starts, 0), kind="stable")
    c = character(starts[order], 0)
    new = np.append(True, c[1:] != c[:-1])
    shallow = min(shallow, width)
    for depth in range(STEP, shallow, STEP):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            return order, new
        c = character(starts[order[tied]], depth)
        by = np.lexsort((c, group[tied]))
        order[tied] = order[tied][by]
        c, g = c[by], group[tied][by]
        new[tied] = np.append(True, (c[1:] != c[:-1]) | (g[1:] != g[:-1]))
    # deep groups: compare every member with the group's first to full depth
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    same = np.ones(len(order), bool)
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    head = starts[order[first[group[tied]]]]
    mine = starts[order[tied]]
    for depth in range(shallow, width, STEP):
        same[tied] &= character(mine, depth) == character(head, depth)
    mixed = np.unique(group[~same])
    raw = text.tobytes()
    ends = np.append(first[1:], len(order))
    for g in mixed.tolist():
        a, b = int(first[g]), int(ends[g])
        by_start: dict[int, list[int]] = {}
        for i in order[a:b].tolist():
            by_start.setdefault(int(starts[i]), []).append(i)
        trie = BlindTrie(raw, shallow, width)
        for s in by_start:
            trie.insert(s)
        at = a
        for members in trie.groups():
            own = [i for s in members for i in by_start[s]]
            order[at:at + len(own)] = own
            new[at:at + len(own)] = False
            new[at] = True
            at += len(own)
    return order, new


def earlier_windows(width: int):
    """The bucket's method: a window's bit is set when its string also stands in a content of an earlier document."""
    def method(bodies: list[bytes], docs: list[int]) -> list[int]:
        if not bodies:
            return []
        sizes = np.array([len(b) for b in bodies])
        counts = sizes - width + 1
        base = np.cumsum(sizes) - sizes
        content = np.repeat(np.arange(len(bodies)), counts)
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = base[content] + step
        doc = np.asarray(docs, np.int64)[content]
        order, new = order_windows(np.frombuffer(b"".join(bodies), np.uint8), starts, width)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        hit = np.empty(len(starts), bool)
        hit[order] = doc[order] > least[group]
        masks = np.zeros(len(bodies), np.uint64)
        np.bitwise_or.at(masks, content[hit], np.uint64(1) << step[hit].astype(np.uint64))
        return masks.tolist()

    return method


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n (bytes), spans of removed bytes, kept bytes."""
    return deduplicated(docs, Scheme(width, gram, False), earlier_windows(width), hot)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_bytes"), removed_count().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES = {"op5_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM b),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS k FROM n, unnest(range(1, n_bytes - 48)) AS t(i)),
m AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i, lag(i) OVER (PARTITION BY win.doc_id ORDER BY i) AS p FROM win JOIN m USING (k) WHERE m.d < win.doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 49 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
agg AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, max(z) AS last,
               string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS kept FROM gap JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN agg USING (doc_id)"""}
