"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word n-grams. Sets are ordered by document frequency, rarest first, and two
sets that are similar enough share an entry of their prefixes; an n-gram that no other set has cannot count, so
a set with too few shared n-grams is left out at once. Copies of one set are one set.

An index list holds the sets with one n-gram in their prefix. Its smallest set leads it; all sets whose lists the
same set leads form a star, so every similar pair meets in a star. Inside a star, sets go from small to large and
index lists hold places in that order: the places whose sizes cannot reach the similarity are skipped as blocks at
both ends of each list, and a set's overlaps are derived from those of the set before it by the n-grams in which the
two differ, when those are fewer. Stars beyond ``STAR`` sets are dealt into blocks that the leader joins;
then members that are still in different components meet in pairs of blocks. Every task returns a spanning
forest of the links it found, so copies and near copies never become all pairs.

Words are 0x20 and 0x09-0x0D separated, A-Z lowered. Fewer words than n: the whole sequence is the one entry.
No words or a null text: the empty set, linked with nothing. Null doc_ids come back with a null class.
Repeated rows are copies; rows that repeat an id with another text are sets of their own. Similarity is compared in whole numbers: 100 * both >= percent * either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunk_count, in_chunks, joined_codes, key_counts, with_codes
from .graph import components
from .texts import blocks, grams, mix, table, work_table, words

WORDS, PERCENT = 5, 75
#: Sets that one task compares at most.
STAR = 1024
SET_ROW = "doc_id long, n long, f1 long, f2 long, tokens binary, `from` int, `to` int"


def sets_of(docs: pa.Table, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and sorted distinct n-gram hashes of each row."""
    for batch in docs.combine_chunks().to_batches():
        for part, buf, off in blocks(batch):
            w = words(buf, off, lower=True)
            g, _ = grams(w, n)
            for d, doc_id in enumerate(part.column(part.schema.get_field_index("doc_id")).to_pylist()):
                lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                if hi - lo >= n:
                    yield doc_id, np.unique(g[lo:hi - n + 1])
                elif hi > lo:
                    code = np.uint64(hi - lo)
                    for h in w.hashes[lo:hi]:
                        code = mix(np.array([code ^ h]))[0]
                    yield doc_id, np.array([code], np.uint64)
                else:
                    yield doc_id, np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(mix(s).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def _chunk_keys(n: int):
    def keys(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = {fingerprint(s): s for _, s in sets_of(docs, n)}
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *own.values()]), return_counts=True)

    return keys


def required(size: int, percent: int) -> int:
    """The least overlap with any similar set."""
    return -(-percent * size // 100)


def _set_rows(n: int, percent: int):
    """Rows of a chunk: size and fingerprint of every set, and the ordered n-grams of those that can have a partner."""
    def rows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = list(sets_of(docs, n)) if docs.num_rows else []
        out, sent = [], {}
        prints = [fingerprint(s) for _, s in own]
        distinct = {p: s for p, (_, s) in zip(prints, own)}
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *distinct.values()]))
        codes = joined_codes(answers, len(keys))
        for k, (doc_id, s) in enumerate(own):
            if prints[k] not in sent or doc_id < own[sent[prints[k]]][0]:
                sent[prints[k]] = k
        copied = {}
        for p in prints:
            copied[p] = copied.get(p, 0) + 1
        for k, (doc_id, s) in enumerate(own):
            row = (doc_id, len(s), *prints[k], None, 0, 0)
            if len(s) and sent[prints[k]] == k:
                df = codes[np.searchsorted(keys, s)]
                need = required(len(s), percent)
                if int((df > 0).sum()) >= need:
                    order = np.lexsort((s, df))
                    first = int((df == 0).sum())
                    row = (doc_id, len(s), *prints[k], s[order].tobytes(), first, len(s) - need + 1)
            out.append(row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n", "f1", "f2", "tokens", "from", "to"])

    return rows


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, raw, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            tokens.append(np.frombuffer(raw, np.int64)[a:b])
            docs.append(np.full(max(0, b - a), doc, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(docs))], ["token", "doc"])


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def star_links(docs: list[int], sets: list[np.ndarray], group: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect sets of different ``group``: a spanning forest of all that hold. Sets are sorted arrays."""
    order = sorted(range(len(docs)), key=lambda i: (len(sets[i]), docs[i]))
    sizes = np.array([len(sets[i]) for i in order])
    every = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by_token = np.argsort(every, kind="stable")
    # index lists: for each n-gram the places of its sets in the order of sizes
    tokens, rank = np.unique(every, return_inverse=True)
    m = len(order)
    lists = np.sort(rank * m + owner)
    place = np.split(rank, np.cumsum(sizes)[:-1])
    forest, links = Forest(), []
    overlaps, before = np.zeros(m, np.int64), np.zeros(0, np.int64)

    def counted(which: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of these lists have each place from lo to hi; what lies before and behind is skipped as a block."""
        a, b = np.searchsorted(lists, which * m + lo), np.searchsorted(lists, which * m + hi)
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(lists[at] % m - lo, minlength=hi - lo)[:max(0, hi - lo)]

    for y, own in enumerate(place):
        lo = int(np.searchsorted(sizes, required(int(sizes[y]), percent)))
        if lo < y:
            come = np.setdiff1d(own, before, True)
            gone = np.setdiff1d(before, own, True)
            if len(gone) + len(come) < len(own) and lo < y - 1:
                # the answers of the set before, which has the same places behind it, changed by the difference
                overlaps[lo:y - 1] += counted(come, lo, y - 1) - counted(gone, lo, y - 1)
                overlaps[y - 1] = len(own) - len(come)
            else:
                overlaps[lo:y] = counted(own, lo, y)
            both = overlaps[lo:y]
            for x in np.flatnonzero(100 * both >= percent * (sizes[lo:y] + sizes[y] - both)) + lo:
                a, b = order[x], order[y]
                if group[a] != group[b] and forest.join(group[a], group[b]):
                    links.append((docs[a], docs[b]))
        before = own if lo < y else np.zeros(0, np.int64)
    return links


def _star_task(percent: int):
    def task(rows: pa.Table) -> pa.Table:
        known = {}
        for doc, group, raw in zip(rows["doc"].to_pylist(), rows["group"].to_pylist(), rows["tokens"].to_pylist()):
            known[doc] = (group, raw)
        docs = sorted(known)
        links = star_links(docs, [np.sort(np.frombuffer(known[d][1], np.uint64)) for d in docs], [known[d][0] for d in docs], percent)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return task


def link_forest(sets: DataFrame, percent: int = PERCENT, star: int = STAR) -> DataFrame:
    """u, v: links between distinct sets (rows with doc_id, tokens, from, to) that connect all that are connected."""
    postings = sets.select("doc_id", "tokens", "from", "to").mapInArrow(_postings, "token long, doc long")
    leaders = postings.groupBy("token").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "leader")
    members = work_table(postings.join(leaders, "token").select("leader", "doc").distinct(), "stars")
    size = members.groupBy("leader").agg(F.count(F.lit(1)).alias("k"))
    split = F.ceil(F.col("k") / (star - 1)).cast("int")
    stars = members.join(size.select("leader", split.alias("parts")), "leader")
    # the leader joins every block of its star
    own = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = stars.select("leader", "parts", "doc", F.explode(F.when(F.col("doc") == F.col("leader"), own).otherwise(F.array(F.pmod(F.xxhash64("doc"), "parts").cast("int")))).alias("part"))
    bodies = sets.select(F.col("doc_id").alias("doc"), "tokens")
    found = dealt.join(bodies, "doc").select("leader", "part", "doc", F.col("doc").alias("group"), "tokens").groupBy("leader", "part").applyInArrow(_star_task(percent), "u long, v long")
    links = work_table(found, "links")
    # stars in several blocks whose members are still apart: blocks of the rest against all blocks
    large = stars.where("parts > 1")
    if large.isEmpty():
        return links
    root = components(links)
    large = large.join(root.withColumnRenamed("u", "doc"), "doc", "left").withColumn("group", F.coalesce("root", "doc")).drop("root")
    main = large.where("doc = leader").select("leader", F.col("group").alias("main"))
    large = work_table(large.join(main, "leader"), "large_stars")
    rest = large.where("group <> main").groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / (star // 2)).cast("int").alias("rests"))
    half = large.join(rest, "leader").withColumn("parts", F.col("parts") * 2)
    here = F.pmod(F.xxhash64("doc"), "parts").cast("int")
    there = F.pmod(F.xxhash64("doc", F.lit(1)), "rests").cast("int")
    every = half.select("leader", "doc", "group", here.alias("part"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"))
    again = half.where("group <> main").select("leader", "doc", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), there.alias("rest"))
    cross = every.union(again).distinct().join(bodies, "doc").select("leader", "part", "rest", "doc", "group", "tokens")
    return links.union(cross.groupBy("leader", "part", "rest").applyInArrow(_star_task(percent), "u long, v long"))


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, star: int = STAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    parts = chunk_count(docs)
    chunked = in_chunks(docs, parts)
    rows = work_table(with_codes(chunked, key_counts(chunked, _chunk_keys(n), parts), _set_rows(n, percent), SET_ROW), "sets")
    first = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first"))
    sets = rows.where("tokens is not null").join(first.withColumnRenamed("first", "doc_id"), ["f1", "f2", "n", "doc_id"], "left_semi")
    # a set's name is its place in the written table: rows that share an id may hold different sets
    sets = work_table(sets.withColumn("set", F.monotonically_increasing_id()), "distinct_sets")
    roots = work_table(components(link_forest(sets.select(F.col("set").alias("doc_id"), "tokens", "from", "to"), percent, star)), "set_roots")
    tree = roots.select(F.col("u").alias("set"), "root").union(roots.select("root", "root").distinct())
    members = tree.join(sets.select("set", "f1", "f2", "n", "doc_id"), "set")
    least = members.groupBy("root").agg(F.min("doc_id").alias("component"))
    linked = members.join(least, "root").select("f1", "f2", "n", "component")
    named = first.join(linked, ["f1", "f2", "n"], "left").select("f1", "f2", "n", F.coalesce("component", "first").alias("component"))
    joined = rows.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    nameless = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).union(nameless)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {"op9_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = w.doc_id"""}
