"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct word n-grams; its signature holds the least value of the set under ``SIGNATURE`` hash
functions. A tree of the forest is one order of the signature's places: sorted by it, sets with a long common prefix are
neighbours. The trees start with places of their own, so that two sets with a similarity of 0.8 agree on the first two
places of at least one of 32 trees but for one case in 10^14.

A region is the sets that agree on a prefix, and its depth is adaptive: exact counts of all prefixes over all sets decide,
tree by tree, for the shallowest of ``DEPTHS`` that leaves ``REGION`` sets at most. Every set of a region is a candidate of
every other. Sets of regions with the same leader (the smallest name) form a star, so that a pair which many trees find is
looked at once. In a star, neighbours of each sorted order are confirmed first, longest common prefix first, and join a
forest; only candidates that are still apart are compared after that, so a group of near copies costs one comparison a set.
All comparisons are exact, on full sets: 100 * both >= percent * either.

Copies are one set: a block of texts sends one row for each of its sets, with the ids that have it, and equal sets of all
blocks are one name. So neither copies nor near copies become pairs. A region that is larger than ``REGION`` at the greatest
depth is dealt into blocks, each with the leader; its members that are still apart then meet the other blocks, so nothing
is capped. Texts are read twice: for signatures, and for the n-grams of the sets that have candidates.

Words are separated by 0x20 and 0x09-0x0D, A-Z lowered; fewer words than n: the whole sequence is the one entry. Null or
empty texts, or texts without words, have the empty set and are linked with nothing. Texts are used whole, and a text of any
length is one set in memory. Rows with a null doc_id link with nothing and are kept, with a null component. Repeated rows are
copies; rows that repeat an id with another text are sets of their own. Of equal ids and of ties the smallest id names the
component. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import LEAST_CHUNKS, code_count, joined_codes, key_counts, with_codes
from .graph import components
from .set_join import Forest, fingerprint, required, sets_of
from .texts import BLOCK_BYTES, blocks, mix, table, work_table

WORDS, PERCENT = 4, 80
TREES, SIGNATURE = 32, 64
DEPTHS = (2, 3, 4, 6, 8)
#: Sets, and n-grams of sets, that one task compares at most.
REGION, REGION_GRAMS = 1024, 4 << 20
CHUNK_SETS = 1 << 13

_rng = np.random.default_rng(12)
FACTORS = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The places of the signature in the order of each tree; the first two are a tree's own.
ORDERS = np.array([[2 * t, 2 * t + 1, *_rng.permutation([p for p in range(SIGNATURE) if p // 2 != t])[:DEPTHS[-1] - 2]] for t in range(TREES)])
SET_ROW = "place long, n long, f1 long, f2 long, docs array<long>, nameless int, doc_id long, code long, signature binary"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 signature of each set (none of them empty)."""
    every = np.concatenate(sets)
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    for i, factor in enumerate(FACTORS):
        out[:, i] = np.minimum.reduceat(every * factor, starts) >> np.uint64(32)
    return out


def prefixes(signature: np.ndarray, depth: int) -> np.ndarray:
    """sets x trees: hash of the tree and the prefix of that depth."""
    h = np.broadcast_to(np.arange(TREES, dtype=np.uint64) * np.uint64(64) + np.uint64(depth), (len(signature), TREES)).copy()
    for j in range(depth):
        h = mix(h ^ (signature[:, ORDERS[:, j]].astype(np.uint64) + np.uint64(1) << np.uint64(16)))
    return h


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            for part, _, _ in blocks(batch, size=2 * BLOCK_BYTES):
                own: dict[tuple, list] = {}
                for (doc_id, s), code in zip(sets_of(pa.Table.from_batches([part]), n), part.column(2).to_pylist()):
                    entry = own.setdefault((len(s), *fingerprint(s)), [s, [], 0, code])
                    if doc_id is None:
                        entry[2] += 1
                    else:
                        if not entry[1]:
                            entry[3] = code
                        entry[1].append(doc_id)
                # the signature of a set goes out once a task, with the first document that has an id
                new = [name for name, (s, ids, *_) in own.items() if len(s) and ids and name not in seen]
                seen.update(new)
                signed = dict(zip(new, signatures([own[x][0] for x in new]))) if new else {}
                names = list(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(place, place + len(names)), pa.int64()), *[pa.array([x[i] for x in names], pa.int64()) for i in range(3)],
                    pa.array([own[x][1] for x in names], pa.list_(pa.int64())), pa.array([own[x][2] for x in names], pa.int32()),
                    pa.array([own[x][1][0] if x in signed else None for x in names], pa.int64()), pa.array([own[x][3] for x in names], pa.int64()),
                    pa.array([signed[x].tobytes() if x in signed else None for x in names], pa.binary())],
                    ["place", "n", "f1", "f2", "docs", "nameless", "doc_id", "code", "signature"])
                place += len(names)

    return run


def _bodies(n: int):
    """Sorted n-grams of named sets, from the texts they were taken from; each once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part, _, _ in blocks(batch):
                rows = pa.Table.from_batches([part])
                names = zip(*(rows[c].to_pylist() for c in ("n", "f1", "f2")))
                out = []
                for name, one, signature, (_, s) in zip(names, rows["set"].to_pylist(), rows["signature"].to_pylist(), sets_of(rows, n)):
                    if one not in seen and name == (len(s), *fingerprint(s)):
                        seen.add(one)
                        out.append((one, signature, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["set", "signature", "grams"])

    return run


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _levels(sets: pa.Table) -> np.ndarray:
    """depths x sets x trees: hashes of the prefixes."""
    signature = _unpacked(sets["signature"])
    return np.stack([prefixes(signature, d) for d in DEPTHS])


def _chunk_keys(sets: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_levels(sets), return_counts=True)


def _members(region: int):
    def run(sets: pa.Table, answers: pa.Table) -> pa.Table:
        levels = _levels(sets)
        keys = np.unique(levels)
        counts = code_count(joined_codes(answers, len(keys)))[np.searchsorted(keys, levels)]
        # the shallowest depth with few enough sets, else the greatest
        fits = counts <= region
        depth = np.where(fits.any(0), fits.argmax(0), len(DEPTHS) - 1)[None]
        key, company = np.take_along_axis(levels, depth, 0)[0], np.take_along_axis(counts, depth, 0)[0] > 1
        which, _ = np.nonzero(company)
        return pa.table({"key": pa.array(key[company].view(np.int64)), "set": pa.array(np.asarray(sets["set"])[which]), "n": pa.array(np.asarray(sets["n"])[which])})

    return run


def confirmed(signature: np.ndarray, sets: list[np.ndarray], group: list[int], percent: int) -> list[tuple[int, int]]:
    """Places of linked sets of different ``group``: a spanning forest of all links between candidates.

    Candidates agree on the first places of a tree. The sets are sorted arrays, from small to large.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, rank = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(rank, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(rank.max()) + 1, bool)
    forest, links = Forest(), []
    first = prefixes(signature, DEPTHS[0])

    def compare(y: int, xs: np.ndarray) -> None:
        """Confirms y with those of its candidates that are still apart from it, in rounds of growing size."""
        lo, hi = -(-percent * sizes[y] // 100), 100 * sizes[y] // percent
        xs = xs[(sizes[xs] >= lo) & (sizes[xs] <= hi)]
        mark[place[y]] = True
        at, step = 0, 1
        while at < len(xs):
            some = [x for x in xs[at:at + step].tolist() if forest.find(group[x]) != forest.find(group[y])]
            at, step = at + step, 4 * step
            for x in some:
                both = int(np.count_nonzero(mark[place[x]]))
                if 100 * both >= percent * (int(sizes[x] + sizes[y]) - both) and forest.join(group[x], group[y]):
                    links.append((x, y))
        mark[place[y]] = False

    pairs = []
    for t in range(TREES):
        order = np.lexsort(signature[:, ORDERS[t, ::-1]].T)
        ranked = signature[order][:, ORDERS[t]]
        common = (ranked[1:] == ranked[:-1]).cumprod(1).sum(1)
        near = np.flatnonzero(common >= DEPTHS[0])
        pairs.append(np.stack([common[near], np.minimum(order[near], order[near + 1]), np.maximum(order[near], order[near + 1])]))
    _, xs, ys = np.unique(np.concatenate(pairs, 1), axis=1)[:, ::-1]
    for x, y in zip(xs.tolist(), ys.tolist()):
        if forest.find(group[x]) != forest.find(group[y]):
            compare(y, np.array([x]))
    for y in range(1, m) if len({forest.find(g) for g in group}) > 1 else ():
        compare(y, np.flatnonzero((first[:y] == first[y]).any(1)))
    return links


def _star_task(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        name, raw = rows["set"].to_pylist(), rows["grams"].to_pylist()
        group, signature = rows["group"].to_pylist(), _unpacked(rows["signature"])
        order = sorted({x: i for i, x in enumerate(name)}.values(), key=lambda i: (len(raw[i]), name[i]))
        found = confirmed(signature[order], [np.frombuffer(raw[i], np.uint64) for i in order], [group[i] for i in order], percent)
        u, v = ([name[order[pair[side]]] for pair in found] for side in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _parts(region: int):
    return F.greatest(F.ceil(F.col("k") / (region - 1)), F.ceil(F.col("grams_") / REGION_GRAMS), F.lit(1)).cast("int")


def candidates(sets: DataFrame, region: int = REGION) -> DataFrame:
    """key, leader, parts, set, n: the regions with two sets or more (rows with set, n, signature)."""
    total = sets.count()
    parts = 1 << max(LEAST_CHUNKS - 1, -(-total // CHUNK_SETS) - 1).bit_length()
    chunked = sets.select(F.pmod(F.xxhash64("set"), F.lit(parts)).cast("int").alias("chunk"), "set", "n", "signature")
    postings = with_codes(chunked, key_counts(chunked, _chunk_keys, parts), _members(region), "key long, set long, n long")
    postings = work_table(postings, "regions")
    leaders = postings.groupBy("key").agg(F.min("set").alias("leader"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("grams_")).where("k > 1")
    leaders = leaders.withColumn("parts", _parts(region))
    return work_table(postings.join(leaders.select("key", "leader", "parts"), "key"), "members")


def forest_links(members: DataFrame, bodies: DataFrame, percent: int = PERCENT, region: int = REGION) -> DataFrame:
    """u, v: links between members of regions (bodies have set, signature, grams) that connect all that are linked."""
    stars = members.groupBy("leader", "set").agg(F.first("n").alias("n"))
    whole = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("grams_")).select("leader", (_parts(region) == 1).alias("whole"))
    # a star that is too large for one task falls into its regions, a region that is too large into blocks with its leader
    small = stars.join(whole.where("whole"), "leader").select(F.lit(0).alias("kind"), F.col("leader").alias("id"), F.lit(0).alias("part"), "set")
    large = members.join(whole.where("not whole"), "leader").select("key", "leader", "parts", "set")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = large.select(F.lit(1).alias("kind"), F.col("key").alias("id"), F.explode(F.when(F.col("set") == F.col("leader"), every).otherwise(F.array(F.pmod(F.xxhash64("set"), "parts").cast("int")))).alias("part"), "set")
    found = small.union(dealt).join(bodies, "set").withColumn("group", F.col("set")).groupBy("kind", "id", "part").applyInArrow(_star_task(percent), "u long, v long")
    links = work_table(found, "links")
    blocks_ = large.where("parts > 1")
    if blocks_.isEmpty():
        return links
    blocks_ = blocks_.join(components(links).withColumnRenamed("u", "set"), "set", "left").withColumn("group", F.coalesce("root", "set")).drop("root")
    main = blocks_.where("set = leader").select("key", F.col("group").alias("main"))
    blocks_ = work_table(blocks_.join(main, "key"), "large_regions")
    rest = blocks_.where("group <> main").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (region // 2)).cast("int").alias("rests"))
    half = blocks_.join(rest, "key").withColumn("parts", F.col("parts") * 2)
    there = F.pmod(F.xxhash64("set", F.lit(1)), "rests").cast("int")
    here = half.select("key", "set", "group", F.pmod(F.xxhash64("set"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"))
    again = half.where("group <> main").select("key", "set", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), there.alias("rest"))
    cross = here.union(again).distinct().join(bodies, "set")
    return links.union(cross.groupBy("key", "part", "rest").applyInArrow(_star_task(percent), "u long, v long"))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("code"))
    rows = work_table(texts.mapInArrow(_set_rows(n), SET_ROW), "forest_rows")
    place = F.when(F.col("signature").isNotNull(), F.struct("place", "doc_id", "code"))
    sets = rows.where("n > 0 and size(docs) > 0").groupBy("f1", "f2", "n").agg(F.min(place).alias("first"), F.min(F.array_min("docs")).alias("least"), F.max("signature").alias("signature"))
    sets = work_table(sets.select("f1", "f2", "n", "least", "signature", F.col("first.place").alias("set"), "first.doc_id", "first.code"), "forest_sets")
    members = candidates(sets.select("set", "n", "signature"), region)
    wanted = sets.drop("least").join(members.select("set").distinct(), "set", "left_semi")
    bodies = work_table(texts.join(wanted, ["doc_id", "code"]).mapInArrow(_bodies(n), "set long, signature binary, grams binary"), "bodies")
    roots = work_table(components(forest_links(members, bodies, percent, region)), "forest_roots")
    tree = roots.select(F.col("u").alias("set"), "root").union(roots.select("root", "root").distinct())
    least = tree.join(sets.select("set", "least"), "set").groupBy("root").agg(F.min("least").alias("component"))
    named = sets.select("f1", "f2", "n", "set", "least").join(tree.join(least, "root").select("set", "component"), "set", "left").select("f1", "f2", "n", F.coalesce("component", "least").alias("component"))
    full = rows.select("f1", "f2", "n", F.concat("docs", F.array_repeat(F.lit(None).cast("long"), F.col("nameless"))).alias("docs")).join(named, ["f1", "f2", "n"], "left")
    full = full.select(F.explode("docs").alias("doc_id"), F.col("n").alias("n_shingles"), "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_lsh_forest": op12_lsh_forest}
ORACLES = {"op12_lsh_forest": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = w.doc_id"""}
