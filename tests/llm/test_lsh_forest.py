"""LSH forest against all pairs by hand, with regions and blocks of every size, and against its SQL on the table."""

import itertools
import random

import numpy as np

import __spark_entry__ as entry
from paydrift.llm import lsh_forest as forest
from tests.oracle_check import compare, duck

from .data import WORD, none, odd, texts


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations([k for k, (d, _) in enumerate(rows) if d is not None], 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[find(j)] = find(i)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    out = []
    for k, (d, _) in enumerate(rows):
        c = None if d is None else least[find(k)] if sets[k] else d
        out.append((str(d), len(sets[k]), str(c), d is None or d == c))
    return sorted(out)


def found(frame, **how):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in forest.near_duplicates(frame, **how).collect())


def near(rng, words, n, size=60):
    """n texts around one, each a few words away from it or from one another."""
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(rng.choice(out) if out and rng.random() < .5 else base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(w)
    return [" ".join(w) for w in out]


def test_odd_documents(spark):
    assert found(odd(spark)) == brute(texts())
    assert found(none(spark)) == []


def test_groups_in_regions_and_blocks_of_every_size(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    docs = [t for n in (2, 3, 40, 90) for t in near(rng, words, n)] + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(60)]
    docs += [docs[0]] * 30 + [t.upper() for t in docs[:5]]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    rows = list(zip(ids, docs)) + [(3, docs[50]), (3, docs[60]), (None, docs[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    for region in (forest.REGION, 20, 4):
        assert found(frame, region=region) == want, region


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    rng = random.Random(2)
    a, b = ([f"{x}{rng.randrange(9999)}" for _ in range(60)] for x in "ab")
    a2, b2 = (x[:-1] + ["other"] for x in (a, b))
    rows = [(1, a), (1, b), (2, a2), (3, b2)]
    for order in itertools.permutations(rows):
        frame = spark.createDataFrame([(d, " ".join(w)) for d, w in order], "doc_id long, text string").coalesce(1)
        assert found(frame) == [("1", 57, "1", True), ("1", 57, "1", True), ("2", 57, "1", False), ("3", 57, "1", False)]
        if order[0] != rows[0]:
            break


def test_confirmed_equals_all_pairs():
    rng = np.random.default_rng(3)
    for trial in range(20):
        sets = []
        for _ in range(6):
            base = rng.integers(1, 1 << 60, 40, dtype=np.uint64)
            for _ in range(rng.integers(1, 6)):
                s = base.copy()
                s[:rng.integers(0, 9)] = rng.integers(1, 1 << 60, 1, dtype=np.uint64)
                sets.append(np.unique(s))
        sets.sort(key=len)
        links = forest.confirmed(forest.signatures(sets), sets, list(range(len(sets))), 80)
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(j)] = find(i)
        mine = forest.Forest()
        for i, j in links:
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and mine.join(i, j)
        assert all((mine.find(i) == mine.find(j)) == (find(i) == find(j)) for i, j in itertools.combinations(range(len(sets)), 2)), trial


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(spark, duck(sf), "op12", entry.queries()["op12_lsh_forest"], entry.oracle_sql()["op12_lsh_forest"], sf)
    assert ok, message


def test_jaccard_join_loses_no_link_of_repeated_ids(spark):
    from paydrift.llm import set_join
    rng = random.Random(2)
    a, b = ([f"{x}{rng.randrange(9999)}" for _ in range(60)] for x in "ab")
    a2, b2 = (x[:-1] + ["other"] for x in (a, b))
    rows = [(1, a), (1, b), (2, a2), (3, b2)]
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[2], rows[3]]):
        frame = spark.createDataFrame([(d, " ".join(w)) for d, w in order], "doc_id long, text string").coalesce(1)
        got = sorted((r["doc_id"], r["component_id"]) for r in set_join.classes(frame).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]
