"""Decontamination of repetitive texts: seed hits equal to all pairs of places, spans as laid side by side, any number of blocks."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from paydrift.llm import decontam
from paydrift.llm.texts import column_bytes

from .data import none, odd


def words_of(texts):
    return decontam.tokens(*column_bytes(pa.array(texts, pa.large_string())))


def all_pairs(index, w):
    """(document, item, shift) of every pair of equal windows, pair by pair."""
    out, doc = set(), w.doc_of()
    short = sorted({int(x) for x in index.bounds[1:] - index.bounds[:-1] if 0 < x < len(decontam.MASKS[0])})
    for mask, salt in [(m, s) for s, m in enumerate(decontam.MASKS)] + [("1" * n, 100 + n) for n in short]:
        places: dict[int, list[int]] = {}
        for q, key in enumerate(decontam.seed_keys(index.hashes, mask, salt).tolist()):
            a, b = index.bounds[index.item[q]], index.bounds[index.item[q] + 1]
            if b - q >= len(mask) and (salt < 100 or b - a == len(mask)):
                places.setdefault(key, []).append(q)
        for p, key in enumerate(decontam.seed_keys(w.hashes, mask, salt).tolist()):
            if doc[p] == doc[p + len(mask) - 1]:
                out |= {(int(doc[p]), int(index.item[q]), p - q) for q in places.get(key, ())}
    return out


def repetitive(rng):
    words = [f"w{i}" for i in range(rng.choice([1, 2, 3, 30]))]
    if rng.random() < .3:
        return " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
    text = [rng.choice(words) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
    for _ in range(rng.randrange(3)):
        text[rng.randrange(len(text))] = "x"
    return " ".join(text)


def test_hits_equal_all_pairs_of_places():
    rng = random.Random(1)
    for _ in range(60):
        index, w = decontam.Index(list(range(5)), [repetitive(rng) for _ in range(5)], decontam.MASKS), words_of([repetitive(rng) for _ in range(6)])
        assert index.hits(w.hashes, w.doc_of()) == all_pairs(index, w)


def test_repetitive_text_and_item_cost_their_shifts():
    for line, shifts in (("same", 5981), ("one line of seven words each time", 855)):
        words = line.split()
        index, w = decontam.Index([1], [" ".join((words * 2000)[:2000])], decontam.MASKS), words_of([" ".join((words * 4000)[:4000])])
        start = time.process_time()
        runs = decontam._runs(index, w)
        assert time.process_time() - start < 10 and len(runs[0]) == shifts
        # shorter texts by hand: every shift with ten equal tokens is one span
    index, w = decontam.Index([1], [" ".join(["same"] * 30)], decontam.MASKS), words_of([" ".join(["same"] * 50)])
    want = {(max(0, s), min(50, 30 + s), 1) for s in range(-20, 41)}
    assert set(decontam._runs(index, w)[0]) == want


def test_blocks_give_the_same_on_odd_documents(spark):
    texts = ["same " * 200, "one two three", "dup line here now", "a different item of more words than any mask has in all"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    frame = odd(spark).withColumn(decontam.ROW, F.lit("mine"))
    whole = None
    for block in (20_000, 2, 1):
        found = sorted(map(str, decontam.contamination(frame, bench, block_items=block).collect()))
        kept = decontam.clean(frame, bench, block_items=block)
        assert kept.columns == frame.columns and {r[0] for r in kept.select(decontam.ROW).distinct().collect()} == {"mine"}
        got = (found, sorted(map(str, kept.select("doc_id", "text").collect())))
        whole = whole or got
        assert got == whole
    assert decontam.clean(none(spark), bench, block_items=1).count() == 0
