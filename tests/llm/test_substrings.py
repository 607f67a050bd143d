"""Substring operators against brute force over all windows; the sorts and parses on planted strings."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from paydrift.llm import rlz, suffix
from paydrift.llm.chunks import count_code
from paydrift.llm.passages import Scheme, Segments, bucket_task, removed_count

from .data import WORD, documents, none, odd, rows_of, texts


def brute_words(rows, width):
    first, out = {}, {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            if d is not None and d < first.get(k, d + 1):
                first[k] = d
    for d, w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = b"\1" * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(d, []).append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def brute_bytes(rows, width):
    first, out = {}, {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - width + 1):
            k = b[i:i + width]
            if d is not None and d < first.get(k, d + 1):
                first[k] = d
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if d is not None and first[b[i:i + width]] < d:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(d, []).append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def got(frame, *columns):
    out = {}
    for r in frame.withColumn("removed", removed_count()).selectExpr("doc_id", *columns).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {d: sorted(v) for d, v in out.items()}


def test_words_on_odd_documents_and_a_whole_table(spark):
    columns = ("n", "removed", "sha2(kept, 256)")
    assert got(rlz.dedup(odd(spark)), *columns) == brute_words(texts(), 13)
    assert got(rlz.dedup(documents(spark)), *columns) == brute_words(rows_of("documents", "doc_id, text"), 13)
    assert rlz.dedup(none(spark)).count() == 0


def test_bytes_on_odd_documents_and_a_whole_table(spark):
    columns = ("n", "removed", "cast(size(spans) as bigint)", "sha2(kept, 256)")
    assert got(suffix.dedup(odd(spark)), *columns) == brute_bytes(texts(), 50)
    assert got(suffix.dedup(documents(spark)), *columns) == brute_bytes(rows_of("documents", "doc_id, text"), 50)
    assert suffix.dedup(none(spark)).count() == 0


def test_parse_finds_windows_over_factor_ends():
    method = rlz.factor(3)
    bodies = [b"a b c d", b"c d e f", b"a b c d e f", b"a b c d e f"]
    assert method(bodies, [1, 2, 3, 3]) == [0, 0, 0b1111, 0b1111]
    assert method([b"x y z", b"x y z w"], [5, 5]) == [0, 0]


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(2)
    for _ in range(120):
        width, letters = rng.choice([9, 26, 30, 50]), rng.choice(["a", "ab", "abc"])
        seed = "".join(rng.choice(letters) for _ in range(80))
        parts = []
        for _ in range(rng.randrange(2, 12)):
            s = list(seed)
            for _ in range(rng.randrange(3)):
                s[rng.randrange(80)] = rng.choice("abcz")
            parts.append("".join(s)[:rng.randrange(width, width + 30)].encode())
        text = b"".join(parts)
        starts = np.arange(len(text) - width + 1)
        order, new = suffix.order_windows(np.frombuffer(text, np.uint8), starts, width, rng.choice([8, 16, 24]))
        windows = [text[i:i + width] for i in starts[order]]
        assert windows == sorted(windows) and sorted(order) == starts.tolist()
        assert new.tolist() == [True] + [a != b for a, b in zip(windows, windows[1:])]


def test_segments_are_the_same_in_any_row_order():
    rng = random.Random(4)
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(d, " ".join(f"d{d}x{rng.randrange(99)}" for _ in range(20)) + " " + passage + " " + " ".join(f"e{d}y{i}" for i in range(20))) for d in range(12)]
    for scheme in (Scheme(13, 5, True), Scheme(50, 20, False)):
        seen = set()
        for _ in range(4):
            rng.shuffle(rows)
            docs = pa.table({"chunk": pa.array([0] * len(rows), pa.int32()), "doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
            codes = np.ones(len(scheme.keys(docs)[0]), np.uint8)
            segments = Segments(scheme, docs, pa.table({"bucket": [0], "codes": [zlib.compress(codes.tobytes())]}), 64)
            assert len(set(segments.values)) < len(segments.values)
            seen.add(tuple((segments.values[i], segments.bodies[i], segments.docs[i]) for i in segments.order))
        assert len(seen) == 1


def hot_rows():
    """A footer that a third of 240 documents hold, between words of their own; copies, repeated ids and a null id."""
    rng = random.Random(8)
    footer = " ".join(f"f{i}" for i in range(40))
    rows = [(d * 7 % 240, " ".join(f"d{d}x{rng.randrange(99)}" for _ in range(20)) + (" " + footer if d % 3 == 0 else "") + " " + " ".join(f"e{d}y{i}" for i in range(20))) for d in range(240)]
    return rows + rows[:3] + [(rows[0][0], footer), (None, footer), (-4, "same " * 300), (-3, "same " * 90 + footer)]


def test_hot_hashes_by_single_windows(spark):
    for rows in (hot_rows(), texts()):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        for hot in (2, 16):
            assert got(rlz.dedup(frame, hot=hot), "n", "removed", "sha2(kept, 256)") == brute_words(rows, 13)
            assert got(suffix.dedup(frame, hot=hot), "n", "removed", "cast(size(spans) as bigint)", "sha2(kept, 256)") == brute_bytes(rows, 50)


def test_no_bucket_holds_all_documents_of_a_passage():
    rng = random.Random(9)
    footer = " ".join(f"f{i}" for i in range(40))
    for scheme, method in ((Scheme(13, 5, True), rlz.factor(13)), (Scheme(50, 20, False), suffix.earlier_windows(50))):
        for docs in (1500, 3000):
            rows = [(d, " ".join(f"d{d}x{rng.randrange(99)}" for _ in range(12)) + " " + footer) for d in range(docs)]
            table = pa.table({"chunk": pa.array([0] * docs, pa.int32()), "doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
            keys, counts = scheme.keys(table)
            answers = pa.table({"bucket": [0], "codes": [zlib.compress(count_code(counts).tobytes())]})
            sent = Segments(scheme, table, answers, 64).sent(0)
            assert all(len(x) // 8 < 1024 for k, x in zip(sent["kind"].to_pylist(), sent["docs"].to_pylist()) if k == 1)
            back = bucket_task(method)(sent)
            assert len(back) == len(sent)
