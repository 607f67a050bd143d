"""Rules, classifier, personal data, joins, decontamination and the pipeline on odd documents and small tables."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from paydrift.llm import decontam, graph, native_rules, pii, quality_qda, set_join
from paydrift.llm.texts import table

from .data import SMALL, WORD, documents, none, odd, rows_of, texts


# ------------------------------------------------------------------ 3: rules
def brute_rules(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    mark = bytearray(len(w))
    for i in range(len(w) - 7):
        if counts[tuple(w[i:i + 8])] > 1:
            mark[i:i + 8] = b"\1" * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(mark), len(w) < 20 or 100 * sum(mark) > 30 * len(w)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_equal_brute_force(spark):
    trusted = spark.createDataFrame([(7,), (7,), (None,)], "doc_id long")
    for frame, rows in ((odd(spark), texts()), (documents(spark), rows_of("documents", "doc_id, text"))):
        found = native_rules.rules(frame, trusted).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in found) == sorted((str(d), *brute_rules(t)) for d, t in rows)
        assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= native_rules.LEAST_RATIO) for r in found)
    assert native_rules.rules(none(spark), trusted).count() == 0
    assert native_rules.rules(odd(spark), trusted.where("false")).count() == len(texts())


def test_repeats_around_the_window(spark):
    rng = random.Random(5)
    rows = []
    for n in (3, 4, 7, 8, 9, 12):  # stretches that stand twice: shorter than a window, as long, longer, overlapping
        part = [f"w{i}" for i in range(n)]
        rows += [" ".join(part * 2), " ".join([*part, "x", *part]), " ".join([*part, *(f"y{i}" for i in range(30)), *part]), " ".join(part[:1] * (n + 1))]
    rows += [rng.choice(" \t\n\x0b").join(rng.choice("abc|é") for _ in range(rng.randrange(60))) + rng.choice(["", " ", "\n"]) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(rows)]
    found = native_rules.with_base(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], *(r[c] for c in COLUMNS[:-1])) for r in found) == [(i, *brute_rules(t)[:-1]) for i, t in rows]


def test_rules_work_out_words_once(spark):
    found = native_rules.rules(documents(spark), spark.createDataFrame([(7,)], "doc_id long"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove(split(") == 1
    assert "xxhash64(slice(" not in plan and "translate(" not in plan and " AS ratios" not in plan.split("aggregate(")[0]


def test_ratio_tells_symbols_from_prose(spark):
    sf = "/root/testdata/sf0.01"
    found = entry.queries()["op3_quality_rules"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 8 * n.get((0, True), 0)


# ------------------------------------------------------------------ 8: classifier
def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op8_quality_classifier"](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_classifier_odd_cases(spark):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, 1), (12, 0), (14, 0), (15, 0), (13, 1), (99, 1), (None, 1), (2, None)], "doc_id long, quality int")
    for lab in (labels, labels.where("quality = 1"), labels.where("false")):
        found = quality_qda.classify(spark, odd(spark), lab).collect()
        assert len(found) == len(texts()) and all(r["score"] is not None and 0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
        assert quality_qda.accepted(odd(spark), lab).columns == odd(spark).columns
    assert quality_qda.classify(spark, none(spark), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    labels = table(spark, SMALL, "labels")
    first = {r["doc_id"]: r["score"] for r in quality_qda.classify(spark, documents(spark), labels).collect()}
    turned = labels.withColumn("quality", F.when(quality_qda.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_qda.classify(spark, documents(spark), turned).collect()}
    assert first.keys() == again.keys() and all(abs(first[d] - again[d]) < 1e-9 for d in first)


# ------------------------------------------------------------------ 6: personal data
def brute_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = pii.only_digits(m.group())
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255) or (kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(spark):
    import random
    rng = random.Random(3)
    for _ in range(8000):
        s = "".join(rng.choice("a@..-1234 +()@%x\né") for _ in range(rng.randrange(40)))
        assert pii.base_spans(s) == brute_spans(s), s
    for _, t in rows_of("documents", "doc_id, text", "/root/testdata/sf0.01"):
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("1" * 200_000 + "@" * 50_000 + "a" * 100_000) == []


def test_found_spans_and_redaction(spark):
    rows = [(1, "mail a.b@c.example.org and é +1 (212) 555-0188, card 4111 1111 1111 1111 at 10.0.0.1"), (2, None), (3, ""), (4, "no numbers"), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii_spans", F.lit("own"))
    detector = pii.train(documents(spark, "/root/testdata/sf0.01"))
    found = {r["doc_id"]: r for r in pii.digests(pii.find(frame, detector)).collect()}
    assert [found[1][f"n_{k}"] for k in pii.KINDS[:4]] == [1, 1, 1, 1]
    assert [(s.split(":")[0]) for s in found[1]["spans"].split(",")] == ["email", "phone", "card", "ip"]
    assert found[2]["spans"] == found[3]["spans"] == found[4]["spans"] == "" and found[5]["spans"] == "secret:9:49"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame, detector).collect()}
    assert clean[1] == "mail [EMAIL] and é [PHONE], card [CARD] at [IP]" and clean[2] is None and clean[5] == 'token = "[SECRET]"'
    nothing = pii.train(none(spark))
    assert pii.find(none(spark), nothing).count() == 0
    assert {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(frame, nothing)).collect()}[1] == found[1]["spans"]
    assert pii.find(odd(spark), detector).count() == len(texts())


def test_training_reads_every_document(spark):
    """Keys stand only in documents that a sample of 4,000 by hash of the id leaves out."""
    import hashlib
    n = 9000
    key = F.udf(lambda i: hashlib.sha1(str(i).encode()).hexdigest())
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) >= (1 << 30) // 2
    docs = spark.range(0, n, 1, 4).withColumnRenamed("id", "doc_id").withColumn("text", F.when(left_out & (F.col("doc_id") % 2 == 0), F.concat(F.lit('token = "'), key("doc_id"), F.lit('"')))
                                                                               .when(left_out, F.concat(F.lit("see "), key("doc_id"))).otherwise("nothing here"))
    detector = pii.train(docs)
    kept = docs.where("doc_id < 600 and length(text) > 20")
    for r in pii.digests(pii.find(kept, detector)).join(kept, "doc_id").collect():
        assert ("secret" in r["spans"]) == r["text"].startswith("token"), r


def test_trees_over_a_table_are_those_in_memory(spark):
    import numpy as np
    docs = documents(spark, "/root/testdata/sf0.001").where("text is not null")
    found = pii.examples(docs).localCheckpoint()
    x, y, _, held = (np.concatenate(v) for v in zip(*pii._unpacked(found.toArrow().to_batches())))
    edges = pii.quantile_edges(found)
    one, two = pii.fitted(pii.distinct_examples(found, edges), edges, rounds=2), pii.boost(x[held == 0], y[held == 0].astype(float), rounds=2)
    assert len(y) and np.array_equal(one.feature, two.feature) and np.array_equal(one.cut, two.cut) and np.allclose(one.margin(x), two.margin(x))


def test_long_keys_are_proposed_whole():
    for n in (16, 128, 129, 700, 100_000):
        text = 'token = "' + ("a1B2c3D4" * n)[:n] + '"'
        assert ("secret", 9, 9 + n) in pii.candidates(text, [], True)


def test_boosted_trees_learn_and_repeat():
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    one, two = pii.boost(x, y), pii.boost(x, y)
    assert ((one.probability(x) > 0.5) == (y == 1)).mean() > 0.95 and np.array_equal(one.margin(x), two.margin(x))
    assert np.allclose(pii.boost(x, np.zeros(600)).probability(x), 0.001)


# ------------------------------------------------------------------ 9: Jaccard join
def brute_classes(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = collections.defaultdict(list)
    for d in sorted(sets):
        both = collections.Counter(o for k in sets[d] for o in index[k])
        for o, n in both.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(o), find(d)
                up[max(a, b)] = min(a, b)
        for k in sets[d]:
            index[k].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_classes_equal_brute_force(spark):
    rows = [r for r in texts() if r[0] is not None]
    found = set_join.classes(odd(spark)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == brute_classes(rows)
    assert len(found) == len(texts()) and all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert set_join.classes(none(spark)).count() == 0


@pytest.mark.parametrize("star", [1024, 8])
def test_near_copies_in_one_star_and_in_blocks(spark, star):
    import random
    rng = random.Random(5)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(160)] = f"e{rng.randrange(40)}"
        rows.append((d * 3 % 90 + d // 30, " ".join(w)))
    rows += [(200 + i, " ".join(f"x{i} y{k}" for k in range(30))) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.classes(frame, star=star).collect()} == brute_classes(rows)


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r["u"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ 10: decontamination
def test_overlaps_with_substitutions_and_short_items(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today".split()
    changed = list(item)
    changed[4], changed[11] = "leaps", "wide"
    docs = [(1, "Intro words here. " + " ".join(item).upper() + "! more words after"), (2, " ".join(changed)), (3, "the quick brown cat sat down and slept for a very long time in the sun"), (4, None), (5, ""),
            (6, "x short item here x"), (7, " ".join(item[:6])), (1, "a repeated row without it")]
    items = [(10, " ".join(item)), (11, "short item here"), (12, ""), (13, None), (None, "x"), (14, "!!! ..."), (10, " ".join(item))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1, 2, 20_000):
        found = decontam.contamination(frame, bench, block_items=block).groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"), F.max("n_contaminated").alias("n"))
        got = {r["doc_id"]: (r["i"], r["n"]) for r in found.collect()}
        assert got == {1: ([10], 15), 2: ([10], 15), 3: ([], 0), 4: ([], 0), 5: ([], 0), 6: ([11], 3), 7: ([], 0)}
        assert sorted(r["doc_id"] for r in decontam.clean(frame, bench, block_items=block).collect()) == [1, 3, 4, 5, 7]
    assert decontam.contamination(frame, bench.where("false")).where("n_items > 0").count() == 0
    assert decontam.contamination(none(spark), bench).count() == 0
    assert decontam.clean(odd(spark), bench).columns == odd(spark).columns


def test_every_run_at_a_shift_counts(spark):
    item = [f"t{i}" for i in range(60)]

    def doc(n, *changed):
        return " ".join(f"c{i}" if i in changed else item[i] for i in range(n))

    # short run first; a hole of 15; a run of 70 % whose first part passes; each fourth token changed
    docs = [(1, doc(27, 9, 10, 11, 12, 17, 22)), (2, doc(53, *range(20, 35))), (3, doc(60, *range(20, 60, 2))), (4, doc(40, *range(3, 40, 4))), (5, doc(13, 5, 6, 7)), (6, doc(9))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: (r["n_contaminated"], r["spans"]) for r in decontam.contamination(frame, bench).collect()}
    assert found[1] == (14, "1:13:27") and found[2] == (38, "1:0:20,1:35:53") and found[3][0] >= 20 and found[4] == (39, "1:0:39") and found[5] == (13, "1:0:13") and found[6] == (0, "")
    assert [r["doc_id"] for r in decontam.clean(frame, bench).collect()] == [6]


def test_overlaps_are_found_whenever_a_stretch_meets_both_limits():
    import random
    import numpy as np
    rng = random.Random(6)
    for _ in range(400):
        same = np.array([rng.random() < rng.choice([0.6, 0.8]) for _ in range(rng.randrange(1, 45))])
        good = {(a, z) for a in range(len(same)) for z in range(a + 1, len(same) + 1) if same[a] and same[z - 1] and same[a:z].sum() >= 10 and same[a:z].sum() >= 0.75 * (z - a)}
        every, found = decontam.stretches(same, 10), decontam.agreeing(same, 10)
        assert {i for a, z in every for i in range(a, z)} == {i for a, z in good for i in range(a, z)}
        assert bool(found) == bool(good)
        for a, z in good:
            # one of the masks hits inside
            assert any(all(same[i + k] or m[k] == "0" for k in range(len(m))) for m in decontam.MASKS for i in range(a, z - len(m) + 1))


def test_rows_stay_rows_at_any_number_of_blocks(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    docs = [(None, one), (None, "nothing here"), (None, f"{two} and {one}"), (1, one), (1, two), (1, two), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, one), (2, two), (3, "some other item of a few more words than the masks have")], "item_id long, text string")

    def got(block):
        return sorted(map(str, decontam.contamination(frame, bench, block_items=block).collect()))

    assert len(got(20_000)) == len(docs) and got(1) == got(2) == got(20_000)


def test_blocks_end_by_tokens_too(spark, monkeypatch):
    import pickle
    texts_of = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 12), ("b", 12), ("c", 40), ("d", 12))]
    bench = spark.createDataFrame(list(enumerate(texts_of)), "item_id long, text string")
    assert [[r["item_id"] for r in b] for b in decontam.item_blocks(bench, most=30)] == [[0, 1], [2], [3]]
    index = decontam.Index([0], [" ".join(f"a{i}" for i in range(2000))], decontam.MASKS)
    assert len(pickle.dumps(index)) < 40_000
    docs = spark.createDataFrame([(None, texts_of[3]), (1, "clean"), (1, texts_of[2]), (None, None)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 30)
    assert sorted(map(str, decontam.clean(docs, bench).collect())) == sorted(map(str, docs.where("text = 'clean' or text is null").collect()))
    assert sorted(r["n_contaminated"] for r in decontam.contamination(docs, bench).collect()) == [0, 0, 12, 40]


def test_every_leaked_item_is_found(spark):
    sf = "/root/testdata/sf0.01"
    items = rows_of("benchmark", "item_id, text", sf)
    leaked = {d for d, t in rows_of("documents", "doc_id, text", sf) if any(x in t for _, x in items)}
    found = {r["doc_id"] for r in entry.queries()["op10_decontamination"](spark, sf).where("n_items > 0").collect()}
    assert leaked and leaked <= found and len(found - leaked) <= 0.01 * 1000


def test_masks_cover_every_place():
    assert all(any(m[i] == "0" for m in decontam.MASKS) for i in range(len(decontam.MASKS[0])))


# ------------------------------------------------------------------ the pipeline
def test_pipeline_follows_its_stages(spark):
    docs = table(spark, SMALL, "documents")
    kept, texts_of = [], {d: t for d, t in rows_of("documents", "doc_id, text")}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        columns = docs.columns
        docs = stage(spark, docs, SMALL).cache()
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            classes = brute_classes(list(before.items()))
            assert after == {d for d, (_, c) in classes.items() if c == d}
        if name == "benchmark_decontamination":
            items = [x for _, x in rows_of("benchmark", "item_id, text")]
            assert not any(x in before[d] for d in after for x in items)
        if name == "personal_data":
            assert after == set(before) and not any(pii.base_spans(r["text"]) for r in docs.collect())
        kept.append(len(after))
    assert docs.where("not round_trip").count() == 0 and docs.count() == kept[-1] > 0.6 * len(texts_of)
    again = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in docs.collect()}


def test_stages_take_odd_and_empty_tables(spark):
    for frame in (odd(spark), none(spark)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        rows = docs.collect()
        assert all(r["round_trip"] for r in rows)


def test_registered_once_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
