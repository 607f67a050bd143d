"""Filter audit against applying every order to every document by hand, and against its SQL on the table."""

import collections
import itertools
import re

import __spark_entry__ as entry
from paydrift.llm import filter_audit as audit
from tests.oracle_check import compare, duck

from .data import WORD, none, odd, texts


def brute(rows, labels):
    """rows: doc_id, text, lang; labels: doc_id -> (good, toxic)."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = collections.defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        docs[lang or ""].append((fails, *labels.get(d, (False, False))))
    out = {}
    for part, all_ in docs.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = list(all_)
            for step, f in enumerate(order):
                removed = [x for x in alive if x[0][f]]
                gone = [x for x in all_ if x[0][f] and any(x[0][g] for g in order[:step])]
                alive = [x for x in alive if not x[0][f]]
                total[f] += len(removed)
                out[part, "".join(order), step + 1] = [len(alive), len(removed), len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in all_), sum(x[1] for x in removed), sum(x[2] for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(frame, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in audit.audit(frame, labels).collect()}


def test_audit_equals_brute_force(spark):
    rows = [(d, t, ("en", None, "", "de")[i % 4]) for i, (d, t) in enumerate(texts())]
    rows += [(40, "LOUD WORDS HERE", "en"), (41, "cost $5 & more", "de"), (42, "same words " * 300, "en"), (43, "same words " * 300, "xx"), (44, "É" * 30, "fr"), (45, "Éa A", "fr"), (39, "LOUD WORDS HERE", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").crossJoin(odd(spark).limit(1).drop("doc_id", "text", "lang"))
    labels = spark.createDataFrame([(40, 1, 0), (41, 0, 1), (41, 1, None), (42, None, 1), (43, 1, 1), (None, 1, 1), (16, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    known = {40: (True, False), 41: (True, True), 42: (False, True), 43: (True, True), 16: (True, False)}
    got = found(frame, labels)
    assert got == brute(rows, known) and len(got) == 600 * 5
    assert found(frame, labels.where("false")) == brute(rows, {})
    assert found(none(spark), labels) == {}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(spark, duck(sf), "op11", entry.queries()["op11_filter_audit"], entry.oracle_sql()["op11_filter_audit"], sf)
    assert ok, message


def test_orders_are_a_constant_of_the_plan(spark):
    plan = audit.audit(odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
