"""The long stock beside plain sets: rows without a person or an organisation, regions that come twice, one shuffle by person and nothing written."""

import datetime
import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__  # noqa: F401  (plans load in order)
from paydrift.operators import summary as sm
from paydrift.plans import long_history as lh
from paydrift.plans.inputs import Inputs
from paydrift.plans.registry import QUERIES

REGIONS = (0, 0, 1, 2, 2, 3, 4)
HOLD = {0: "h1", 1: "h1", 2: "h2", 3: "h2", 4: None}


def history(seed):
    """Lines (month, person, region, unit, code, amount): most persons have few places, some several in one month."""
    rng, out = random.Random(seed), []
    for person in [None, *range(12)]:
        places = [(rng.choice((0, 1, 2, 3, 4, None)), rng.randrange(2)) for _ in range(rng.choice((1, 2, 3, 5)))]
        for org, unit in places:
            at = rng.choice((0, 40, 54))
            out += [(m, person, org, unit, rng.choice("AANNRX"), rng.choice((-5000, 20_000, 40_000))) for m in range(at, min(at + 29, 84)) if rng.random() < .7]
    return out


def write(spark, path, lines):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    table("region", [(r,) for r in REGIONS], "r_regionkey int")
    table("nation", [(n, n if n < 5 else None) for n in range(6)], "n_nationkey int, n_regionkey int")
    table("supplier", [(n, n) for n in range(6)], "s_suppkey long, s_nationkey int")
    table("orders", [(k, x[1]) for k, x in enumerate(lines)], "o_orderkey long, o_custkey long")
    table("lineitem", [(k, 5 if org is None else org, 1, "O" if unit else "F", code, datetime.date(1995 + m // 12, m % 12 + 1, 9), float(amt)) for k, (m, _, org, unit, code, amt) in enumerate(lines)],
          "l_orderkey long, l_suppkey long, l_partkey long, l_linestatus string, l_returnflag string, l_shipdate date, l_extendedprice double")


def states(lines):
    """(month, person, region, unit) → state, amounts, rows and payments."""
    by, out = defaultdict(list), {}
    for m, person, org, unit, code, amt in lines:
        by[m, person, org, unit].append((code, amt))
    for key, pays in by.items():
        paid = [(c, a) for c, a in pays if a > 0]
        over = sum(a for c, a in pays if c != "A") > lh.THRESHOLD
        fixed, salary = sum(a for c, a in paid if c == "X"), sum(a for c, a in paid if c in "NR")
        if paid:
            st = "P" if fixed or salary and over else "Z" if salary else "N"
            amt = fixed + salary * over
            out[key] = (st, amt if st == "P" else 0, amt, len(pays), len(paid))
    return out


def brute(lines):
    st = {k: v for k, v in states(lines).items() if k[1] is not None and any(x[1] == k[1] and x[2] is not None for x in states(lines))}
    paid, inside, person = defaultdict(dict), defaultdict(set), defaultdict(set)
    per, place, held = Counter(), Counter(), Counter()
    for (m, p, o, u), v in st.items():
        paid[p, o, u][m] = v[0]
        if o is not None:
            person[p].add(m)
        if v[0] == "P":
            inside[p, o, u].add(m)
            per[m, p] += 1
            place[m, p, o] += 1
            held[m, p, HOLD.get(o)] += REGIONS.count(o)
    out = defaultdict(Counter)
    for (m, p, o, u), (s, pf, fot, n, k) in st.items():
        mine, was = paid[p, o, u], inside[p, o, u]
        once = lambda s: not any(m - 12 <= i < m or m < i <= m + 2 for i in s)  # noqa: B023,E731
        got = Counter(any_recip=1, raw_rows=n, pf_amt=pf, fot_amt=fot, zp_out_recip=s == "Z", nonzp_recip=s == "N")
        got["flapping_recip"] = m >= 11 and sum(i in mine and i - 1 in mine and (mine[i] == "N") != (mine[i - 1] == "N") for i in range(m - 11, m + 1)) >= 3
        if s == "P":
            one, wide = place[m, p, o] == 1, HOLD.get(o) is not None and held[m, p, HOLD[o]] > place[m, p, o]
            many = per[m, p] > 1
            got += Counter(pf_recip=1, pf_fl=1 / per[m, p], single_pay_recip=k == 1, multi_recip=many)
            if o is not None:
                got += Counter(multi_same_org=many and not one, multi_same_hold=many and one and wide, multi_other=many and one and not wide)
            got += Counter(one_time_pf=once(mine), one_time_person=once(person[p]))
            got["ten_" + ("lt3" if not any(m - 12 <= i <= m - 3 for i in was) else "12p" if m - 12 in was else "3_12")] += 1
        for _ in range(max(REGIONS.count(o), 1)):
            out[m, o, u].update(got)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_stock_equals_sets(spark, tmp_path, seed):
    lines = history(seed)
    write(spark, tmp_path, lines)
    got = {(r["mi"], r["org"], r["unit"]): r for r in QUERIES["stock_long"](Inputs(spark, str(tmp_path))).collect()}
    want = brute(lines)
    assert set(got) == set(want) and sum(x["multi_same_hold"] for x in want.values()) and sum(x["multi_same_org"] for x in want.values()) and sum(x["flapping_recip"] for x in want.values())
    for key, row in got.items():
        assert row["region"] == key[1]
        assert {s: row[s] for s in sm.STOCKS} == pytest.approx({s: +want[key][s] for s in sm.STOCKS}, abs=1e-4), key


def test_stock_shuffles_lines_by_order_and_person_only(spark, tmp_path, monkeypatch):
    lines = history(3)
    write(spark, tmp_path, lines)
    monkeypatch.setattr(lh, "TASK_LINES", 50)

    def staged(self, name, build):
        raise AssertionError(f"{name} is written")

    monkeypatch.setattr(Inputs, "staged", staged)
    out = plan(QUERIES["stock_long"](Inputs(spark, str(tmp_path))))
    # lines and orders by order, lines by person, counts by cell
    assert out.count("Exchange hashpartitioning") == 4
    assert f", {len(lines) // 50 + 1}), REPARTITION_BY_NUM" in out
    assert out.count("Sort [") == 3 and "l_returnflag" not in out[:out.index("REPARTITION_BY_NUM")]


def test_histories_are_the_masks_of_triple_and_person(spark):
    st = spark.createDataFrame([(3, 1, 7, 0, "P"), (70, 1, 7, 0, "N"), (71, 1, 8, 1, "P"), (72, 1, None, 0, "P"), (None, 1, 8, 1, "N"), (5, None, 7, 0, "P"), (6, 2, None, 0, "P"), (None, 3, 7, 0, "P")],
                               "mi int, person int, org int, unit int, st string")
    rows = sm.with_histories(st, 83)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    word = lambda *ms: (sum(1 << m for m in ms if m < 60), sum(1 << m - 60 for m in ms if m >= 60))
    got = {(r["mi"], r["person"], r["org"]): (tuple(r["b_any"]), tuple(r["b_p"]), tuple(r["b_n"]), tuple(r["pr_any"])) for r in rows.collect()}
    everyone = word(3, 70, 71)
    assert got == {(3, 1, 7): (word(3, 70), word(3), word(70), everyone), (70, 1, 7): (word(3, 70), word(3), word(70), everyone), (71, 1, 8): (word(71), word(71), word(), everyone),
                   (None, 1, 8): (word(71), word(71), word(), everyone), (72, 1, None): (word(72), word(72), word(), everyone), (None, 3, 7): (word(), word(), word(), (None, None))}
    for bad in (-1, 120):
        with pytest.raises(Exception, match="period outside 0..119"):
            sm.with_histories(spark.createDataFrame([(bad, 1, None, 0, "P"), (1, 1, 7, 0, "P")], st.schema), 83).collect()
