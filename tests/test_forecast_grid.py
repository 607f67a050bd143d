"""Forecast terms and grid on planted months, against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from paydrift.operators import backtest as bt
from paydrift.operators import forecast_grid as fg
from paydrift.operators import forecast_terms as ft

# organisation: unit, region, segment, stock by month 0..7 (None: not in the books)
ORGS = {
    1: (10, 1, "a", [10, 20, 20, 10, 12, None, 8, 8]),
    2: (10, 1, "a", [None, None, 6, 6, 9, 9, 12, 12]),
    3: (20, 2, "b", [5, 5, 4, 4, 3, 3, 2, 40]),
    4: (20, 2, "a", [100, 90, 80, 80, 80, 85, 85, 85]),
}
LAST = 7


@pytest.fixture(scope="module")
def panel(spark):
    facts = spark.createDataFrame([(o, m, s) for o, (_, _, _, row) in ORGS.items() for m, s in enumerate(row) if s is not None], "org int, mi int, stock int")
    meta = spark.createDataFrame([(o, u, r, s) for o, (u, r, s, _) in ORGS.items()], "org int, unit int, region int, seg string")
    p = bt.org_panel(facts, meta, 0, LAST)
    return p.withColumns({"pipe": F.lit(4), "won": F.least("inflow", F.lit(2))})


@pytest.fixture(scope="module")
def terms(panel):
    v = ft.all_variants()
    h = ft.with_history(panel, panel.select("mi", F.col("pipe").alias("plan"), F.col("won").alias("fact")))
    wide = ft.term_columns(h, v, ["unit", "region", "seg"])
    return {(r["org"], r["mi"]): r.asDict() for r in wide.collect()}


def stock(org, mi):
    return ORGS[org][3][mi] or 0


def there(org, mi):
    return ORGS[org][3][mi] is not None


def test_terms_read_the_past_only(terms):
    names = [f"{v.family}:{v.name}" for v in ft.all_variants()]
    assert len(names) == len(set(names)) == 25 + 27 + 6
    # month 0 has no past: nothing but the plan can be expected
    assert all(terms[1, 0][n] == 0 for n in names if not n.startswith("pipe:"))


def test_changes_and_ratios_skip_months_without_a_row(terms):
    # organisation 1 before month 7: changes known at 1, 2, 3, 4; months 5 and 6 miss a neighbour
    assert terms[1, 7]["in:delta_mean_k6"] == pytest.approx((10 + 0 - 10 + 2) / 4)
    assert terms[1, 7]["in:delta_median_k6"] == pytest.approx(1.0)
    # ratios: doubled (cut to 1), level, halved, 1.2; times the base 8
    assert terms[1, 7]["in:ratio_mean_k6"] == pytest.approx((1 + 0 - 0.5 + 0.2) / 4 * 8)
    # organisation 3 falls under the least stock of a ratio at 3 → only 5→5 and 5→4 count
    assert terms[3, 7]["in:ratio_mean_k12"] == pytest.approx((0 - 0.2) / 2 * 2)


def test_rates_shrink_to_the_segment(terms):
    own = 0.0  # organisation 2 never lost anyone
    den = 6 + 6 + 9 + 9 + 12
    seg = ["a"]
    out = sum(max(stock(o, m - 1) - stock(o, m), 0) for o, r in ORGS.items() if r[2] in seg for m in range(1, 7))
    whole = sum(stock(o, m) for o, r in ORGS.items() if r[2] in seg for m in range(7))
    assert terms[2, 7]["out:rate_kall_lam0"] == own
    assert terms[2, 7]["out:rate_kall_lam5"] == pytest.approx(12 * (5 / (den + 5)) * out / whole)


def test_growth_of_levels(terms):
    def level(m):
        return sum(stock(o, m) for o, r in ORGS.items() if r[1] == 1)
    g = sum((level(t) - level(t - 1)) / level(t - 1) for t in (4, 5, 6)) / 3
    assert terms[2, 7]["in:growth_region"] == pytest.approx(max(g * 12, 0))


def test_plan_is_cut_to_what_was_realised(terms):
    won = sum(min(max(stock(o, m) - stock(o, m - 1), 0), 2) for o in ORGS for m in range(1, 7))
    assert terms[4, 7]["pipe:plan_x_past"] == pytest.approx(4 * won / (4 * 4 * 7))


# The grid reads names and flags of variants only; their sums lie in the cells.
VARIANTS = [ft.Variant("out", "none", None), ft.Variant("out", "lost", None), ft.Variant("in", "none", None), ft.Variant("in", "won", None, history=True),
            ft.Variant("in", "net", None, net=True, history=True), ft.Variant("pipe", "none", None), ft.Variant("pipe", "plan", None)]


def _cells():
    rows = []
    for m, (unit, region, seg) in itertools.product(range(5), [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 2, "b"), (5, None, None)]):
        k = (7 * m + 3 * unit) % 11
        fact = 0 if (m, unit) == (2, 3) else 50 + 5 * k - 4 * unit
        plan = None if unit == 4 else 60.0
        rows.append((region, seg, m, fact, plan, None if unit == 2 and m == 1 else 48 + k, [0.0, 3.0 + unit + (200 if (m, unit) == (3, 1) else 0)], [0.0, 2.0 + k, float(k - 4)], [0.0, 6.0]))
    return rows


def _brute(rows):
    """Errors by variant and month with plain lists."""
    outs, ins, pipes = ["none", "lost"], ["none", "won", "net"], ["none", "plan"]
    found = {}
    for o, i, p in itertools.product(range(2), range(3), range(2)):
        if (i == 2 and o) or (i and p):
            continue
        past = []
        for m in range(5):
            now = [(r[0], r[1], float(r[3]), r[4], max((r[5] or 0) - r[6][o] + r[7][i] + r[8][p], 0.0)) for r in rows if r[2] == m and r[3] > 0]

            def k(keep):
                num, den = sum(q[2] for q in past if keep(q)), sum(q[4] for q in past if keep(q))
                return min(max(num / den, 0.5), 2.0) if den > 0 else 1.0

            line = None
            if len(past) >= 10:
                n, sp, sa = len(past), sum(q[4] for q in past), sum(q[2] for q in past)
                det = n * sum(q[4] ** 2 for q in past) - sp * sp
                slope = (n * sum(q[4] * q[2] for q in past) - sp * sa) / det
                line = (slope, (sa - slope * sp) / n)
            for calib in fg.CALIBRATIONS:
                err = 0.0
                for q in now:
                    f = {"none": 1.0, "global": k(lambda _: True), "region": k(lambda z: z[0] == q[0]), "seg": k(lambda z: z[1] == q[1])}.get(calib)
                    pred = q[4] * f if f is not None else (max(line[1] + line[0] * q[4], 0.0) if line else q[4])
                    err += abs(pred - q[2])
                found["b", outs[o], ins[i], pipes[p], calib, m] = (err, sum(q[2] for q in now))
            past += now
    return found


@pytest.fixture(scope="module")
def errors(spark):
    df = spark.createDataFrame(_cells(), "region int, seg string, mi int, fact int, plan double, b int, out_terms array<double>, in_terms array<double>, pipe_terms array<double>")
    return fg.month_errors(df, VARIANTS, ["b"])


def test_grid_equals_brute_force(errors):
    want = _brute(_cells())
    got = {(*[r[c] for c in fg.VARIANT], r["mi"]): (r["err"], r["y"]) for r in errors.collect()}
    assert got.keys() == want.keys()
    for key, (err, y) in want.items():
        assert got[key] == (pytest.approx(err), pytest.approx(y)), key


def test_nobody_is_counted_twice(errors):
    kept = {tuple(r) for r in errors.select("out_term", "in_term", "pipe_term").distinct().collect()}
    assert kept == {("none", "none", "none"), ("none", "none", "plan"), ("lost", "none", "none"), ("lost", "none", "plan"), ("none", "won", "none"), ("lost", "won", "none"), ("none", "net", "none")}


def test_reports_follow_the_errors(errors):
    want = _brute(_cells())
    total = {}
    for (*v, _), (err, y) in want.items():
        e, s = total.get(tuple(v), (0.0, 0.0))
        total[tuple(v)] = (e + err, s + y)
    wape = {v: e / y for v, (e, y) in total.items()}
    best = min(wape, key=lambda v: (round(wape[v], 12), v))
    cases = {r["case"]: r for r in fg.without_terms(errors).collect()}
    assert tuple(cases["winner"][c] for c in fg.VARIANT) == best and cases["winner"]["wape"] == pytest.approx(wape[best])
    assert cases["base only"]["wape"] == pytest.approx(wape["b", "none", "none", "none", "none"])
    assert set(cases) == {"winner", "no outflow", "no inflow", "no pipeline", "no calibration", "base only"}
    honest = {r["mi"]: r for r in fg.honest_choice(errors).collect()}
    assert set(honest) == {1, 2, 3, 4}
    past = {}
    for (*v, m), (err, y) in want.items():
        if m < 4:
            e, s = past.get(tuple(v), (0.0, 0.0))
            past[tuple(v)] = (e + err, s + y)
    assert honest[4]["wape_past"] == pytest.approx(min(e / y for e, y in past.values()))
    assert honest[4]["wape"] >= honest[4]["wape_best"]


def test_empty_cells_give_empty_reports(spark):
    df = spark.createDataFrame([], "region int, seg string, mi int, fact int, plan double, b int, out_terms array<double>, in_terms array<double>, pipe_terms array<double>")
    e = fg.month_errors(df, VARIANTS, ["b"])
    assert e.isEmpty() and fg.scores(e).isEmpty() and fg.honest_choice(e).isEmpty()


def test_panel_and_terms_sort_no_months(spark, panel):
    """Months are filled in and read inside an organisation's row: no join, sort or window of the panel's size is planned."""
    def nodes(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [n for n in ("Window", "Sort ", "Generate explode") if n in plan]
    assert nodes(panel) == []
    wide = ft.term_columns(ft.with_history(panel, panel.select("mi", F.col("pipe").alias("plan"), F.col("won").alias("fact"))), ft.all_variants(), ["unit", "region", "seg"], 6)
    assert nodes(wide) == [] and {r["mi"] for r in wide.select("mi").collect()} == {6, 7}


def test_panel_keeps_repeated_and_unknown_rows(spark):
    facts = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (2, 9, 1), (None, 1, 3), (3, 1, None)], "org int, mi int, stock int")
    meta = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b"), (None, "c")], "org int, seg string")
    got = sorted(tuple(r) for r in bt.org_panel(facts, meta, 0, 2).select("org", "mi", "stock", "present", "base").collect())
    assert got == [(1, 0, 4, True, 0), (1, 0, 4, True, 4), (1, 1, 0, False, 0), (1, 1, 0, False, 4), (1, 2, 6, True, 0), (1, 2, 6, True, 6),
                   (2, 0, 0, False, 0), (2, 1, 0, False, 0), (2, 2, 0, False, 0), (3, 0, 0, False, 0), (3, 1, 0, True, 0), (3, 2, 0, False, 0)]


def test_terms_of_the_backtest_follow_the_rule(panel):
    p = panel.withColumn("unit", F.col("unit"))
    grid = bt.term_grid(p, bt.pooled_rates(p, "outflow"), bt.pooled_rates(p, "inflow"))
    rule = {(r["org"], r["mi"]): r["rule"] for r in bt.rule_forecast(p).collect()}
    got = {(r["org"], r["mi"], r["family"], r["term"]): r["value"] for r in grid.collect()}
    assert len(got) == 4 * 8 * 31
    for (org, mi), v in rule.items():
        assert got[org, mi, "out", "rule"] == pytest.approx(max(v, 0)) and got[org, mi, "in", "rule"] == pytest.approx(max(-v, 0))
    assert got[4, 3, "out", "mean_k3"] == pytest.approx(20 / 3) and got[4, 7, "in", "mean_k3"] == pytest.approx(5 / 3)


def test_repeated_rows_stand_beside_each_rule(panel):
    p = panel.unionByName(panel.where("org = 3"))
    grid = bt.term_grid(p, bt.pooled_rates(p, "outflow"), bt.pooled_rates(p, "inflow")).where("family = 'out' and term = 'rule'")
    assert {r["org"]: r["count"] for r in grid.groupBy("org").count().collect()} == {1: 8, 2: 8, 3: 32, 4: 8}
