"""Planted events with exact expected rows: movement labels, unknown values, marts, text rules, pairing."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from paydrift.functions import masks as mk
from paydrift.functions import text as tx
from paydrift.operators import anomaly as an
from paydrift.operators import feed as fd
from paydrift.operators import moves as mv
from paydrift.operators import ranking as rk
from paydrift.operators import summary as sm
from paydrift.operators import triples as tr
from paydrift.operators import watch as wa
from paydrift.operators import worklist as wl
from paydrift.operators import yoy as yo
from paydrift.sources import marts
from paydrift.sources import scans as sc


def lines(spark, rows):
    """rows: (mi, person, org, unit, code, amt); code 1 salary, 2 always counted, 9 other."""
    df = spark.createDataFrame(rows, "mi int, person long, org string, unit int, code int, amt double")
    c = F.col("code")
    return df.select("mi", "person", "org", "unit", F.lit(0).alias("region"), "code", F.col("amt").cast("decimal(18,2)").alias("amt"), F.lit(1).alias("qty"),
                     c.isin(1, 2).alias("is_pf"), c.isin(1, 2).alias("is_fot"), (c == 2).alias("is_fixed"))


def orgs(spark):
    return spark.createDataFrame([("A", "s1", "H"), ("B", "s1", "H"), ("C", "s2", None)], "org string, seg string, hold string").withColumn("focus", F.lit(False))


def labels(spark, rows, lag, last, side):
    st = tr.triple_state(tr.triples(lines(spark, rows)), 100)
    f = sm.movement_in if side == "in" else sm.movement_out
    return {(r["mi"], r["person"], r["org"]): r["lab"] for r in f(sm.triple_masks(st), st, orgs(spark), lag, last).collect()}


def test_threshold_is_exclusive_and_exempt_orgs_count(spark):
    rows = [(0, 1, "A", 1, 1, 100.0), (0, 2, "A", 1, 1, 100.01), (0, 3, "B", 1, 1, 1.0), (0, 4, "A", 1, 9, 500.0), (0, 5, "A", 1, 2, 1.0)]
    exempt = spark.createDataFrame([("B",)], "org string")
    got = {r["person"]: r["st"] for r in tr.triple_state(tr.triples(lines(spark, rows)), 100, exempt).collect()}
    assert got == {1: "Z", 2: "P", 3: "P", 4: "N", 5: "P"}


def test_org_stopped_and_other_leaving_labels(spark):
    rows = [(0, p, "A", 1, 1, 200.0) for p in (1, 2)] + [(0, 3, "C", 1, 1, 200.0), (1, 9, "C", 1, 1, 200.0), (0, 9, "C", 1, 1, 200.0)]
    rows += [(0, 5, "C", 1, 1, 200.0), (1, 5, "C", 1, 9, 200.0), (0, 6, "C", 1, 1, 200.0), (1, 6, "C", 1, 1, 50.0)]
    rows += [(0, 7, "A", 1, 1, 200.0), (1, 7, "B", 1, 1, 200.0)]
    out = labels(spark, rows, 1, 1, "out")
    assert out[(1, 1, "A")] == out[(1, 2, "A")] == "lb_org_stopped"
    assert out[(1, 3, "C")] == "lb_one_time" and out[(1, 5, "C")] == "out_to_nonzp" and out[(1, 6, "C")] == "out_zp_out"
    assert out[(1, 7, "A")] == "out_oth_same_hold"
    assert labels(spark, rows, 1, 1, "in")[(1, 7, "B")] == "in_oth_same_hold"


@pytest.mark.parametrize("gap,seasonal", [(1, True), (3, True), (4, False)])
def test_seasonal_needs_a_short_gap_a_year_ago(spark, gap, seasonal):
    hole = set(range(2, 2 + gap))
    rows = [(m, 1, "A", 1, 1, 200.0) for m in range(14) if m not in hole] + [(m, 2, "A", 1, 1, 200.0) for m in range(15)]
    lab = labels(spark, rows, 1, 14, "out")[(14, 1, "A")]
    assert (lab == "lb_seasonal") is seasonal


def test_masks_against_brute_force(spark):
    hist = [0, 3, 4, 7, 9, 20, 21, 25]
    df = spark.createDataFrame([(m,) for m in hist], "mi int").agg(mk.build_mask(F.lit(True), F.col("mi")).alias("m"))
    probes = [(lo, hi) for lo, hi in product(range(-3, 30, 4), range(-3, 30, 5))]
    row = df.select(*[mk.any_in(F.col("m"), F.lit(lo), F.lit(hi)).alias(f"x{i}") for i, (lo, hi) in enumerate(probes)]).first()
    assert [row[i] for i in range(len(probes))] == [any(lo <= m <= hi for m in hist) for lo, hi in probes]
    for lag in (1, 5):
        got = df.select(mk.bit_positions(mk.appeared(F.col("m"), lag), 29).alias("a"), mk.bit_positions(mk.vanished(F.col("m"), lag, 29), 29).alias("v")).first()
        assert got["a"] == [m for m in hist if m >= lag and m - lag not in hist]
        assert got["v"] == sorted(m + lag for m in hist if m + lag not in hist and m + lag <= 29)


def test_flow_pairs_of_sixty_people_are_one_pair(spark):
    rows = [(2, p, "A", 1, 1, 200.0) for p in range(60)] + [(3, p, "B", 2, 1, 200.0) for p in range(60)]
    st = tr.triple_state(tr.triples(lines(spark, rows)), 100)
    m = sm.triple_masks(st)
    got = sm.flow_pairs(sm.movement_out(m, st, orgs(spark), 1, 3), sm.movement_in(m, st, orgs(spark), 1, 3), 0, 10).collect()
    assert [(r["from_org"], r["to_org"], r["n_recip"]) for r in got] == [("A", "B", 60)]


def test_losing_one_of_two_jobs_is_no_person_loss(spark):
    rows = [(0, 1, "A", 1, 1, 200.0), (0, 1, "B", 1, 1, 300.0), (1, 1, "B", 1, 1, 300.0)]
    rec = tr.recipients(tr.triple_state(tr.triples(lines(spark, rows)), 100), orgs(spark))
    assert mv.lost_gained(rec, 0, 1).count() == 1 and mv.lost_gained(rec, 0, 1, ("person",)).count() == 0


def test_unknown_never_becomes_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, 3.0)], "k int, v double")
    from paydrift.functions.columns import sum_known
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(sum_known("v").alias("s")).collect()} == {1: None, 2: 3.0}


def _series(spark, values, kind="bank", key="bank"):
    rows = []
    for m, v in enumerate(values):
        prev = values[m - 1] if m else v
        d = {x: 0.0 for x in fd.MEASURES} | {"pf_recip": float(v), "pf_fl": float(v), "m_base_pf": float(prev), "m_in_from_outside": float(max(v - prev, 0)), "m_out_left_bank": float(max(prev - v, 0))}
        rows.append((kind, key, m, *[d[x] for x in fd.MEASURES], *[0 for _ in fd.MEASURES]))
    schema = "slice_type string, slice_key string, mi int, " + ", ".join(f"{x} double" for x in fd.MEASURES) + ", " + ", ".join(f"nn_{x} int" for x in fd.MEASURES)
    return spark.createDataFrame(rows, schema)


def test_feed_cancels_the_season_and_finds_the_extra_drop(spark):
    level, values = 20000, []
    for m in range(30):
        season = -1000 if m % 12 == 0 else 0
        values.append(level + season - (300 if m == 28 else 0) + (m % 3))
    s = _series(spark, values)
    found = fd.deviation_scan(fd.components(s), range(24, 30), mat_abs=50).where("length = 1 and base = 'y1'").collect()
    assert {r["mi"] for r in found} == {28, 29} and min(r["excess"] for r in found) < -290


def test_duplicate_slice_is_dropped(spark):
    v = [100 + m for m in range(5)]
    both = _series(spark, v, "segment", "s1").unionByName(_series(spark, v, "segment × industry", "s1 / x")).unionByName(_series(spark, v[::-1], "region", "1"))
    assert [(r["slice_type"], r["slice_key"]) for r in fd.duplicate_slices(both).collect()] == [("segment × industry", "s1 / x")]


def test_stories_keep_one_of_overlapping_windows(spark):
    base = {"z_real": 0.0, "real_sig": False, "this": 0.0, "base_value": 0.0, **{f"g_{g}": 0.0 for g in ("account", "disputed", "inside", "real", "unknown")}}
    rows = [("bank", "bank", 10, 1, "y1", 1, 9.0, -900.0), ("bank", "bank", 11, 3, "y1", 1, 6.0, -950.0), ("bank", "bank", 12, 1, "y1", 1, 5.0, 800.0)]
    df = spark.createDataFrame(rows, "slice_type string, slice_key string, mi int, length int, base string, base_pos int, z double, excess double")
    for k, v in base.items():
        df = df.withColumn(k, F.lit(v))
    got = fd.stories(df, _series(spark, [1, 2, 3]).select("slice_type", "slice_key", "mi", "pf_recip")).collect()
    assert sorted(r["mi"] for r in got) == [10, 12]


def test_evidence_parts_add_up_and_contributor_is_found(spark):
    cols = [*an.GROUP, "metric", "expected", "raw_rub", "confirmed", "stay_n", "n_prior"]
    rows = [("A", 1, -1, -1, -1, "fot", 1000.0, -300.0, None, 20, 30), ("A", 1, 2, -1, -1, "fot", 200.0, -250.0, None, 5, 7), ("A", 1, 3, -1, -1, "fot", 700.0, -50.0, None, 9, 12)]
    s = spark.createDataFrame(rows, "org string, unit int, income int, history int, jobs int, metric string, expected double, raw_rub double, confirmed double, stay_n long, n_prior long").select(*cols)
    top = an.top_contributor(s).collect()
    assert [(r["income"], r["c_income"], r["contribution"]) for r in top] == [(-1, 2, -250.0)]


def test_matched_moves_need_equal_amounts(spark):
    rows = [(0, 1, "A", 1, "same_org", 0, 100), (0, 1, "A", 2, "added", 100, 0), (0, 2, "A", 1, "same_org", 0, 100), (0, 2, "A", 2, "added", 90, 0)]
    e = spark.createDataFrame(rows, "period int, person long, org string, unit int, movement string, curr_rub int, prev_rub int")
    assert sorted((r["person"], r["unit"]) for r in an.matched_moves(e).collect()) == [(1, 1), (1, 2)]


def test_unit_move_inside_one_organisation(spark):
    rows = [("A", "s", 1, 1, 200.0), ("A", "s", 1, 2, -190.0), ("B", "s", 1, 1, 200.0), ("B", "s", 1, 2, -20.0)]
    c = spark.createDataFrame(rows, "org string, grp string, region int, unit int, net double")
    got = {(r["org"], r["unit"], r["side"]): r["explained"] for r in wa.unit_move_evidence(c, 100).collect()}
    assert got == {("A", 1, "lost"): 190.0, ("A", 2, "gained"): 190.0}


def test_parent_signal_is_covered_by_children(spark):
    p = spark.createDataFrame([("g", "out", 100.0), ("h", "out", 100.0)], "grp string, flow string, delta double")
    k = spark.createDataFrame([("g", "out", 50.0), ("g", "out", 30.0), ("h", "out", 30.0), ("h", "out", -80.0)], "grp string, flow string, delta double")
    assert [r["grp"] for r in wa.cover_parents(p, k, ["grp"]).collect()] == ["h"]


def test_greedy_cover_against_a_loop(spark):
    rows = [(1, s, o, float((o * 37) % 11 + 1)) for o, s in enumerate("aabbacabbcab")]
    gaps = {"a": 15.0, "b": 60.0}
    df = spark.createDataFrame([(u, s, o, v) for u, s, o, v in rows], "unit int, seg string, org long, impact double")
    g = spark.createDataFrame([(1, s, v) for s, v in gaps.items()], "unit int, seg string, gap double")
    got = {r["org"] for r in wl.greedy_cover(df, g, (1.0,), width=3.0).where("need_k > 0").collect()}
    want, lack = set(), 0.0
    for seg, gap in gaps.items():
        acc = 0.0
        for _, s, o, v in sorted((r for r in rows if r[1] == seg), key=lambda r: (-r[3], r[2])):
            if acc >= gap:
                break
            want.add(o)
            acc += v
        lack += max(0.0, gap - acc)
    acc = 0.0
    for _, s, o, v in sorted((r for r in rows if r[2] not in want), key=lambda r: (-r[3], r[2])):
        if acc >= lack:
            break
        want.add(o)
        acc += v
    assert got == want


def test_exact_median_matches(spark):
    import statistics
    vals = [((i * 7919) % 1000) / 37 for i in range(501)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "k int, v double")
    got = {r["k"]: r["median"] for r in yo.exact_median(df, ["k"], "v", 0.5).collect()}
    for k in (0, 1):
        assert got[k] == pytest.approx(statistics.median(v for i, v in enumerate(vals) if i % 2 == k))


def test_material_cover_stops_at_share(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([50, 20, 10, 10, 10])], "g string, k int, v double")
    assert sorted(r["k"] for r in rk.material_cover(df, ["g"], "v", "k", 0.6).collect()) == [0, 1]


def test_mart_replace_removes_names_that_stopped(spark, tmp_path):
    p = str(tmp_path / "m")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    marts.mart_replace_period(a, p, "2024-01", "o1")
    marts.mart_replace_period(a, p, "2024-01", "o2")
    marts.mart_replace_period(a.where("v > 5"), p, "2024-01", "o1")
    assert {(r["owner"], r["name"]) for r in marts.read_mart(spark, p).collect()} == {("o2", "x"), ("o2", "y")}
    with pytest.raises(marts.GateError):
        marts.stage_gate(a.where("v > 5"), ["name"])
    with pytest.raises(marts.GateError):
        marts.stage_gate(a.unionByName(a), ["name"])


def test_newer_run_is_not_overwritten(spark, tmp_path):
    p = str(tmp_path / "m")
    marts.mart_replace_period(spark.createDataFrame([(7,)], "run_id long"), p, "2024-01", "a")
    marts.newer_run_guard(spark, p, "2024-01", 7)
    with pytest.raises(marts.GateError):
        marts.newer_run_guard(spark, p, "2024-01", 6)


def test_collect_guard_refuses_instead_of_cutting(spark):
    assert len(sc.collect_guard(spark.range(5), 5)) == 5
    with pytest.raises(sc.TooManyRows):
        sc.collect_guard(spark.range(6), 5)


def test_discover_column(spark):
    df = spark.range(1).withColumn("Code2", F.lit(1))
    assert sc.discover_column(df, ["code", "code2"]) == "Code2"
    with pytest.raises(LookupError):
        sc.discover_column(df, ["nope"])
    assert [r["found"] for r in sc.discover_columns(df, ["id", "x"]).collect()] == [True, False]


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "fact")
    spark.range(10).select(F.col("id"), (F.col("id") % 3).cast("int").alias("mi"), F.lit(1).alias("unused")).write.partitionBy("mi").parquet(p)
    plan = sc.scan_period(spark.read.parquet(p), "mi", 1, ["id", "mi"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mi" in plan and "unused" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name,agency,level", [
    ("МБОУ СОШ № 5", "Образование", "Муниципальное"), ("ГБУЗ «ЦРБ»", "Здравоохранение", "Региональное"), ("Управление МВД", "Силовые ведомства", "Федеральное"),
    ("ООО Судоремонтный", tx.rw.UNCLASSIFIED, "Коммерция"), (None, tx.rw.UNCLASSIFIED, tx.rw.UNCLASSIFIED)])
def test_whole_word_classification(spark, name, agency, level):
    r = spark.createDataFrame([(name,)], "n string").select(tx.agency("n").alias("a"), tx.governance_level("n").alias("l")).first()
    assert (r["a"], r["l"]) == (agency, level)


def test_note_rules_and_negation(spark):
    notes = ["Сотрудники ушли в другой банк", "расширение не планируется, нет признаков банкротства", "Клиент взял паузу до осени", ""]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, n string").orderBy("i").select(tx.note_rule("n")["reason"]).collect()]
    assert got == ["Ушли в другой банк", None, "Клиент взял паузу", None]


def test_checklist_reason(spark):
    df = spark.createDataFrame([(1, "1. Контакт\nда\n2. Причина оттока\nСокращение штата"), (2, "1. Причина оттока\nиная история")], "id int, q string")
    got = {r["id"]: (r["verdict"], r["needs_review"]) for r in tx.outflow_reason(tx.questionnaire(df, ["id"], "q"), ["id"]).collect()}
    assert got == {1: ("no_point", False), 2: ("work", True)}


@pytest.mark.parametrize("text,due", [("зачисления пройдут 15.09.2026", "09.2026"), ("было 03.2026, будет в августе", "08.2026"), ("до конца 4 квартала", "12.2026"), ("15.02.2026", None)])
def test_latest_deadline(spark, text, due):
    assert spark.createDataFrame([(text,)], "t string").select(tx.latest_deadline("t", F.lit(2026), F.lit(7)).alias("d")).first()["d"] == due


def test_person_names_are_hidden(spark):
    df = tx.mask_person_names(spark.createDataFrame([("ИП Иванов",), ("ООО Ромашка",), ("Иванов Пётр Сергеевич",), (None,)], "org_name string"), ["org_name"])
    assert [tuple(r) for r in df.collect()] == [(None, True), ("ООО Ромашка", False), (None, True), (None, False)]


def test_no_python_workers_in_core_plans(spark):
    st = tr.triple_state(tr.triples(lines(spark, [(0, 1, "A", 1, 1, 200.0)])), 100)
    m = sm.triple_masks(st)
    plan = sm.movement_out(m, st, orgs(spark), 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("mi", [60, 64, -1])
def test_periods_without_a_bit_stop_the_job(spark, mi):
    df = spark.createDataFrame([(1, 0), (1, mi)], "k int, mi int")
    assert df.where("mi = 0").groupBy("k").agg(mk.build_mask(F.lit(True), F.col("mi")).alias("m")).first()["m"] == 1
    with pytest.raises(Exception, match="period outside"):
        df.groupBy("k").agg(mk.build_mask(F.lit(True), F.col("mi"))).collect()
    assert df.groupBy("k").agg(mk.build_mask(F.col("mi") == 0, F.col("mi")).alias("m")).first()["m"] == 1


def test_leaks_of_names_of_any_length(spark):
    names = [(" ".join(f"n{k}x{i}" for i in range(k)),) for k in range(1, 131)]
    texts = spark.createDataFrame([(1, "; ".join(n for n, in names)), (2, "nothing here"), (3, None)], "id int, t string")
    book = spark.createDataFrame(names, "name string")
    assert tx.leak_check(texts, "t", "id", book).where("id = 1").count() == 130
    assert tx.leak_check(texts, "t", "id", book.where("false")).count() == 0


def test_failed_write_keeps_the_period(spark, tmp_path):
    p = str(tmp_path / "mart")
    a = spark.createDataFrame([("x", 1), ("y", 9)], "name string, v int")
    marts.mart_replace_period(a, p, "2024-01", "o1")
    with pytest.raises(Exception, match="broken"):
        marts.mart_replace_period(a.withColumn("v", F.when(F.col("v") > 5, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("v"))), p, "2024-01", "o1")
    assert marts.read_mart(spark, p).count() == 2
    marts.mart_replace_period(a.where("false"), p, "2024-01", "o1")
    assert marts.read_mart(spark, p).count() == 0


def test_parents_covered_by_children_are_dropped(spark):
    parents = spark.createDataFrame([("a", "f", -10.0), ("b", "f", -10.0), ("c", "f", 10.0)], "grp string, flow string, delta double")
    kids = spark.createDataFrame([("a", "f", -8.0), ("b", "f", -3.0), ("b", "f", 9.0), ("c", "f", -9.0)], "grp string, flow string, delta double")
    assert {r["grp"] for r in wa.cover_parents(parents, kids, ["grp"]).collect()} == {"b", "c"}
