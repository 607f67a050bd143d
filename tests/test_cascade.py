"""Planted events for the watch's cascade: scopes, cover, moves between units, labels, levels."""

import pytest
from pyspark.sql import functions as F

from paydrift.operators import cascade as cs

MONTHS, NOW = range(20), 19
FLOWS = tuple(cs.FLOWS)
REGIONS = range(1, 17)
CELLS = [("s", tb, 100 * tb + k) for tb in REGIONS for k in range(2)]


def world():
    """Sixteen regions of two units; organisation 1 lies in both units of region 1, each other one in the first unit of its region."""
    atoms = {(c, t): dict(base=50_000, raw_rows=70_000, temp_left=0, single_pay=0, stopped=0, **dict.fromkeys(FLOWS, 200)) for c in CELLS for t in MONTHS}
    orgs = {}
    for t in MONTHS:
        for tb in REGIONS:
            for k, share in ((0, .6), (1, .4)) if tb == 1 else ((0, 1),):
                orgs[tb, ("s", tb, 100 * tb + k), t] = dict(base=20_000 * share, raw_rows=28_000 * share, temp_left=0, single_pay=0, stopped=0, **dict.fromkeys(FLOWS, 20 * share))
    return atoms, orgs


def add(atoms, orgs, org, cell, t, **more):
    """A change of an organisation's cell, which the atom shows too."""
    row = orgs.setdefault((org, cell, t), dict(base=0, raw_rows=0, temp_left=0, single_pay=0, stopped=0, **dict.fromkeys(FLOWS, 0)))
    for c, n in more.items():
        row[c] += n
        atoms[cell, t][c] += n


COLUMNS = ("base", "raw_rows", "temp_left", "single_pay", "stopped", *FLOWS)
CELL_TYPE = "seg string, region int, unit int, mi int, " + ", ".join(f"{c} double" for c in COLUMNS)


def frames(spark, atoms, orgs):
    a = spark.createDataFrame([(*c, t, *[float(r[x]) for x in COLUMNS]) for (c, t), r in atoms.items()], CELL_TYPE)
    o = spark.createDataFrame([(org, *c, t, *[float(r[x]) for x in COLUMNS]) for (org, c, t), r in orgs.items()], "org int, " + CELL_TYPE)
    return a, o, spark.createDataFrame([(tb, "s", tb) for tb in REGIONS], "org int, grp string, region int")


def cascade(spark, atoms, orgs, **limits):
    return cs.Cascade(*frames(spark, atoms, orgs), NOW, **limits)


def shown(x):
    return [tuple(r) for r in x.select("key", "flow", "d", "label").collect()]


# ------------------------------------------------------------------ scopes and cover
SIGNAL = "level string, key string, flow string, d double, score double, floor double, label string, seg string, region int, unit int, was_seg string, was_region int, was_unit int, returns boolean"


def signal(level, key, flow, d, cell=(None, None, None), score=0.0, floor=100.0, was=None, returns=False):
    return (level, key, flow, float(d), float(score), float(floor), None, *cell, *(was or cell), returns)


def covered(spark, level, parent, cards, moves=(), scopes=()):
    p = spark.createDataFrame([parent], SIGNAL).select("level", "key", "flow", "d", "score", "floor", "seg", "region", "unit")
    m = spark.createDataFrame(list(moves), "org int, seg string, region int, unit int, flow string, matched double, explained double")
    s = spark.createDataFrame(list(scopes), "org int, seg string, region int, unit int, was_seg string, was_region int, was_unit int, returns boolean")
    return cs.with_cover(p, level, spark.createDataFrame(cards, SIGNAL), m, s).first()["covered"]


def test_a_split_organisation_lies_only_in_its_region(spark):
    _, orgs, _ = frames(spark, *world())
    scopes = {r["org"]: (r["seg"], r["region"], r["unit"]) for r in cs.org_scopes(orgs, NOW).collect()}
    assert scopes[1] == ("s", 1, None) and scopes[2] == ("s", 2, 200)
    card = [signal("org", "1", "out_other", 10_000, ("s", 1, None))]
    assert not covered(spark, "atom", signal("atom", "a", "out_other", 4500, ("s", 1, 100)), card)
    assert not covered(spark, "unit", signal("unit", "100", "out_other", 4500, (None, 1, 100)), card)
    assert covered(spark, "region", signal("region", "1", "out_other", 10_000, (None, 1, None)), card)


def test_cover_needs_the_same_direction_and_a_known_scope(spark):
    here = ("s", 2, 200)
    assert covered(spark, "atom", signal("atom", "a", "out_other", 1100, here), [signal("org", "2", "out_other", 1000, here)])
    assert not covered(spark, "atom", signal("atom", "a", "out_other", -1100, here), [signal("org", "2", "out_other", 1000, here)])
    assert not covered(spark, "atom", signal("atom", "a", "out_other", 1100, here), [signal("org", "2", "out_other", 1000)])


def test_overlapping_levels_and_repeated_keys_are_not_added(spark):
    here, parent = ("s", 2, 200), signal("region", "2", "out_other", 1000, (None, 2, None))
    assert not covered(spark, "region", parent, [signal("org", "2", "out_other", 400, here), signal("atom", "a", "out_other", 400, here)])
    assert not covered(spark, "region", parent, [signal("org", "2", "out_other", 400, here)] * 2)
    # organisations and the rest are disjoint, and so are two organisations
    assert covered(spark, "region", parent, [signal("org", "2", "out_other", 400, here), signal("rest", "a", "out_other", 400, here)])
    assert covered(spark, "region", parent, [signal("org", "2", "out_other", 400, here), signal("org", "3", "out_other", 400, here)])


def test_a_material_remainder_keeps_the_parent(spark):
    here, card = ("s", 2, 200), [signal("org", "2", "out_other", 11_000, ("s", 2, 200))]
    assert not covered(spark, "atom", signal("atom", "a", "out_other", 15_000, here, score=14_000), card)
    assert covered(spark, "atom", signal("atom", "a", "out_other", 11_500, here, score=10_500), card)


def test_returns_need_the_scope_of_the_month_before(spark):
    here, parent = ("s", 2, 200), signal("atom", "a", "in_new", 1000, ("s", 2, 200))
    assert not covered(spark, "atom", parent, [signal("org", "2", "in_new", 1000, here, was=("s", 2, 201), returns=True)])
    assert covered(spark, "atom", parent, [signal("org", "2", "in_new", 1000, here, was=("s", 2, 201))])
    assert covered(spark, "atom", signal("atom", "a", "out_other", 1000, here), [signal("org", "2", "out_other", 1000, here, was=("s", 2, 201), returns=True)])


# ------------------------------------------------------------------ moves between units
def moves(spark, orgs, **how):
    return {(r["org"], r["unit"], r["flow"]): (r["matched"], r["explained"]) for r in cs.unit_moves(frames(spark, world()[0], orgs)[1], NOW, **how).collect()}


def greedy(out, into):
    """Sorted lists paired by hand: unit pairs and their amounts."""
    pairs, left = [], dict(into)
    for a, n in sorted(out.items(), key=lambda x: (-x[1], x[0])):
        for b in sorted(into, key=lambda x: (-into[x], x)):
            k = min(n, left[b])
            if k > 0:
                pairs.append((a, b, k))
                n, left[b] = n - k, left[b] - k
    return pairs


def test_moves_are_paired_greedily_and_widened_by_the_other_cell(spark):
    atoms, orgs = world()
    out, into = {300: 5000, 302: 2500, 304: 700}, {301: 4200, 303: 2600, 305: 900}
    for unit, n in {**out, **into}.items():
        for t in MONTHS:
            atoms.setdefault((("s", 3, unit), t), dict.fromkeys(COLUMNS, 0))
            add(atoms, orgs, 3, ("s", 3, unit), t, base=1000)
        add(atoms, orgs, 3, ("s", 3, unit), NOW, **{"out_other" if unit in out else "in_other": n})
    # noise of the first source: 4 * (spread of its past), the others are quiet
    for t in range(NOW - 12, NOW):
        add(atoms, orgs, 3, ("s", 3, 300), t, out_other=(0, 40)[t % 2])
    got = moves(spark, orgs)
    dev = {r["unit"]: r for r in cs.cell_deviations(frames(spark, atoms, orgs)[1], NOW).where("org = 3").collect()}
    want = {}
    for a, b, n in greedy({u: dev[u]["net"] for u in out}, {u: -dev[u]["net"] for u in into}):
        for unit, flow, other in ((a, "out_other", b), (b, "in_other", a)):
            m, more = want.get((3, unit, flow), (0, 0))
            want[3, unit, flow] = (m + n, more + dev[other]["uncertainty"])
    assert set(got) == set(want)
    for k, (m, more) in want.items():
        assert got[k] == pytest.approx((m, min(dev[k[1]][k[2]], m + more)))
    assert dev[300]["uncertainty"] > 2 * dev[302]["uncertainty"]


def test_turnover_inside_a_unit_and_one_sided_changes_are_no_moves(spark):
    atoms, orgs = world()
    add(atoms, orgs, 2, ("s", 2, 200), NOW, out_other=3000, in_other=3000)
    add(atoms, orgs, 4, ("s", 4, 400), NOW, out_other=3000)
    add(atoms, orgs, 4, ("s", 4, 401), NOW, in_other=1000)
    assert moves(spark, orgs) == {}


def test_a_noisy_whole_does_not_hide_a_local_move(spark):
    atoms, orgs = world()
    for t in MONTHS:
        n = 2000 + (t % 5) * 20_000
        add(atoms, orgs, 1, ("s", 8, 801), t, base=1_000_000, in_other=n, out_other=n)
    add(atoms, orgs, 1, ("s", 1, 100), NOW, out_other=1000)
    add(atoms, orgs, 1, ("s", 1, 101), NOW, in_other=1000)
    got = moves(spark, orgs)
    assert set(got) == {(1, 100, "out_other"), (1, 101, "in_other")} and got[1, 101, "in_other"][1] == 1000


# ------------------------------------------------------------------ levels: one month with events in regions of their own
SRC, DST = ("s", 2, 200), ("s", 2, 201)


def events():
    atoms, orgs = world()
    # 1: a split organisation sends people to others from both of its units
    for k, n in ((0, 4844), (1, 5346)):
        add(atoms, orgs, 1, ("s", 1, 100 + k), NOW, out_other=n)
    # 2: an organisation moves people from one unit to the other
    add(atoms, orgs, 2, SRC, NOW, out_other=10_000)
    add(atoms, orgs, 2, DST, NOW, in_other=10_000)
    # 3: an organisation with many leavers each month has none now
    for t in MONTHS:
        add(atoms, orgs, 3, ("s", 3, 300), t, out_left=2000)
    add(atoms, orgs, 3, ("s", 3, 300), NOW, out_left=-2020)
    # 4: an organisation stops
    add(atoms, orgs, 4, ("s", 4, 400), NOW, out_left=15_000, stopped=14_000)
    # 5: people of no tracked organisation leave
    atoms[("s", 5, 500), NOW]["out_left"] += 9000
    # 6: an incomplete load
    for k in range(2, 6):
        for t in MONTHS:
            atoms[("s", 6, 600 + k), t] = dict(base=50_000, raw_rows=70_000, temp_left=0, single_pay=0, stopped=0, **dict.fromkeys(FLOWS, 200))
    for k in range(6):
        atoms[("s", 6, 600 + k), NOW].update(out_left=5000, raw_rows=50_000)
    return atoms, orgs


@pytest.fixture(scope="module")
def month(spark):
    return cascade(spark, *events())


def by_key(x, flow=None):
    return {k: (f, d, label) for k, f, d, label in shown(x) if flow in (None, f)}


def test_a_split_organisation_makes_no_reverse_event(month):
    assert by_key(month.org_level)["1"][1] > 9000
    atom = by_key(month.atom_level, "out_other")
    # each atom keeps its signal, as the organisation lies in neither; the region is explained by them
    assert {k for k in atom if k.startswith("s/1/")} == {"s/1/100", "s/1/101"} and all(d > 0 for _, d, _ in atom.values())
    assert "1" not in by_key(month.region_level)


def test_moves_explain_both_units(month):
    assert by_key(month.org_level)["2"][2] == "recode"
    lower = {(k, f) for x in (month.rest_level, month.atom_level) for k, f, _, _ in shown(x)}
    assert not {("s/2/200", "out_other"), ("s/2/201", "in_other")} & lower
    assert not {"200", "201", "2"} & (set(by_key(month.unit_level)) | set(by_key(month.region_level)))


def test_stops_are_labelled_and_fewer_leavers_are_not(month):
    rows = by_key(month.org_level)
    assert rows["4"][0] == "out_left" and rows["4"][1] > 10_000 and rows["4"][2] == "stop"
    assert rows["3"][0] == "out_left" and rows["3"][1] < 0 and rows["3"][2] is None
    card = {r["key"]: r["delta"] for r in month.as_cards(month.org_level).collect()}
    assert card["4"] < 0 < card["3"]


def test_the_rest_explains_its_atom_and_the_places_above(month):
    # leavers of no tracked organisation are shown as the rest of the atom and nowhere else
    assert by_key(month.rest_level)["s/5/500"][0] == "out_left" and "s/5/500" not in by_key(month.atom_level)
    assert not {"500", "5"} & (set(by_key(month.unit_level)) | set(by_key(month.region_level)))


def test_an_incomplete_load_labels_the_leavers_of_its_region(month):
    assert [r["key"] for r in month.underload_cards.collect()] == ["6"]
    labels = {k: label for x in (month.rest_level, month.atom_level) for k, f, _, label in shown(x) if f == "out_left" and k.startswith("s/6/")}
    assert labels and set(labels.values()) == {"underload"}


def test_an_independent_arrival_beside_a_move_stays(spark, month):
    atoms, orgs = events()
    atoms[DST, NOW]["in_other"] += 4000
    more = cascade(spark, atoms, orgs)
    assert "s/2/201" in by_key(more.rest_level, "in_other") and "s/2/201" not in by_key(month.rest_level)


def test_a_common_calendar_shift_is_taken_out_of_the_leavers(spark):
    atoms, orgs = world()
    for r in atoms.values():
        r["single_pay"] = 100
    for c in CELLS:
        atoms[c, NOW].update(out_left=450, temp_left=250, single_pay=500)
    c = cascade(spark, atoms, orgs)
    left = c.melted(c.atom_panel).where((F.col("mi") == NOW) & (F.col("flow") == "out_left")).agg(F.min("value"), F.max("value")).first()
    assert tuple(left) == pytest.approx((200, 200))
    # a shift in one region is no calendar
    atoms, orgs = world()
    for r in atoms.values():
        r["single_pay"] = 100
    atoms[CELLS[0], NOW].update(out_left=450, temp_left=250, single_pay=500)
    c = cascade(spark, atoms, orgs)
    assert c.melted(c.atom_panel).where((F.col("mi") == NOW) & (F.col("flow") == "out_left")).agg(F.max("value")).first()[0] == 450
