"""Statistical watch of a panel: peer expectations, noise, bounds, signals, evidence, cards.

A panel is long: row keys (lvl, key, grp, region), ``mi``, base and flow columns. Windows run along the
months of one row (at most a few dozen rows per partition), everything across rows is a groupBy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..session import stage_table
from .calendar import _exact
from .ranking import exact_median
from .series import scaffold

ROW = ("key",)
# Fixed values of the watch.
HIST, MIN_HISTORY, PRIOR, MIN_PEOPLE, MIN_SHARE = 12, 6, 20, 100, 0.001
MAD_SCALE, HALF_NORMAL_VAR, MIN_NULL_MEAN = 1.4826, 0.455, 5.0


def _n() -> Column:
    return F.count(F.lit(1))


def _past(n: int = HIST):
    return W.partitionBy(*ROW).orderBy("mi").rowsBetween(-n, -1)


def panel(generation: DataFrame, measures: Sequence[str], first: int, last: int) -> DataFrame:
    """Dense months of atoms and tracked organisations; a month without a row is unknown, not zero."""
    key = F.concat_ws("|", "lvl", "seg_rep", F.col("region").cast("string"), F.col("unit").cast("string"), F.col("org").cast("string"))
    g = generation.withColumn("key", key)
    meta = g.groupBy("key").agg(*[F.min(c).alias(c) for c in ("lvl", "seg_rep", "region", "unit", "org")])
    return scaffold(g.select("key", "mi", *measures), ["key"], first, last, flag="present").join(meta, "key")


def residual(pan: DataFrame, measures: Sequence[str], atom: Sequence[str] = ("seg_rep", "region", "unit")) -> DataFrame:
    """Atom minus its tracked organisations; unknown stays unknown, a negative rest is an error flag."""
    active = F.col("present")
    o = pan.where("lvl = 'org'").groupBy(*atom, "mi").agg(*[fc.sum_known(m, active).alias(f"o_{m}") for m in measures], F.count_if(active).alias("n_orgs"))
    a = pan.where("lvl = 'atom'").join(o, [*atom, "mi"], "left")
    rest = {m: F.when(F.coalesce("n_orgs", F.lit(0)) == 0, F.col(m)).otherwise(F.col(m) - F.col(f"o_{m}")) for m in measures}
    bad = F.lit(False)
    for m in measures:
        bad = bad | F.coalesce(rest[m] < 0, F.lit(False))
    return a.select(*atom, "mi", *[v.alias(m) for m, v in rest.items()], bad.alias("negative"))


def calendar_months(pan: DataFrame, min_base: float = 5000, share: float = 0.6, year: int = 12) -> DataFrame:
    """mi, common: months in which most regions show more temporary leavers than a year ago and single payments grew.

    Regions are folded first; the month's verdict is one row per period.
    """
    reg = pan.groupBy("region", "mi").agg(F.sum("base").alias("b"), F.sum("temp_left").alias("v"))
    reg = reg.withColumn("rate", F.col("v") / F.greatest("b", F.lit(1)))
    x = _exact(reg, ["region"], ["rate", "v", "b"], (year,))
    err = 3 * F.sqrt(F.col("v") + F.col(f"v_{year}") + 1) / F.greatest("b", F.lit(1))
    x = x.withColumns({"delta": F.col("rate") - F.col(f"rate_{year}"), "ok": (F.col("b") >= min_base) & (F.col(f"b_{year}") >= min_base)}).withColumn("hit", F.col("delta") > err)
    m = x.where("ok").groupBy("mi").agg(_n().alias("n"), F.avg(F.col("hit").cast("int")).alias("share"), F.median("delta").alias("common"))
    single = _exact(pan.groupBy("mi").agg(F.sum("single_pay").alias("s")), [], ["s"], (1,)).where("s > s_1").select("mi")
    return m.where((F.col("n") >= 3) & (F.col("share") >= share) & (F.col("common") > 0)).join(single, "mi", "left_semi").select("mi", "common")


def calendar_part() -> Column:
    """What a common calendar shift adds to a row's leavers: its temporary leavers, up to the common share of its base."""
    # without a common shift nothing is taken out: least() alone would skip the null
    return F.when(F.col("common").isNotNull(), F.least("temp_left", F.col("common") * F.col("base"))).otherwise(0.0)


def calendar_component(pan: DataFrame, min_base: float = 5000, share: float = 0.6, year: int = 12) -> DataFrame:
    """Common extra of temporary leavers, when most regions show it and single payments grew, for every row and month."""
    return pan.join(calendar_months(pan, min_base, share, year), "mi", "left").select(*ROW, "mi", calendar_part().alias("calendar"))


def _leave_one_out(rates: DataFrame, by: Sequence[str], name: str, least: int) -> DataFrame:
    """Median of the rates of all other regions per group and month.

    The regions of a group are a short fixed list, so their rates travel as one array per (group, month)
    and each region drops its own entry: no region × region join.
    """
    arr = rates.groupBy(*by).agg(F.collect_list(F.struct("region", "rate")).alias("all"))
    x = arr.select(*by, "all", F.explode("all").alias("me")).select(*by, F.col("me.region").alias("region"), F.sort_array(F.transform(
        F.filter("all", lambda r: (r["region"] != F.col("me.region")) & r["rate"].isNotNull()), lambda r: r["rate"])).alias("o"))
    n = F.size("o")
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return x.select(*by, "region", F.when(n >= least, (F.get("o", lo) + F.get("o", hi)) / 2).alias(name))


def peer_expected(pan: DataFrame, flow: str, min_base: float = 5000, min_regions: int = 3, within: Sequence[str] = ()) -> DataFrame:
    """Base × median rate of the other regions of the group, else of the other regions overall (of the same ``within``)."""
    ok = F.col(flow).isNotNull() & F.col("base").isNotNull()
    k = pan.withColumn("_ok", ok)
    g = k.groupBy(*within, "grp", "region", "mi").agg(F.sum(F.when(F.col("_ok"), F.col(flow))).alias("o"), F.sum(F.when(F.col("_ok"), F.col("base"))).alias("b"))
    a = g.groupBy(*within, "region", "mi").agg(F.sum("o").alias("o"), F.sum("b").alias("b"))
    rate = F.when(F.coalesce("b", F.lit(0)) >= min_base, F.col("o") / F.col("b"))
    lg = _leave_one_out(g.withColumn("rate", rate), [*within, "grp", "mi"], "r_grp", min_regions)
    la = _leave_one_out(a.withColumn("rate", rate), [*within, "mi"], "r_all", 1)
    j = k.join(lg, [*within, "grp", "mi", "region"], "left").join(la, [*within, "mi", "region"], "left")
    return j.withColumn("raw_exp", F.when(F.col("_ok"), F.col("base") * F.coalesce("r_grp", "r_all"))).drop("_ok", "r_grp", "r_all")


def row_offset(x: DataFrame, flow: str, prior: float = PRIOR) -> DataFrame:
    """Shrunk median of actual over expected in the past months: pulled to 1 by ``prior`` persons."""
    r = F.when(F.col("raw_exp") > 0, F.col(flow) / F.col("raw_exp"))
    y = x.withColumn("_r", r)
    med = F.coalesce(F.percentile("_r", 0.5).over(_past()), F.lit(1.0))
    se = F.coalesce(F.sum("raw_exp").over(_past()), F.lit(0.0))
    return y.withColumn("offset", (se * med + prior) / (se + prior)).drop("_r")


def _history(x: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each (row, month) beside the array of its past months: at most ``HIST`` entries."""
    return x.withColumn("_h", F.collect_list(F.struct("mi", *cols)).over(_past()))


def overdispersion(x: DataFrame, flow: str, cls: str = "cls", least: float = 5.0) -> DataFrame:
    """(variance − E) / E² by size class and month, from the median of squared past residuals."""
    h = _history(x.select(*ROW, "mi", cls, flow, "raw_exp", "offset"), [flow, "raw_exp"]).select(cls, "mi", "offset", F.explode("_h").alias("p"))
    e = F.col("p.raw_exp") * F.col("offset")
    u = F.when(e >= least, (F.pow(F.col(f"p.{flow}") - e, 2) / HALF_NORMAL_VAR - e) / F.pow(F.greatest(e, F.lit(1.0)), 2))
    u = h.select(cls, "mi", u.cast("double").alias("u"))
    k = u.select(cls, "mi").distinct().join(exact_median(u, [cls, "mi"], "u", 0.01), [cls, "mi"], "left").withColumnRenamed("median", "k")
    return k.select(cls, "mi", F.least(F.greatest(F.coalesce("k", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("k2"))


def floor_of(base: Column, people: float = MIN_PEOPLE, share: float = MIN_SHARE) -> Column:
    return F.greatest(F.lit(float(people)), share * F.coalesce(base, F.lit(0)))


def count_score(x: DataFrame, flow: str, dispersion: DataFrame, cls: str = "cls", min_history: int = MIN_HISTORY) -> DataFrame:
    """Expected, noise, z and support flag per row and month, from data before the month."""
    h = _history(x, [flow, "raw_exp", "base"])
    past = F.filter("_h", lambda p: p[flow].isNotNull() & p["raw_exp"].isNotNull() & (p["base"] > 0))
    y = h.withColumn("_r", F.transform(past, lambda p: (p[flow] - p["raw_exp"] * F.col("offset")).cast("double"))).withColumn("n_history", F.size("_r"))
    y = y.withColumn("_m", _array_median("_r")).withColumn("own", MAD_SCALE * _array_median(F.transform("_r", lambda v: F.abs(v - F.col("_m")))))
    y = y.join(dispersion, [cls, "mi"], "left")
    e = F.col("raw_exp") * F.col("offset")
    s = F.sqrt(F.greatest(F.greatest(e, F.lit(0.0)) + F.coalesce("k2", F.lit(0.0)) * e * e + 1, F.pow(F.coalesce("own", F.lit(0.0)), 2)))
    ok = (F.col("n_history") >= min_history) & (F.coalesce("base", F.lit(0)) > 0)
    return y.select(*ROW, "mi", "base", F.col(flow).alias("obs"), F.when(ok, e).alias("expected"), F.when(ok, s).alias("noise"), F.when(ok, F.col(flow) - e).alias("delta"),
                    F.when(ok, (F.col(flow) - e) / s).alias("z"), "n_history", ok.alias("supported"))


def _array_median(a: Column | str) -> Column:
    s = F.sort_array(F.col(a) if isinstance(a, str) else a)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def log_count_interval(x: DataFrame, flow: str, z: float, min_history: int = MIN_HISTORY, min_mean: float = MIN_NULL_MEAN) -> DataFrame:
    """log1p residuals with own and pooled MAD; expectation, bounds at ``z`` and support per row and month."""
    h = _history(x, [flow, "raw_exp", "base"])
    past = F.filter("_h", lambda p: (p[flow] >= 0) & (p["raw_exp"] >= 0) & (p["base"] > 0))
    y = h.withColumn("_p", F.transform(past, lambda p: F.struct((p["raw_exp"] * F.col("offset")).alias("raw"), (F.log1p(p[flow].cast("double")) - F.log1p(p["raw_exp"] * F.col("offset"))).alias("e"))))
    y = y.withColumn("location", _array_median(F.transform("_p", lambda p: p["e"])))
    y = y.withColumn("_c", F.transform("_p", lambda p: F.struct(p["raw"].alias("raw"), F.abs(p["e"] - F.col("location")).alias("a"))))
    y = y.withColumn("own", MAD_SCALE * _array_median(F.transform("_c", lambda p: p["a"])))
    pool = y.select("grp", "mi", F.explode("_c").alias("c")).where(F.col("c.raw") >= min_mean).select("grp", "mi", F.col("c.a").alias("a"))
    pool = exact_median(pool, ["grp", "mi"], "a", 0.01).select("grp", "mi", (F.col("median") * MAD_SCALE).alias("pooled"))
    y = y.join(pool, ["grp", "mi"], "left")
    raw = F.greatest(F.col("raw_exp") * F.col("offset"), F.lit(0.0))
    center = F.log1p(raw) + F.col("location")
    median = F.expm1(center)
    sigma = F.greatest(F.coalesce("pooled", F.lit(0.0)), F.coalesce("own", F.lit(0.0)), F.sqrt(F.log1p(1.0 / (median + 1))))
    y = y.withColumns({"center": center, "sigma": sigma})
    mean = F.greatest(F.expm1(F.col("center") + 0.5 * F.pow("sigma", F.lit(2.0))), F.lit(0.0))
    ok = (F.size("_p") >= min_history) & (F.coalesce("base", F.lit(0)) > 0) & F.col(flow).isNotNull() & F.col("center").isNotNull()
    up, lo = F.expm1(F.col("center") + z * F.col("sigma")), F.greatest(F.expm1(F.col("center") - z * F.col("sigma")), F.lit(0.0))
    return y.select(*ROW, "grp", "region", "mi", "base", F.col(flow).alias("obs"), F.when(ok, mean).alias("expected"), "center", "sigma", F.when(ok, F.greatest(up, mean)).alias("upper"),
                    F.when(ok, F.least(lo, mean)).alias("lower"), F.when(ok, (F.log1p(F.col(flow).cast("double")) - F.col("center")) / F.col("sigma")).alias("z"), ok.alias("supported"))


def z_normal(n_tests: int, budget: float) -> float:
    """Two-sided normal threshold with the false alarms of ``n_tests`` kept within the budget."""
    return NormalDist().inv_cdf(1 - budget / 2 / max(n_tests, 1))


def _tail(u: Column) -> Column:
    w = F.exp(-0.5 * u * u)
    return F.least(0.5 * w, w / (math.sqrt(2 * math.pi) * F.greatest(u, F.lit(1e-300))))


def _false_bound(z: Column) -> Column:
    """Bound on the chance that a row passes both its limit at ``z`` and the floor ``fl``, by chance alone."""
    c, sd, fl = F.col("center"), F.col("sigma"), F.col("fl")
    top, a = c + z * sd, c - z * sd
    mx, mn = F.greatest(top, F.log(fl)), F.least(top, F.log(fl))
    upper = (mx + F.log1p(F.exp(mn - mx)) - c) / sd
    lower = F.when(a > F.log1p(fl), _tail((c - a - F.log1p(-F.exp(F.log(fl) - a))) / sd)).otherwise(0.0)
    return _tail(upper) + lower


def z_threshold(bounds: DataFrame, budget: float, people: float = MIN_PEOPLE, share: float = MIN_SHARE, points: int = 32, passes: int = 6) -> DataFrame:
    """Smallest z whose summed false-alarm bounds over all supported rows, with the materiality floor, stay in the budget.

    The sum falls with z. The upper end is doubled until it holds; then every pass sums ``points`` places of the
    interval in one aggregation over the rows and keeps the part where the budget is crossed. No row: z is 0.
    """
    # three numbers a row, written once: the passes do not repeat what led to them
    x = stage_table(bounds.where("supported").select("center", "sigma", floor_of(F.col("base"), people, share).alias("fl")), f"z-bounds-{uuid4().hex}")

    def sums(places: list[float]) -> list[float]:
        return [v or 0.0 for v in x.agg(*[F.sum(_false_bound(F.lit(z))).alias(f"b{k}") for k, z in enumerate(places)]).first()]

    lo, hi = 0.0, 8.0
    at_lo, at_hi = sums([lo, hi])
    if at_lo <= budget:
        hi, at_hi = lo, at_lo
    while at_hi > budget:
        lo, hi = hi, 2 * hi
        at_hi = sums([hi])[0]
    for _ in range(passes if hi > lo else 0):
        places = [lo + (hi - lo) * k / points for k in range(1, points)]
        for z, v in zip(places, sums(places)):
            if v <= budget:
                hi, at_hi = z, v
                break
            lo = z
    return bounds.sparkSession.createDataFrame([(hi, at_hi)], "z double, false_bound double")


def pick_signals(scans: dict[str, DataFrame], mi: int, people: float = MIN_PEOPLE, share: float = MIN_SHARE) -> DataFrame:
    """Excess over the bound of at least the floor; the best flow per row."""
    out = None
    for f, s in scans.items():
        x = s.where((F.col("mi") == mi) & F.col("supported")).select(*ROW, F.lit(f).alias("flow"), "base", "obs", "expected",
                                                                   F.greatest(F.col("obs") - F.col("upper"), F.col("lower") - F.col("obs")).alias("excess"))
        out = x if out is None else out.unionByName(x)
    ok = out.where(F.col("excess") >= floor_of(F.col("base"), people, share))
    return ok.groupBy(*ROW).agg(F.max_by(F.struct("flow", "base", "obs", "expected", "excess"), F.struct("excess", "flow")).alias("b"), _n().alias("n_flows")).select(*ROW, "b.*", "n_flows")


def unit_move_evidence(cells: DataFrame, min_people: float = MIN_PEOPLE, matched: float = 0.6) -> DataFrame:
    """Opposite changes of one organisation in different units of a segment and region: how much pairs up.

    ``cells``: org, grp, region, unit, net (lost minus gained). The units of one organisation in one
    region are few; pairing sorted lists greedily gives the totals of a merge of cumulative sums, so
    min(lost, gained) is the matched amount and each cell's part follows from its cumulative interval.
    """
    keys = ["org", "grp", "region"]
    tot = cells.groupBy(*keys).agg(F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0)).alias("lost"), F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0.0)).alias("gained"))
    tot = tot.where((F.least("lost", "gained") > 0) & (F.least("lost", "gained") >= matched * F.greatest("lost", "gained"))).withColumn("moved", F.least("lost", "gained"))
    side = F.when(F.col("net") > 0, "lost").otherwise("gained")
    w = W.partitionBy(*keys, "side").orderBy(F.desc(F.abs("net")), "unit").rowsBetween(W.unboundedPreceding, -1)
    c = cells.where("net <> 0").withColumn("side", side).join(tot, keys)
    before = F.coalesce(F.sum(F.abs("net")).over(w), F.lit(0.0))
    part = F.greatest(F.least(F.abs("net"), F.col("moved") - before), F.lit(0.0))
    return c.select(*keys, "unit", "side", "moved", part.alias("explained")).where((F.col("moved") >= min_people) & (F.col("explained") > 0))


def cover_parents(parents: DataFrame, children: DataFrame, scope: Sequence[str], share: float = 0.7) -> DataFrame:
    """Parent signals are dropped when child signals of the same direction explain at least ``share``."""
    kids = children.select(*scope, "flow", F.signum("delta").alias("sg"), "delta").groupBy(*scope, "flow", "sg").agg(F.sum("delta").alias("explained"))
    j = parents.withColumn("sg", F.signum("delta")).join(kids, [*scope, "flow", "sg"], "left")
    return j.where(F.coalesce(F.abs("explained"), F.lit(0.0)) < share * F.abs("delta")).drop("sg")


def underload(scored: DataFrame, pan: DataFrame, mi: int, min_base: float = 1000, z_min: float = 2.0, share: float = 0.6, rows_drop: float = 0.97) -> DataFrame:
    """Regions with excess leavers in most atoms and fewer raw rows: a bad load, not people leaving."""
    z = scored.where((F.col("mi") == mi) & (F.coalesce("base", F.lit(0)) >= min_base)).join(pan.select(*ROW, "region").distinct(), list(ROW))
    g = z.groupBy("region").agg(_n().alias("n"), F.avg((F.coalesce("z", F.lit(0.0)) >= z_min).cast("int")).alias("share"))
    r = pan.where(F.col("mi").isin(mi - 1, mi)).groupBy("region").agg(*[F.sum(F.when(F.col("mi") == m, F.col("raw_rows"))).alias(n) for n, m in (("prev", mi - 1), ("cur", mi))])
    return g.where((F.col("n") >= 3) & (F.col("share") >= share)).join(r.where(F.col("cur") < rows_drop * F.col("prev")), "region")


def seasonal_rate(pan: DataFrame, flow: str, mi: int, by: Sequence[str] = (), z: float = 4.0, people: float = MIN_PEOPLE, share: float = MIN_SHARE, year: int = 12) -> DataFrame:
    """Whole or segment rate = the same month a year ago × level correction; noise from its past errors."""
    keys = list(by)
    t = pan.groupBy(*keys, "mi").agg(F.sum("base").alias("base"), F.sum(flow).alias("obs")).withColumn("rate", F.col("obs") / F.greatest("base", F.lit(1)))
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("mi")
    now, ago = F.avg("rate").over(w.rangeBetween(-3, -1)), F.avg("rate").over(w.rangeBetween(-year - 3, -year - 1))
    t = _exact(t, keys, ["rate"], (year,)).withColumn("pred", F.when(F.col("mi") >= year + 4, F.col(f"rate_{year}") * F.when(ago > 0, now / ago).otherwise(1.0)))
    t = t.withColumn("err", F.when(F.col("mi") < mi, F.col("rate") - F.col("pred")))
    wk = W.partitionBy(*(keys or [F.lit(0)]))
    t = t.withColumns({"n_err": F.count("err").over(wk), "_m": F.median("err").over(wk)}).withColumn("_d", F.abs(F.col("err") - F.col("_m"))).withColumn("mad", F.median("_d").over(wk))
    x = t.where((F.col("mi") == mi) & (F.col("n_err") >= 4)).withColumn("expected", F.col("pred") * F.col("base"))
    s = F.greatest(MAD_SCALE * F.col("mad") * F.col("base"), F.sqrt(F.greatest("expected", F.lit(1.0))))
    x = x.withColumns({"noise": s, "delta": F.col("obs") - F.col("expected")}).withColumn("excess", F.abs("delta") - z * F.col("noise"))
    return x.select(*keys, "mi", "base", "obs", "expected", "noise", "delta", "excess", (F.col("excess") >= floor_of(F.col("base"), people, share)).alias("signal"))


def simple_rival(pan: DataFrame, flow: str, mi: int, k: int = 25, year: int = 12) -> DataFrame:
    """z of the yearly change per row against its own history, top k: the baseline to beat."""
    x = _exact(pan.select(*ROW, "mi", F.col(flow).cast("double").alias("v")), list(ROW), ["v"], (year,)).withColumn("yoy", F.col("v") - F.col(f"v_{year}"))
    wk = W.partitionBy(*ROW)
    h = F.when(F.col("mi") < mi, F.col("yoy"))
    x = x.withColumn("_h", h).withColumn("_m", F.median("_h").over(wk)).withColumn("_a", F.abs(F.col("_h") - F.col("_m")))
    x = x.withColumn("mad", F.median("_a").over(wk)).where((F.col("mi") == mi) & F.col("yoy").isNotNull() & F.col("mad").isNotNull())
    z = (F.col("yoy") - F.col("_m")) / F.greatest(MAD_SCALE * F.col("mad"), F.lit(1.0))
    return x.select(*ROW, "yoy", z.alias("z")).orderBy(F.desc(F.abs("z")), *ROW).limit(k)


def card_frame(signals: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Actual against comparable expectation in report units, one table over levels, ranked by excess."""
    a = signals.select(F.lit("row").alias("level"), F.col("key"), "flow", "obs", "expected", (F.col("obs") - F.col("expected")).alias("delta"), "excess")
    b = seasonal.where("signal").select(F.lit("slice").alias("level"), F.col("key"), "flow", "obs", "expected", "delta", "excess")
    u = a.unionByName(b)
    return u.withColumn("rank", F.row_number().over(W.partitionBy("level").orderBy(F.desc("excess"), "key", "flow")))


def detect(pan: DataFrame, flows: Sequence[str], mi: int, budget: float, people: float, share: float, min_base: float) -> DataFrame:
    """Rows, then parents: peer expectation, offset, log interval, common threshold, signals, cover.

    The threshold is one z for all rows and flows of the month, so that the chance alarms of all of them together
    stay within ``budget``; it follows from how many rows there are and how wide their limits are.
    """
    expected = {f: row_offset(peer_expected(pan, f, min_base), f) for f in flows}
    limits = None
    for f, x in expected.items():
        own = log_count_interval(x, f, 1.0).where(F.col("mi") == mi).select("center", "sigma", "base", "supported")
        limits = own if limits is None else limits.unionByName(own)
    z = z_threshold(limits, budget, people, share).first()["z"]
    scans = {f: log_count_interval(x, f, z) for f, x in expected.items()}
    rows = pick_signals(scans, mi, people, share).withColumn("delta", F.col("obs") - F.col("expected"))
    meta = pan.select(*ROW, "grp", "region").distinct()
    kids = rows.join(meta, list(ROW))
    parents = None
    for f in flows:
        s = seasonal_rate(pan, f, mi, ["grp"], 4.0, people, share).where("signal").select("grp", F.lit(f).alias("flow"), "obs", "expected", "delta", "excess")
        parents = s if parents is None else parents.unionByName(s)
    kept = cover_parents(parents, kids.select("grp", "flow", "delta"), ["grp"])
    return card_frame(rows, kept.select(F.col("grp").alias("key"), "flow", "obs", "expected", "delta", "excess", F.lit(True).alias("signal")))
