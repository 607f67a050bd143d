"""New recipients: which action brought them, growing and declining cells, staff productivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc

VALID_MONTHS = 2   # fixed value: an action is valid to the end of the second month after it
# Channels in order of priority on the same day.
CHANNELS = ("mzp", "vsp", "dig")
OTHER = "other"


def _n() -> Column:
    return F.count(F.lit(1))


def newcomers(archive: DataFrame, current: DataFrame, period: str, split, keys: Sequence[str]) -> DataFrame:
    """New recipients from the archive up to the split and the live table after it, without duplicates."""
    from ..sources.scans import scan_archive_union
    return scan_archive_union(archive, current, period, split, keys).where(F.col("person").isNotNull())


def earliest_actions(actions: DataFrame, keys: Sequence[str], channel: str, act_key: str | None = None) -> DataFrame:
    """First action of each key and calendar month: all that first touch can ever need.

    Validity ends with a calendar month, so within a month the earliest action covers every payment a
    later one covers. Hot keys shrink to one row a month before any join.
    """
    k = F.col(act_key).cast("string") if act_key else F.lit(None).cast("string")
    first = F.min(F.struct(F.col("act_dt"), k.alias("act_key")))
    return actions.groupBy(*keys, fc.month_no("act_dt").alias("act_month")).agg(first.alias("a")).select(
        *keys, "act_month", "a.act_dt", "a.act_key", F.lit(channel).alias("ch"))


def interval_match(events: DataFrame, pay_dt: str, first_actions: DataFrame, keys: Sequence[str], event_keys: Sequence[str]) -> DataFrame:
    """Earliest action valid on the payment date, per event and channel.

    A payment looks at its own month and the ``VALID_MONTHS`` before it: each event is exploded to
    those months and joined by equality, one action row per month, in place of a range join.
    """
    months = F.explode(F.sequence(fc.month_no(pay_dt) - VALID_MONTHS, fc.month_no(pay_dt))).alias("act_month")
    e = events.select(*dict.fromkeys([*event_keys, *keys, pay_dt]), months)
    m = e.join(first_actions, [*keys, "act_month"]).where(F.col("act_dt") <= F.col(pay_dt))
    return m.groupBy(*event_keys, "ch").agg(F.min(F.struct("act_dt", "act_key")).alias("a")).select(*event_keys, "ch", "a.act_dt", "a.act_key")


def first_touch(events: DataFrame, candidates: DataFrame, event_keys: Sequence[str], pay_dt: str, priority: Sequence[str] = CHANNELS) -> DataFrame:
    """Earliest action wins, then channel priority, then key; flags of every active channel; else "other"."""
    prio: Column | None = None
    for i, ch in enumerate(priority, 1):
        prio = F.when(F.col("ch") == ch, i) if prio is None else prio.when(F.col("ch") == ch, i)
    won = candidates.groupBy(*event_keys).agg(
        F.min_by(F.struct("ch", "act_dt", "act_key"), F.struct("act_dt", prio.alias("p"), F.coalesce("act_key", F.lit("")).alias("k"))).alias("w"),
        *[F.bool_or(F.col("ch") == ch).alias(f"has_{ch}") for ch in priority])
    off = F.lit(False)
    return events.join(won, list(event_keys), "left").select(
        *events.columns, F.coalesce("w.ch", F.lit(OTHER)).alias("ch"), "w.act_dt", "w.act_key",
        F.when(F.col("w").isNotNull(), fc.month_diff(pay_dt, "w.act_dt")).alias("lag_m"), *[F.coalesce(f"has_{ch}", off).alias(f"has_{ch}") for ch in priority])


def cell_counts(rec: DataFrame, keys: Sequence[str] = ("org", "unit")) -> DataFrame:
    """Distinct persons per period and cell, in two groupings."""
    return (rec.groupBy("mi", *keys, "person").agg(F.max("region").alias("region"))
            .groupBy("mi", *keys).agg(_n().alias("n"), F.max("region").alias("region")))


def cell_classes(cells: DataFrame, pairs: dict[str, tuple[int, int]], keys: Sequence[str] = ("org", "unit")) -> DataFrame:
    """Cells in two periods: new, closed, growing, declining, flat; several period pairs in one pass."""
    tagged = F.array(*[F.when(F.col("mi").isin(b, c), F.lit(t)) for t, (b, c) in pairs.items()])
    x = cells.withColumn("pair", F.explode(F.array_compact(tagged)))
    base = cur = F.lit(False)
    for t, (b, c) in pairs.items():
        base = base | ((F.col("pair") == t) & (F.col("mi") == b))
        cur = cur | ((F.col("pair") == t) & (F.col("mi") == c))
    g = x.groupBy("pair", *keys).agg(F.coalesce(F.max(F.when(cur, F.col("region"))), F.max("region")).alias("region"),
                                     F.coalesce(F.sum(F.when(base, F.col("n"))), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.when(cur, F.col("n"))), F.lit(0)).alias("n_c"))
    cls = (F.when(F.col("n_b") == 0, "new").when(F.col("n_c") == 0, "closed").when(F.col("n_c") > F.col("n_b"), "grow")
           .when(F.col("n_c") < F.col("n_b"), "decl").otherwise("flat"))
    return g.withColumn("cls", cls)


def step(delta: Column) -> Column:
    edges, last = fc.STEP_BANDS
    return fc.band(F.abs(delta), edges, last)


def cell_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("pair", "cls", step(F.col("n_c") - F.col("n_b")).alias("step")).agg(
        _n().alias("n_cells"), F.sum("n_b").alias("n_b"), F.sum("n_c").alias("n_c"))


def cells_by_dim(classes: DataFrame, orgs: DataFrame) -> DataFrame:
    """Growing, declining and flat cells with their head counts by segment, holding, industry, region."""
    from .yoy import dim_breakdown
    up, down, d = F.col("cls").isin("grow", "new"), F.col("cls").isin("decl", "closed"), F.col("n_c") - F.col("n_b")
    x = classes.join(orgs, "org", "left").withColumns({
        "n_grow": up.cast("int"), "n_decl": down.cast("int"), "n_flat": (F.col("cls") == "flat").cast("int"),
        "d_grow": F.when(up, d).otherwise(0), "d_decl": F.when(down, d).otherwise(0)})
    return dim_breakdown(x, {"seg": "seg", "holding": "hold", "industry": "industry", "region": "region"}, ["pair"],
                         ["n_grow", "n_decl", "n_flat", "n_b", "n_c", "d_grow", "d_decl"], keep_null=("seg", "holding", "industry", "region"))


def growth_cells(classes: DataFrame, touched: DataFrame, orgs: DataFrame, k: int, pair: str = "cur", channels: Sequence[str] = (*CHANNELS, OTHER)) -> DataFrame:
    """Top growing cells with the newcomers attributed to each channel."""
    n = touched.groupBy("org", "unit").agg(_n().alias("n_new"), *[F.count_if(F.col("ch") == c).alias(f"n_{c}") for c in channels])
    top = classes.where((F.col("pair") == pair) & F.col("cls").isin("grow", "new")).withColumn("delta", F.col("n_c") - F.col("n_b")).orderBy(F.desc("delta"), "org", "unit").limit(k)
    return top.join(n, ["org", "unit"], "left").join(orgs.select("org", "seg", "hold", "industry"), "org", "left").na.fill(0, ["n_new", *[f"n_{c}" for c in channels]])


def channel_counts(touched: DataFrame, by: Sequence[str]) -> DataFrame:
    """New recipients by any labels: month, channel, source, set of channels, lag, cell class."""
    return touched.groupBy(*by).agg(_n().alias("n"))


def channel_year_change(touched: DataFrame, channels: Sequence[str] = (*CHANNELS, OTHER)) -> DataFrame:
    """Newcomers per channel this year and last, shares, and the channel's part of the whole change."""
    cur, prev = F.count_if(F.col("yr") == "cur"), F.count_if(F.col("yr") == "prev")
    g = touched.groupBy("ch").agg(prev.alias("prev"), cur.alias("cur"))
    tot = touched.agg(F.struct(prev.alias("p"), cur.alias("c")).alias("t")).scalar()
    d = F.col("cur") - F.col("prev")
    return g.withColumn("t", tot).select(
        "ch", "prev", "cur", d.alias("delta"), fc.share(d, "prev").alias("pct"), fc.share(F.col("prev"), F.col("t.p")).alias("share_prev"),
        fc.share(F.col("cur"), F.col("t.c")).alias("share_cur"), fc.share(d, F.abs(F.col("t.c") - F.col("t.p"))).alias("contrib"))


def by_growth_step(touched: DataFrame, classes: DataFrame) -> DataFrame:
    c = classes.where(F.col("cls").isin("grow", "new")).select(F.col("pair").alias("yr"), "org", "unit", step(F.col("n_c") - F.col("n_b")).alias("step"))
    return touched.join(c, ["yr", "org", "unit"]).groupBy("yr", "step", "ch").agg(_n().alias("n"))


def latest_deals(tasks: DataFrame) -> DataFrame:
    """One row per deal from its latest record: deal, org, unit, region, employee, plan, fact."""
    cols = ["act_dt", "org", "unit", "region", "emp", "plan", "fact"]
    return tasks.where(F.col("deal").isNotNull()).groupBy("deal").agg(F.max_by(F.struct(*cols), F.col("report_dt")).alias("d")).select("deal", *[f"d.{c}" for c in cols])


def deal_productivity(deals: DataFrame, touched: DataFrame, channel: str = CHANNELS[0]) -> DataFrame:
    """Deals, plan, fact and attributed newcomers per month × region, by employee first."""
    w = touched.where(F.col("ch") == channel).groupBy(F.col("act_key").alias("deal")).agg(_n().alias("n_new"))
    d = deals.withColumn("deal", F.col("deal").cast("string")).join(w, "deal", "left").na.fill(0, ["n_new"])
    e = d.groupBy(F.last_day("act_dt").alias("month"), "region", "emp").agg(_n().alias("n_deals"), *[F.sum(c).alias(c) for c in ("plan", "fact", "n_new")])
    return e.groupBy("month", "region").agg(*[F.sum(c).alias(c) for c in ("n_deals", "plan", "fact", "n_new")], _n().alias("n_emp"))


def staff_counts(staff: DataFrame, by: Sequence[str] = ("report_dt", "region")) -> DataFrame:
    return staff.groupBy(*by, "emp").agg(F.lit(1).alias("_")).groupBy(*by).agg(_n().alias("n_staff"))


def deal_match(deals: DataFrame, cells: DataFrame) -> DataFrame:
    """Deals whose organisation is known in the same unit, in another unit, nowhere."""
    k = cells.select("org", "unit").distinct().withColumn("same", F.lit(True))
    o = cells.select("org").distinct().withColumn("known", F.lit(True))
    m = F.when(F.col("same"), "same_unit").when(F.col("known"), "other_unit").otherwise("no_org")
    return deals.join(k, ["org", "unit"], "left").join(o, "org", "left").groupBy(m.alias("match")).agg(_n().alias("n_deals"))


def productivity_ratio(years: DataFrame) -> DataFrame:
    """Staff growth against sales growth, and newcomers expected at last year's productivity.

    ``years`` has one row per yr (cur, prev): staff, deals, fact, n_new.
    """
    cols = ("staff", "deals", "fact", "n_new")
    one = years.agg(*[F.max(F.when(F.col("yr") == y, F.col(c))).alias(f"{c}_{y}") for c in cols for y in ("cur", "prev")])
    per = fc.share("n_new_prev", "staff_prev")
    return one.select("*", *[fc.share(f"{c}_cur", f"{c}_prev").alias(f"k_{c}") for c in cols], (per * F.col("staff_cur")).alias("expected_new"),
                      (F.col("n_new_cur") - per * F.col("staff_cur")).alias("gap"))
