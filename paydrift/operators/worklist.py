"""Sales funnel, plan and fact, pipeline, work list of organisations that closes a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc
from .ranking import bucket_by, material_cover, running_cover


def task_flags(tasks: DataFrame, fresh_from: str, overdue_like: str = "%просроч%") -> DataFrame:
    """Three-valued task columns to plain flags."""
    plan = F.coalesce("plan_staff_deal_qty", F.lit(0))

    def text(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) != ""

    return tasks.withColumns({
        "in_progress": F.coalesce("is_task_in_progress", ~F.coalesce("is_task_closed", F.lit(False))),
        "overdue": F.coalesce(F.col("task_text_status").ilike(overdue_like), F.lit(False)),
        "deal_expected": (plan > 0) | F.col("deal_code").isNotNull(),
        "fresh_deal": (plan > 0) & F.coalesce(F.col("deal_create_dttm") >= F.lit(fresh_from).cast("date"), F.lit(False)),
        "has_text": text("task_comment") | text("task_questionnaire")})


def _n() -> Column:
    return F.count(F.lit(1))


def _sum_if(c: Column, v: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col(v) if isinstance(v, str) else v)), F.lit(0))


# ------------------------------------------------------------------- units

def unit_map(dim: DataFrame, excluded_regions: Sequence = ()) -> DataFrame:
    """Old unit → region, new unit, name; ``min`` makes a unit belong to one region."""
    m = dim.groupBy("old_unit").agg(F.min("region").alias("region"), F.min("new_unit").alias("unit"), F.min("name").alias("name"))
    return m.where(~F.col("region").isin(list(excluded_regions))) if excluded_regions else m


def units_per_region(mapping: DataFrame) -> DataFrame:
    return mapping.select("region", "unit").distinct().groupBy("region").agg(_n().alias("n_units"))


def org_metrics_rollup(metrics: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old units folded into new: sums first, ratios recomputed from the sums."""
    j = metrics.join(mapping.select(F.col("old_unit").alias("unit_old"), "unit", "region"), metrics["unit"] == F.col("unit_old")).drop(metrics["unit"])
    g = j.groupBy("region", "unit", "org", "mi").agg(*[F.sum(c).alias(c) for c in ("fl", "fot", "staff", "potential")])
    return g.withColumns({"avg_salary": fc.share("fot", "fl"), "penetration": fc.share("fl", "staff")})


def unit_plan_fact(facts: DataFrame, levels: Sequence[str], mi: int) -> DataFrame:
    """Plan, fact, prediction and shortfall by unit and segment at the given levels of the mart."""
    out = None
    for lv in levels:
        x = facts.where((F.col("level") == lv) & (F.col("mi") == mi)).groupBy("level", "level_id", "seg").agg(*[F.sum(c).alias(c) for c in ("plan", "fact", "pred")])
        out = x if out is None else out.unionByName(x)
    return out.withColumn("shortfall", F.greatest(F.col("plan") - F.col("pred"), F.lit(0.0)))


def rank_units(execution: DataFrame) -> DataFrame:
    """Rank of a unit by execution within metric × period × level, and how many units there are."""
    w = W.partitionBy("metric", "mi", "level")
    return execution.withColumns({"rank": F.rank().over(w.orderBy(F.desc_nulls_last("execution"))), "n_units": _n().over(w)})


def reference_dates(facts: DataFrame) -> DataFrame:
    """Report period: the last with a prediction, else the last closed plus one; and windows from it."""
    a = facts.agg(F.max(F.when(F.col("pred").isNotNull(), F.col("mi"))).alias("p"), F.max(F.when(F.col("fact").isNotNull(), F.col("mi"))).alias("f"))
    cur = F.coalesce("p", F.col("f") + 1)
    return a.select(cur.alias("report"), (cur - 1).alias("closed"), (cur - 3).alias("from_3"), (cur - 12).alias("year_ago"))


def unit_matrix(plan: DataFrame, pred: DataFrame, base: DataFrame, keys: Sequence[str] = ("unit", "seg")) -> DataFrame:
    """Unit × segment: plan, base, prediction, execution and shortfall; cells without a prediction are told."""
    j = plan.join(pred, list(keys), "full_outer").join(base, list(keys), "full_outer")
    return j.select(*keys, "plan", "pred", "base", F.when(F.col("pred").isNotNull(), fc.share("pred", "plan")).alias("execution"),
                    F.greatest(F.col("plan") - F.col("pred"), F.lit(0.0)).alias("shortfall"), F.col("pred").isNull().alias("no_prediction"))


def matrix_totals(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    return matrix.groupBy(*by).agg(F.sum("plan").alias("plan"), F.sum("pred").alias("pred"), F.sum("shortfall").alias("shortfall"), F.count_if("no_prediction").alias("n_no_prediction"))


# ---------------------------------------------------------------- pipeline

CONV_LIMITS, CONV_MIN_PLAN = (0.2, 1.0), 30   # fixed values: limits of conversion, least plan for an own one


def _conv(fact: Column, plan: Column) -> Column:
    lo, hi = CONV_LIMITS
    return F.when(plan > 0, F.least(F.greatest(fact / plan, F.lit(lo)), F.lit(hi)))


def conversion(plan: DataFrame, fact: DataFrame, mapping: DataFrame, current: int, min_plan: float = CONV_MIN_PLAN) -> DataFrame:
    """Sales over plan in closed periods per unit; small plans fall back to the region, then the whole."""
    keys = ["unit", "org", "emp", "mi"]
    mapping = mapping.groupBy("unit").agg(F.min("region").alias("region"))
    f = fact.groupBy(*keys).agg(F.sum("fact").alias("fact"))
    p = plan.where(F.col("mi") < current).groupBy(*keys).agg(F.sum("plan").alias("plan")).join(f, keys, "left").na.fill(0, ["fact"]).join(mapping, "unit", "left")
    u = p.groupBy("unit").agg(F.sum("plan").alias("up"), F.sum("fact").alias("uf"))
    r = p.groupBy("region").agg(_conv(F.sum("fact"), F.sum("plan")).alias("k_region"))
    whole = p.agg(_conv(F.sum("fact"), F.sum("plan")).alias("k")).scalar()
    own = F.when(F.col("up") >= min_plan, _conv(F.col("uf"), F.col("up")))
    j = plan.select("unit").distinct().join(mapping, "unit", "left").join(u, "unit", "left").join(r, "region", "left")
    return j.select("unit", "region", F.coalesce(own, F.col("k_region"), whole).alias("k"), F.when(own.isNotNull(), "unit").when(F.col("k_region").isNotNull(), "region").otherwise("whole").alias("source"))


def pipeline_plan(codes: DataFrame, plans: DataFrame, max_offset: int = 2) -> DataFrame:
    """Plan per (unit, org, employee, month) by deal code, with the month number resolved to a date."""
    j = codes.join(plans, "deal").withColumn("month", fc.plan_month("month_no", "created", max_offset))
    return j.where("month is not null").groupBy("unit", "org", "emp", "month").agg(F.sum("plan").alias("plan"), F.count_distinct("deal").alias("n_deals"))


def pipeline_current(plan: DataFrame, fact: DataFrame, conv: DataFrame, current: int, time_left: float) -> DataFrame:
    """Fact so far + max(0, plan − fact) × conversion × share of the month still ahead."""
    p = plan.where(F.col("mi") == current).groupBy("unit", "org").agg(F.sum("plan").alias("plan"))
    f = fact.where(F.col("mi") == current).groupBy("unit", "org").agg(F.sum("fact").alias("fact"))
    left = min(max(time_left, 0.0), 1.0)
    j = p.join(f, ["unit", "org"], "left").na.fill(0, ["fact"]).join(conv.select("unit", "k"), "unit", "left")
    rest = F.greatest(F.col("plan") - F.col("fact"), F.lit(0))
    return j.select("unit", "org", "plan", "fact", rest.alias("rest"), (F.col("fact") + rest * F.coalesce("k", F.lit(1.0)) * left).alias("expected"))


def deals_due(plan: DataFrame, fact: DataFrame, current: int) -> DataFrame:
    """Plan and fact of the closed periods per organisation."""
    p = plan.where(F.col("mi") < current).groupBy("unit", "org").agg(F.sum("plan").alias("plan_due"), F.count_distinct("mi").alias("n_months"))
    f = fact.where(F.col("mi") < current).groupBy("unit", "org").agg(F.sum("fact").alias("fact_due"))
    return p.join(f, ["unit", "org"], "left").na.fill(0, ["fact_due"])


# ------------------------------------------------------------------ funnel

def funnel_agg(tasks: DataFrame, by: Sequence[str] = ("unit", "org")) -> DataFrame:
    """Tasks of the window: counts by kind and state, plan and fact of old and fresh deals, last activity."""
    kind, ok = F.col("last_active_type"), F.coalesce("is_task_closed_success", F.lit(False))
    old = F.col("deal_expected") & ~F.col("fresh_deal")
    return tasks.groupBy(*by).agg(
        _n().alias("n_tasks"), F.count_if(kind == "call").alias("n_calls"), F.count_if(kind == "meeting").alias("n_meetings"), F.count_if(ok).alias("n_success"), F.count_if("overdue").alias("n_overdue"),
        F.count_if("in_progress").alias("n_in_progress"), F.count_if(~F.col("in_progress")).alias("n_closed"), _sum_if(old, "plan_staff_deal_qty").alias("plan_old"), _sum_if(old, "fact_staff_deal_qty").alias("fact_old"),
        _sum_if(F.col("fresh_deal"), "plan_staff_deal_qty").alias("plan_fresh"), F.max(F.when(F.col("fresh_deal"), F.col("deal_create_dttm"))).alias("fresh_deal_dt"), F.max("last_active_dttm").alias("last_active"))


def funnel_months(tasks: DataFrame, outflow_type: str) -> DataFrame:
    """Tasks by organisation and month: all, successful, and those about outflow."""
    ok, out = F.coalesce("is_task_closed_success", F.lit(False)), F.col("task_type") == outflow_type
    return tasks.groupBy("unit", "org", "mi").agg(_n().alias("n_tasks"), F.count_if(ok).alias("n_success"), F.count_if(out).alias("n_outflow"), F.count_if(out & ok).alias("n_out_success"))


def activity_totals(tasks: DataFrame) -> DataFrame:
    """By region: tasks and distinct organisations; rows without an organisation are counted apart."""
    k = tasks.groupBy("region", "org").agg(_n().alias("n"))
    return k.groupBy("region").agg(F.sum("n").alias("n_tasks"), F.count("org").alias("n_orgs"), _sum_if(F.col("org").isNull(), "n").alias("n_no_org"))


def org_manager(assign: DataFrame, staff: DataFrame, role: str) -> DataFrame:
    """Current assignee of each (unit, org): open assignment of the role, latest start, newest staff name."""
    a = assign.where((F.col("role") == role) & F.col("end_dt").isNull()).groupBy("unit", "org").agg(F.max_by("emp", F.struct("start_dt", F.col("emp"))).alias("emp"))
    s = staff.groupBy("emp").agg(F.max_by("name", F.struct("report_dt", F.col("name"))).alias("name"))
    return a.join(s, "emp", "left")


# ----------------------------------------------------------------- outflow

def outflow_net_returns(fact: DataFrame, returns: DataFrame) -> DataFrame:
    """Outflow minus returns, never below zero; returns are summed first so they do not multiply rows."""
    r = returns.groupBy("unit", "org", "mi").agg(F.sum("return_qty").alias("ret"))
    j = fact.join(r, ["unit", "org", "mi"], "left").na.fill(0, ["ret"])
    return j.withColumn("kept", F.greatest(F.col("outflow_qty") - F.col("ret"), F.lit(0)))


def org_outflow(net: DataFrame, first: int, last: int) -> DataFrame:
    """Outflow, returns, kept and the list of periods with outflow (a handful) per organisation."""
    x = net.where(F.col("mi").between(first, last))
    return x.groupBy("unit", "org").agg(F.sum("outflow_qty").alias("out_qty"), F.sum("ret").alias("ret_qty"), F.sum("kept").alias("kept"),
                                        F.sort_array(F.collect_set(F.when(F.col("kept") > 0, F.col("mi")))).alias("out_months"))


def outflow_with_pipeline(net: DataFrame, pipe: DataFrame, seg_of: DataFrame, first: int, last: int) -> DataFrame:
    """Outflow of an organisation beside its pipeline, one row where either side knows it.

    ``pipe``: unit, org, plan, fact, rest, expected, seg_deal. The segment comes from the outflow, else from the deals, else
    from the directory ``seg_of`` (org, seg); blank counts as missing, the largest of several is taken. Quantities one
    side does not know are 0, an unknown segment stays NULL.
    """
    def some(c: str) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    own = net.where(F.col("mi").between(first, last)).groupBy("unit", "org").agg(F.max(some("seg")).alias("seg_fact"))
    out = org_outflow(net, first, last).join(own, ["unit", "org"])
    deals = pipe.groupBy("unit", "org").agg(*[F.sum(c).alias(c) for c in ("plan", "fact", "rest", "expected")], F.max(some("seg_deal")).alias("seg_deal"))
    directory = seg_of.groupBy("org").agg(F.max(some("seg")).alias("seg_dir"))
    j = out.join(deals, ["unit", "org"], "full").join(directory, "org", "left").na.fill(0, ["out_qty", "ret_qty", "kept", "plan", "fact", "rest", "expected"])
    source = F.when(F.col("seg_fact").isNotNull(), "outflow").when(F.col("seg_deal").isNotNull(), "deal").when(F.col("seg_dir").isNotNull(), "directory")
    return j.select("unit", "org", F.coalesce("seg_fact", "seg_deal", "seg_dir").alias("seg"), source.alias("seg_source"), "out_qty", "ret_qty", "kept",
                    F.coalesce("out_months", F.array().cast("array<int>")).alias("out_months"), "plan", "fact", "rest", "expected")


def outflow_worked(outflow: DataFrame, months: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Was there a successful outflow task in the month of leaving or the next; unknown outside the window."""
    looks = outflow.select("unit", "org", F.explode("out_months").alias("m"))
    known = looks.groupBy("unit", "org").agg(F.bool_and((F.col("m") + 1 >= window[0]) & (F.col("m") <= window[1])).alias("known"))
    rows = looks.select("unit", "org", F.explode(F.array("m", F.col("m") + 1)).alias("mi")).join(months, ["unit", "org", "mi"], "left")
    g = rows.groupBy("unit", "org").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_tasks", "out_tasks"), ("n_outflow", "out_tasks_outflow"), ("n_out_success", "out_done"))])
    j = outflow.join(g, ["unit", "org"], "left").join(known, ["unit", "org"], "left").na.fill(0, ["out_tasks", "out_tasks_outflow", "out_done"])
    return j.withColumns({"known": F.coalesce("known", F.lit(True)), "out_worked": F.col("out_done") > 0})


def candidates(orgs: DataFrame) -> DataFrame:
    """Lever Attract or Return with its effect; the pipeline already counted is taken off the potential."""
    a, r = F.greatest(F.col("potential") - F.col("pipe"), F.lit(0.0)), F.greatest(F.coalesce("kept", F.lit(0)), F.lit(0))
    x = orgs.withColumns({"attract": a, "ret": r.cast("double")}).where("attract >= 1 or ret >= 1")
    lever = F.when(F.col("attract") >= F.col("ret"), "attract").otherwise("return")
    money = F.when(lever == "attract", F.col("potential_fot") * F.coalesce(F.try_divide("attract", "potential"), F.lit(0.0))).otherwise(F.col("ret") * F.coalesce("avg_salary", F.lit(0.0)))
    return x.withColumns({"lever": lever, "impact": F.greatest("attract", "ret"), "impact_money": money})


def work_or_skip(cand: DataFrame) -> DataFrame:
    """Ordered rules: worth working now or not, and why; every row gets exactly one answer."""
    back = F.col("lever") == "return"
    rules = [(back & F.col("out_worked"), "skip", "outflow worked"), (back & (F.col("out_tasks") == 0), "work", "outflow: no tasks"),
             (back & (F.col("out_tasks_outflow") == 0), "work", "outflow: other tasks only"), (back, "work", "outflow: task not successful"),
             (F.col("fresh_deal_dt").isNotNull(), "skip", "fresh deal"), (F.coalesce("n_tasks", F.lit(0)) == 0, "work", "not worked"),
             ((F.col("n_in_progress") > 0) & (F.col("n_closed") == 0) & (F.col("n_overdue") == 0), "skip", "in progress"),
             ((F.coalesce("plan_due", F.lit(0)) >= 1) & (F.coalesce("fact_due", F.lit(0)) < F.col("plan_due")), "work", "deals below plan"),
             (F.col("n_overdue") > 0, "work", "overdue tasks"), (F.col("n_success") > 0, "skip", "worked with success")]
    decision = reason = None
    for c, d, r in rules:
        c = F.coalesce(c, F.lit(False))
        decision, reason = (F.when(c, d), F.when(c, r)) if decision is None else (decision.when(c, d), reason.when(c, r))
    return cand.withColumns({"decision": decision.otherwise("work"), "reason": reason.otherwise("worked without result")})


def note_audit(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Text rules over the decision: checklist, then a future deadline, then a keyword; rows may change lists.

    ``notes`` has unit, org and optional checklist / keyword structs (reason, verdict) and a deadline.
    """
    j = rows.join(notes, ["unit", "org"], "left")
    src = F.when(F.col("checklist").isNotNull(), "checklist").when(F.col("deadline").isNotNull(), "deadline").when(F.col("keyword").isNotNull(), "keyword").otherwise("none")
    verdict = F.when(src == "checklist", F.col("checklist.verdict")).when(src == "deadline", "wait").when(src == "keyword", F.col("keyword.verdict"))
    decision = F.when(verdict.isin("no_point", "wait"), "skip").when(verdict == "work", "work").otherwise(F.col("decision"))
    return j.select(*[c for c in rows.columns if c != "decision"], src.alias("audit_source"),
                    F.coalesce("checklist.reason", F.when(src == "deadline", F.concat(F.lit("until "), F.col("deadline"))), F.col("keyword.reason")).alias("audit_reason"),
                    decision.alias("decision"), (decision != F.col("decision")).alias("moved"))


def greedy_cover(rows: DataFrame, gaps: DataFrame, targets: Sequence[float] = (1.0, 1.2, 1.5), width: float = 100.0) -> DataFrame:
    """Smallest set by effect that closes each segment gap, then a fill from other segments of the unit.

    ``rows``: unit, seg, org, impact; ``gaps``: unit, seg, gap. ``need_k`` is the smallest target that
    needs the row, 0 when none does. A row is needed while the sum before it is below the target, so
    the greedy choice is a running sum; ``width`` splits a hot unit into buckets of effect.
    """
    order = [F.desc("impact"), F.asc("org")]
    base = rows.withColumn("_bucket", bucket_by(F.col("impact"), width))
    picks = None
    for k in targets:
        own = running_cover(base.join(gaps.select("unit", "seg", (F.col("gap") * k).alias("target")), ["unit", "seg"]), ["unit", "seg"], order, "impact", "target")
        got = own.groupBy("unit", "seg").agg(F.sum("impact").alias("got"))
        lack = (gaps.join(got, ["unit", "seg"], "left").select("unit", F.greatest(F.col("gap") * k - F.coalesce("got", F.lit(0.0)), F.lit(0.0)).alias("lack"))
                .groupBy("unit").agg(F.sum("lack").alias("target")).where("target > 0"))
        rest = base.join(own.select("unit", "org"), ["unit", "org"], "left_anti").join(lack, "unit")
        fill = running_cover(rest, ["unit"], order, "impact", "target")
        one = own.select("unit", "org", F.lit(False).alias("filler")).unionByName(fill.select("unit", "org", F.lit(True).alias("filler"))).withColumn("k", F.lit(float(k)))
        picks = one if picks is None else picks.unionByName(one)
    best = picks.groupBy("unit", "org").agg(F.min_by(F.struct("k", "filler"), F.col("k")).alias("b")).select("unit", "org", F.col("b.k").alias("need_k"), F.col("b.filler").alias("filler"))
    return rows.join(best, ["unit", "org"], "left").na.fill({"need_k": 0.0, "filler": False})


def plan_effect(selected: DataFrame, by: Sequence[str]) -> DataFrame:
    """What the rows needed for the plan give, by unit or region."""
    s = selected.where("need_k > 0 and need_k <= 1.0")
    return s.groupBy(*by).agg(_n().alias("n_need"), F.sum("impact").alias("impact"), F.count_if("filler").alias("n_fill"), _sum_if(F.col("filler"), "impact").alias("impact_fill"))


def unit_detail(outflow: DataFrame, growth: DataFrame, cover: float = 0.6, cap: int = 8) -> DataFrame:
    """Outflow groups (nothing returned, partly) and yearly drops per unit, each cut to its material rows."""
    g = outflow.select("unit", "org", F.when(F.col("ret_qty") == 0, "none returned").otherwise("partly returned").alias("grp"), F.col("kept").cast("double").alias("amount")).where("amount > 0")
    d = growth.where("now < ago").select("unit", "org", F.lit("year drop").alias("grp"), (F.col("ago") - F.col("now")).cast("double").alias("amount"))
    return material_cover(g.unionByName(d), ["unit", "grp"], "amount", "org", cover, cap)


def outflow_by(net: DataFrame, mi: int, key: str) -> DataFrame:
    """Outflow of one period by agency, region or competitor: rate, return rate, share."""
    m = net.where(F.col("mi") == mi)
    g = m.groupBy(key).agg(F.sum("outflow_qty").alias("out_qty"), F.sum("ret").alias("ret_qty"), F.sum("kept").alias("kept"), F.sum("base").alias("base"), F.count_distinct("org").alias("n_orgs"))
    total = m.agg(F.sum("kept")).scalar()
    one = F.lit(1)
    return g.select("*", (F.col("out_qty") / F.greatest("base", one)).alias("out_rate"), (F.col("ret_qty") / F.greatest("out_qty", one)).alias("ret_rate"), (F.col("kept") / F.greatest(total, one)).alias("share"))


def outflow_trend(net: DataFrame) -> DataFrame:
    g = net.groupBy("mi").agg(F.sum("outflow_qty").alias("out_qty"), F.sum("ret").alias("ret_qty"), F.sum("kept").alias("kept"), F.sum("base").alias("base"))
    return g.withColumn("out_rate", F.col("out_qty") / F.greatest("base", F.lit(1)))


def cause_split(panel: DataFrame, base: int, now: int, dominant: float = 0.6) -> DataFrame:
    """Drop of each organisation = staff cut + left for a competitor; only organisations present in both."""
    two = panel.where(F.col("mi").isin(base, now)).groupBy("org").agg(
        *[F.sum(F.when(F.col("mi") == m, F.col(c))).alias(f"{c}_{t}") for t, m in (("base", base), ("now", now)) for c in ("fl", "staff")]).where("fl_base is not null and fl_now is not null")
    drop = F.greatest(F.col("fl_base") - F.col("fl_now"), F.lit(0))
    cut = F.least(F.greatest(F.col("staff_base") - F.col("staff_now"), F.lit(0)), drop)
    x = two.withColumns({"drop": drop, "staff_cut": cut, "competitor": drop - cut})
    s = fc.share("staff_cut", "drop")
    return x.withColumn("cause", F.when(F.col("drop") <= 0, "none").when(s >= dominant, "staff cut").when(1 - s >= dominant, "competitor").otherwise("mixed"))


def cause_by(causes: DataFrame, key: str) -> DataFrame:
    g = causes.groupBy(key).agg(F.sum("drop").alias("drop"), F.sum("staff_cut").alias("staff_cut"), F.sum("competitor").alias("competitor"), _n().alias("n_orgs"))
    return g.withColumn("staff_share", F.col("staff_cut") / F.greatest("drop", F.lit(1)))


def macro(panel: DataFrame, plan: DataFrame, now: int, year: int = 12) -> DataFrame:
    """Region: penetration, pay, growth to a year ago, plan execution."""
    at = lambda m, c: F.sum(F.when(F.col("mi") == m, F.col(c)))
    g = panel.where(F.col("mi").isin(now, now - year)).groupBy("region").agg(*[at(now, c).alias(c) for c in ("fl", "staff", "fot")], at(now - year, "fl").alias("fl_ago"))
    p = plan.where(F.col("mi") == now).groupBy("region").agg(F.sum("plan").alias("plan"), F.sum("fact").alias("fact"))
    return g.join(p, "region", "left").select("region", "fl", fc.share("fl", "staff").alias("penetration"), fc.share("fot", "fl").alias("pay"), fc.share(F.col("fl") - F.col("fl_ago"), "fl_ago").alias("growth"), fc.share("fact", "plan").alias("execution"))


def snapshot_asof(snap: DataFrame, mi: int, key: str, value: str) -> DataFrame:
    """Rows of the latest snapshot not later than the period, one per key."""
    last = snap.where(F.col("mi") <= mi).agg(F.max("mi")).scalar()
    return snap.where(F.col("mi") == last).groupBy(key).agg(F.min(value).alias(value))


def scenario_forecast(series: DataFrame, key: str, now: int, horizon: int, window: int = 6, season: DataFrame | None = None) -> DataFrame:
    """Hold, recover and risk paths: stock − outflow + inflow, the outflow capped at the stock.

    ``series``: key, mi, fl, kept. Inflow is what balances the stock. The path is sequential because of
    the cap, so it folds a short array of periods per key. ``season`` (slot, k) multiplies the outflow.
    """
    w = W.partitionBy(key).orderBy("mi")
    s = series.where(F.col("mi") <= now).withColumn("inflow", F.col("fl") - F.lag("fl").over(w) + F.col("kept"))
    tail = s.where(F.col("inflow").isNotNull() & (F.col("mi") > now - window)).groupBy(key).agg(
        F.avg("kept").alias("out_mean"), F.max("kept").cast("double").alias("out_worst"), F.avg("inflow").alias("in_mean"), F.max("inflow").cast("double").alias("in_best"))
    start = s.where(F.col("mi") == now).select(key, F.col("fl").cast("double").alias("fl"))
    sc = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(o).alias("out"), F.col(i).alias("inn")) for n, o, i in (("hold", "out_mean", "in_mean"), ("recover", "out_mean", "in_best"), ("risk", "out_worst", "in_mean"))]))
    x = start.join(tail, key).select(key, "fl", sc.alias("s")).select(key, "fl", "s.*")
    months = F.sequence(F.lit(now + 1), F.lit(now + horizon))
    if season is not None:
        ks = season.agg(F.map_from_entries(F.collect_list(F.struct("slot", "k")))).scalar()
        x = x.withColumn("_ks", ks)
        factor = lambda m: F.coalesce(F.element_at("_ks", F.pmod(m, F.lit(12)).cast("int")), F.lit(1.0))
    else:
        factor = lambda m: F.lit(1.0)
    zero = F.array(F.struct(F.lit(now).alias("mi"), F.col("fl").alias("fl_start"), F.lit(0.0).alias("out"), F.lit(0.0).alias("inflow"), F.col("fl").alias("fl_end")))

    def stepf(acc: Column, m: Column) -> Column:
        fl = F.element_at(acc, -1)["fl_end"]
        out = F.least(F.col("out") * factor(m), fl)
        return F.concat(acc, F.array(F.struct(m.alias("mi"), fl.alias("fl_start"), out.alias("out"), F.col("inn").alias("inflow"), (fl - out + F.col("inn")).alias("fl_end"))))

    path = F.aggregate(months, zero, stepf)
    return x.select(key, "scenario", F.explode(path).alias("p")).select(key, "scenario", "p.*").where(F.col("mi") > now)


def scenario_summary(paths: DataFrame, now: int) -> DataFrame:
    """End of each scenario against the start, and whether start − out + in reproduces it."""
    last = paths.agg(F.max("mi")).scalar()
    g = paths.groupBy("scenario").agg(_sum_if(F.col("mi") == now + 1, "fl_start").alias("fl_base"), F.sum("out").alias("out"), F.sum("inflow").alias("inflow"), F.sum(F.when(F.col("mi") == last, F.col("fl_end"))).alias("fl_end"))
    return g.withColumns({"delta": F.col("fl_end") - F.col("fl_base"), "residual": F.col("fl_base") - F.col("out") + F.col("inflow") - F.col("fl_end")})


def outflow_season(net: DataFrame, year: int = 12, min_periods: int = 24) -> DataFrame:
    """Multiplier of outflow by place in the year, over the whole segment; none below two years of data."""
    t = net.groupBy("mi").agg(F.sum("kept").alias("kept"))
    a = t.agg(F.struct(F.avg("kept").alias("m"), _n().alias("n")).alias("s")).scalar()
    g = t.groupBy(F.pmod("mi", F.lit(year)).cast("int").alias("slot")).agg(F.avg("kept").alias("v")).withColumn("s", a)
    return g.where(F.col("s.n") >= min_periods).select("slot", F.least(F.greatest(F.col("v") / F.col("s.m"), F.lit(0.5)), F.lit(2.0)).alias("k"))


def consistent_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value only when all source rows agree, with the least and the greatest shown."""
    same = (F.min(value) == F.max(value)) & (F.count(value) == _n())
    return df.groupBy(*keys).agg(F.when(same, F.max(value)).alias(value), F.min(value).alias("lo"), F.max(value).alias("hi"))


def collapse_dimension(dim: DataFrame, key: str, names: Sequence[str], flags: Sequence[str], active: Column, seg: str) -> DataFrame:
    """One row per key from many: least name, any flag, liquidated when nothing is active, segment count."""
    return dim.groupBy(key).agg(*[F.min(F.nullif(F.trim(F.col(n)), F.lit(""))).alias(n) for n in names], *[F.bool_or(f).alias(f) for f in flags],
                                (~F.bool_or(F.coalesce(active, F.lit(False)))).alias("liquidated"), F.count_distinct(seg).alias("n_segments"))


def pair_geo(dim: DataFrame, code: str) -> DataFrame:
    """District code per (org, unit) and how many different ones there are."""
    d = dim.select("org", "unit", fc.pad_area_code(code).alias("district")).distinct()
    return d.groupBy("org", "unit").agg(F.min("district").alias("district"), F.count("district").alias("n_districts"))


def level_tie(orgs: DataFrame, mart: DataFrame, value: str) -> DataFrame:
    """Org-level sums against the plan/fact mart per region × period."""
    a = orgs.groupBy("region", "mi").agg(F.sum(value).alias("from_orgs"))
    b = mart.groupBy("region", "mi").agg(F.sum(value).alias("from_mart"))
    return a.join(b, ["region", "mi"], "left").withColumns({"diff": F.col("from_orgs") - F.col("from_mart"), "ratio": fc.share("from_orgs", "from_mart")})
