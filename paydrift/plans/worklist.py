"""Work-list queries: clients are customers (unit = nation, region = its region), months of shipment and order."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import worklist as wl
from .registry import cte, query

NOW = 70


def month_after(x):
    """Each month of an organisation as ``prev`` beside what the next one has (0: nothing), under that month's number.

    The next month comes from a window of the organisation's few rows in place of a self-join; an organisation that stands
    there several times has a row for each, as it would have from the join.
    """
    after = W.partitionBy("org").orderBy("mi").rangeBetween(1, 1)
    known = F.col("mi").isNotNull()
    x = x.select("org", (F.col("mi") + 1).alias("mi"), F.col("fl").alias("prev"), F.when(known, F.max("fl").over(after)).alias("next"), F.when(known, F.count("fl").over(after)).alias("n"))
    return x.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)).cast("int")))).select("org", "mi", "prev", F.coalesce("next", F.lit(0)).alias("fl"))


class Work:
    def __init__(self, i):
        self.i = i

    @cached_property
    def mapping(self):
        n = self.i.table("nation").select(F.col("n_nationkey").alias("old_unit"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") - F.col("n_nationkey") % 2).alias("new_unit"), F.col("n_name").alias("name"))
        return wl.unit_map(n, (4,))

    @cached_property
    def cust(self):
        c = self.i.table("customer").select(F.col("c_custkey").alias("org"), F.col("c_nationkey").alias("old_unit"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
        return c.join(self.mapping, "old_unit")

    @cached_property
    def panel(self):
        return self.i.staged("work_panel", self._panel)

    def _panel(self):
        p = self.i.payroll_by_person.groupBy(F.col("person").alias("org"), "mi").agg(F.count(F.lit(1)).alias("fl"), F.sum("amt").alias("fot"), F.countDistinct("part").alias("staff"))
        return p.join(self.cust.select("org", "old_unit", "unit", "region", "seg").hint("shuffle_hash"), "org").withColumns({"staff": F.col("staff") + F.col("org") % 3, "potential": F.col("org") % 7})

    @cached_property
    def net(self):
        return self.i.staged("work_net", self._net)

    def _net(self):
        f = self.panel.groupBy("unit", "region", "seg", "org").agg(F.lit(1).alias("_"))
        fact = month_after(self.panel.select("org", "mi", "fl")).join(f.drop("_").hint("shuffle_hash"), "org").select("unit", "region", "seg", "org", "mi", F.greatest(F.col("prev") - F.col("fl"), F.lit(0)).alias("outflow_qty"), F.col("prev").alias("base"))
        ret = self.i.payroll_by_person.where("code = 'R'").select(F.col("person").alias("org"), "mi").join(self.cust.select("org", "unit").hint("shuffle_hash"), "org").select("unit", "org", "mi", F.lit(1).alias("return_qty"))
        return wl.outflow_net_returns(fact, ret)

    @cached_property
    def plan(self):
        return self.i.staged("work_plan", self._plan)

    def _plan(self):
        d = F.to_date("o_orderdate")
        o = self.i.table("orders").select(F.col("o_custkey").alias("org"), ((F.year(d) - 1995) * 12 + F.month(d) - 1).alias("mi"), (F.col("o_orderkey") % 11).alias("emp"), (F.col("o_orderkey") % 6).alias("plan"))
        return o.join(self.cust.select("org", "unit"), "org")

    @cached_property
    def fact(self):
        return self.i.staged("work_fact", self._fact)

    def _fact(self):
        p = self.i.payroll.select(F.col("person").alias("org"), "mi", (F.col("part") % 11).alias("emp"), F.lit(1).alias("fact"))
        return p.join(self.cust.select("org", "unit"), "org")

    @cached_property
    def tasks(self):
        return self.i.staged("work_tasks", self._tasks)

    def _tasks(self):
        d = F.to_date("o_orderdate")
        k = F.col("o_orderkey")
        o = self.i.table("orders").select(
            F.col("o_custkey").alias("org"), ((F.year(d) - 1995) * 12 + F.month(d) - 1).alias("mi"), F.when(k % 3 == 0, "call").when(k % 3 == 1, "meeting").alias("last_active_type"), (F.col("o_orderstatus") == "F").alias("is_task_closed"),
            (F.col("o_orderstatus") == "F").alias("is_task_closed_success"), F.lit(None).cast("boolean").alias("is_task_in_progress"), F.col("o_orderpriority").alias("task_text_status"), (k % 4).alias("plan_staff_deal_qty"), (k % 3).alias("fact_staff_deal_qty"),
            F.when(k % 5 == 0, "D").alias("deal_code"), d.alias("deal_create_dttm"), d.alias("last_active_dttm"), F.when(k % 2 == 0, "outflow").otherwise("other").alias("task_type"), F.lit("").alias("task_comment"), F.lit("").alias("task_questionnaire"))
        return wl.task_flags(o, "2000-10-01", "%urgent%").join(self.cust.select("org", "unit", "region"), "org")

    @cached_property
    def conv(self):
        return wl.conversion(self.plan, self.fact, self.mapping, NOW, 1200)

    @cached_property
    def cands(self):
        pipe = wl.pipeline_current(self.plan, self.fact, self.conv, NOW, 0.5).select("unit", "org", F.col("expected").alias("pipe"))
        out = wl.outflow_worked(wl.org_outflow(self.net, NOW - 3, NOW - 1), wl.funnel_months(self.tasks, "outflow"), (NOW - 3, NOW))
        t = wl.funnel_agg(self.tasks.where(F.col("mi").between(NOW - 3, NOW - 1)))
        o = self.cust.select("unit", "region", "org", "seg", (F.col("org") % 9).cast("double").alias("potential"), F.abs("c_acctbal").alias("potential_fot"), (F.abs("c_acctbal") / 10).alias("avg_salary"))
        j = o.join(pipe, ["unit", "org"], "left").na.fill(0, ["pipe"]).join(out, ["unit", "org"], "left").join(t, ["unit", "org"], "left").join(wl.deals_due(self.plan, self.fact, NOW), ["unit", "org"], "left")
        return self.i.staged("work_candidates", lambda: wl.work_or_skip(wl.candidates(j)))


# ------------------------------------------------------------- SQL twins
cte("um", "SELECT n_nationkey AS old_unit, n_regionkey AS region, n_nationkey - n_nationkey % 2 AS unit, n_name AS name FROM nation WHERE n_regionkey <> 4")
cte("cu", "SELECT c_custkey AS org, c_nationkey AS old_unit, c_mktsegment AS seg, c_acctbal, region, unit FROM customer JOIN um ON old_unit = c_nationkey", "um")
cte("pn", "SELECT p.*, c.old_unit, c.unit, c.region, c.seg, p.org % 7 AS potential FROM (SELECT person AS org, mi, count(*) AS fl, sum(amt) AS fot, count(DISTINCT part) + person % 3 AS staff FROM payroll GROUP BY 1, 2) p JOIN cu c USING (org)", "payroll", "cu")
cte("nr", """SELECT c.unit, c.region, c.seg, p.org, p.mi + 1 AS mi, greatest(p.fl - coalesce(x.fl, 0), 0) AS outflow_qty, p.fl AS base, coalesce((SELECT count(*) FROM payroll r WHERE r.code = 'R' AND r.person = p.org AND r.mi = p.mi + 1), 0) AS ret
 FROM pn p LEFT JOIN pn x ON x.org = p.org AND x.mi = p.mi + 1 JOIN cu c ON c.org = p.org""", "pn", "cu", "payroll")
cte("nt", "SELECT *, greatest(outflow_qty - ret, 0) AS kept FROM nr", "nr")
_MI = "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER)"
cte("wp", f"SELECT o_custkey AS org, {_MI} AS mi, o_orderkey % 11 AS emp, o_orderkey % 6 AS plan, unit FROM orders JOIN cu ON org = o_custkey", "cu")
cte("wf", "SELECT p.person AS org, p.mi, p.part % 11 AS emp, 1 AS fact, c.unit FROM payroll p JOIN cu c ON c.org = p.person", "payroll", "cu")
cte("tk", f"""SELECT o_custkey AS org, {_MI} AS mi, CASE WHEN o_orderkey % 3 = 0 THEN 'call' WHEN o_orderkey % 3 = 1 THEN 'meeting' END AS act, o_orderstatus = 'F' AS ok, o_orderstatus <> 'F' AS ip, o_orderpriority ILIKE '%urgent%' AS od, o_orderkey % 4 AS plan, o_orderkey % 3 AS fact,
  (o_orderkey % 4 > 0 OR o_orderkey % 5 = 0) AS de, (o_orderkey % 4 > 0 AND o_orderdate >= '2000-10-01') AS fd, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'outflow' ELSE 'other' END AS tt, unit, region FROM orders JOIN cu ON org = o_custkey""", "cu")
cte("cv", f"""WITH f AS (SELECT unit, org, emp, mi, sum(fact) AS fact FROM wf GROUP BY 1, 2, 3, 4), p AS (SELECT w.unit, w.org, w.emp, w.mi, sum(plan) AS plan FROM wp w WHERE mi < {NOW} GROUP BY 1, 2, 3, 4),
 j AS (SELECT p.*, coalesce(f.fact, 0) AS fact, r.region FROM p LEFT JOIN f USING (unit, org, emp, mi) LEFT JOIN (SELECT unit, min(region) AS region FROM um GROUP BY 1) r ON r.unit = p.unit),
 u AS (SELECT unit, sum(plan) AS up, sum(fact) AS uf FROM j GROUP BY 1), rg AS (SELECT region, CASE WHEN sum(plan) > 0 THEN least(greatest(sum(fact) / sum(plan), 0.2), 1.0) END AS kr FROM j GROUP BY 1), w AS (SELECT CASE WHEN sum(plan) > 0 THEN least(greatest(sum(fact) / sum(plan), 0.2), 1.0) END AS kw FROM j)
 SELECT a.unit, m.region, coalesce(CASE WHEN up >= 1200 THEN least(greatest(uf / up, 0.2), 1.0) END, kr, kw) AS k, CASE WHEN up >= 1200 THEN 'unit' WHEN kr IS NOT NULL THEN 'region' ELSE 'whole' END AS source
 FROM (SELECT DISTINCT unit FROM wp) a LEFT JOIN (SELECT unit, min(region) AS region FROM um GROUP BY 1) m USING (unit) LEFT JOIN u USING (unit) LEFT JOIN rg ON rg.region = m.region, w""", "wp", "wf", "um")
cte("pc", f"""SELECT p.unit, p.org, CAST(p.plan AS BIGINT) AS plan, CAST(coalesce(f.fact, 0) AS BIGINT) AS fact, CAST(greatest(p.plan - coalesce(f.fact, 0), 0) AS BIGINT) AS rest, coalesce(f.fact, 0) + greatest(p.plan - coalesce(f.fact, 0), 0) * avg(k) * 0.5 AS expected
 FROM (SELECT unit, org, sum(plan) AS plan FROM wp WHERE mi = {NOW} GROUP BY 1, 2) p LEFT JOIN (SELECT unit, org, sum(fact) AS fact FROM wf WHERE mi = {NOW} GROUP BY 1, 2) f USING (unit, org) LEFT JOIN cv USING (unit) GROUP BY 1, 2, 3, 4, 5, p.plan, f.fact""", "wp", "wf", "cv")
cte("oo", f"SELECT unit, org, CAST(sum(outflow_qty) AS BIGINT) AS out_qty, CAST(sum(ret) AS BIGINT) AS ret_qty, CAST(sum(kept) AS BIGINT) AS kept, list_sort(list(DISTINCT mi) FILTER (WHERE kept > 0)) AS ms FROM nt WHERE mi BETWEEN {NOW - 3} AND {NOW - 1} GROUP BY 1, 2", "nt")
cte("fm", "SELECT unit, org, mi, count(*) AS n_tasks, count(*) FILTER (WHERE ok) AS n_success, count(*) FILTER (WHERE tt = 'outflow') AS n_outflow, count(*) FILTER (WHERE tt = 'outflow' AND ok) AS n_out_success FROM tk GROUP BY 1, 2, 3", "tk")
_LK = "FROM fm f, (SELECT unnest(list_concat(o.ms, list_transform(o.ms, lambda v: v + 1))) AS m) q WHERE f.unit = o.unit AND f.org = o.org AND f.mi = q.m"
cte("ow", f"""SELECT o.*, CAST(coalesce((SELECT sum(n_tasks) {_LK}), 0) AS BIGINT) AS out_tasks, CAST(coalesce((SELECT sum(n_outflow) {_LK}), 0) AS BIGINT) AS out_tasks_outflow, CAST(coalesce((SELECT sum(n_out_success) {_LK}), 0) AS BIGINT) AS out_done FROM oo o""", "oo", "fm")
cte("fa", f"""SELECT unit, org, count(*) AS n_tasks, count(*) FILTER (WHERE act = 'call') AS n_calls, count(*) FILTER (WHERE act = 'meeting') AS n_meetings, count(*) FILTER (WHERE ok) AS n_success, count(*) FILTER (WHERE od) AS n_overdue, count(*) FILTER (WHERE ip) AS n_in_progress,
  count(*) FILTER (WHERE NOT ip) AS n_closed, CAST(coalesce(sum(plan) FILTER (WHERE de AND NOT fd), 0) AS BIGINT) AS plan_old, CAST(coalesce(sum(fact) FILTER (WHERE de AND NOT fd), 0) AS BIGINT) AS fact_old, CAST(coalesce(sum(plan) FILTER (WHERE fd), 0) AS BIGINT) AS plan_fresh,
  max(d) FILTER (WHERE fd) AS fresh_deal_dt, max(d) AS last_active FROM tk WHERE mi BETWEEN {NOW - 3} AND {NOW - 1} GROUP BY 1, 2""", "tk")
cte("du", f"SELECT p.unit, p.org, CAST(sum(plan) AS BIGINT) AS plan_due, count(DISTINCT mi) AS n_months, coalesce((SELECT count(*) FROM wf f WHERE f.unit = p.unit AND f.org = p.org AND f.mi < {NOW}), 0) AS fact_due FROM wp p WHERE mi < {NOW} GROUP BY 1, 2", "wp", "wf")
cte("cd", """WITH o AS (SELECT c.unit, c.region, c.org, c.seg, CAST(c.org % 9 AS DOUBLE) AS potential, abs(c_acctbal) AS pf, abs(c_acctbal) / 10 AS av, coalesce(pc.expected, 0) AS pipe, greatest(coalesce(ow.kept, 0), 0)::DOUBLE AS ret, greatest(CAST(c.org % 9 AS DOUBLE) - coalesce(pc.expected, 0), 0) AS attract,
   out_tasks, out_tasks_outflow, out_done, n_tasks, n_in_progress, n_closed, n_overdue, n_success, fresh_deal_dt, plan_due, fact_due
  FROM cu c LEFT JOIN pc ON pc.unit = c.unit AND pc.org = c.org LEFT JOIN ow ON ow.unit = c.unit AND ow.org = c.org LEFT JOIN fa ON fa.unit = c.unit AND fa.org = c.org LEFT JOIN du ON du.unit = c.unit AND du.org = c.org),
 x AS (SELECT *, CASE WHEN attract >= ret THEN 'attract' ELSE 'return' END AS lever, greatest(attract, ret) AS impact FROM o WHERE attract >= 1 OR ret >= 1)
 SELECT *, CASE WHEN lever = 'attract' THEN pf * coalesce(attract / nullif(potential, 0), 0) ELSE ret * av END AS impact_money,
  CASE WHEN lever = 'return' AND out_done > 0 THEN 'outflow worked' WHEN lever = 'return' AND out_tasks = 0 THEN 'outflow: no tasks' WHEN lever = 'return' AND out_tasks_outflow = 0 THEN 'outflow: other tasks only' WHEN lever = 'return' THEN 'outflow: task not successful'
   WHEN fresh_deal_dt IS NOT NULL THEN 'fresh deal' WHEN coalesce(n_tasks, 0) = 0 THEN 'not worked' WHEN n_in_progress > 0 AND n_closed = 0 AND n_overdue = 0 THEN 'in progress' WHEN coalesce(plan_due, 0) >= 1 AND coalesce(fact_due, 0) < plan_due THEN 'deals below plan'
   WHEN n_overdue > 0 THEN 'overdue tasks' WHEN n_success > 0 THEN 'worked with success' ELSE 'worked without result' END AS reason FROM x""", "cu", "pc", "ow", "fa", "du")
_SKIP = "reason IN ('outflow worked', 'fresh deal', 'in progress', 'worked with success')"
_B = lambda *cols: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


@query("unit_map", f"SELECT {_B('old_unit', 'region', 'unit')}, name FROM um", "um")
def _(i):
    return Work(i).mapping


@query("units_per_region", "SELECT CAST(region AS BIGINT) AS region, count(DISTINCT unit) AS n_units FROM um GROUP BY 1", "um")
def _(i):
    return wl.units_per_region(Work(i).mapping)


@query("org_metrics_rollup", f"""SELECT {_B('region', 'unit', 'org', 'mi', 'fl', 'staff', 'potential')}, CAST(fot AS DOUBLE) AS fot, round(fot / fl, 4) AS avg_salary, round(fl / staff, 4) AS penetration FROM pn""", "pn")
def _(i):
    w = Work(i)
    return wl.org_metrics_rollup(w.panel.select(F.col("old_unit").alias("unit"), "org", "mi", "fl", "fot", "staff", "potential"), w.mapping)


_PF = """SELECT 'unit' AS level, unit AS level_id, seg, mi, CAST(sum(staff) AS DOUBLE) AS plan, CAST(sum(fl) AS DOUBLE) AS fact, CASE WHEN mi <= 71 THEN CAST(sum(fl) AS DOUBLE) * 0.9 END AS pred FROM pn GROUP BY 1, 2, 3, 4 UNION ALL
 SELECT 'region', region, seg, mi, CAST(sum(staff) AS DOUBLE), CAST(sum(fl) AS DOUBLE), CASE WHEN mi <= 71 THEN CAST(sum(fl) AS DOUBLE) * 0.9 END FROM pn GROUP BY 1, 2, 3, 4"""
cte("pf", _PF, "pn")


def planfact(i):
    p = Work(i).panel
    out = None
    for lv, c in (("unit", "unit"), ("region", "region")):
        x = p.groupBy(F.lit(lv).alias("level"), F.col(c).alias("level_id"), "seg", "mi").agg(F.sum("staff").cast("double").alias("plan"), F.sum("fl").cast("double").alias("fact"))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("pred", F.when(F.col("mi") <= 71, F.col("fact") * 0.9))


@query("unit_plan_fact", f"SELECT level, CAST(level_id AS BIGINT) AS level_id, seg, plan, fact, round(pred, 4) AS pred, round(greatest(plan - pred, 0), 4) AS shortfall FROM pf WHERE mi = {NOW}", "pf")
def _(i):
    return wl.unit_plan_fact(planfact(i), ("unit", "region"), NOW)


@query("rank_units", """WITH e AS (SELECT 'fl' AS metric, mi, level, level_id, sum(fact) / sum(plan) AS execution FROM pf GROUP BY 2, 3, 4)
 SELECT metric, CAST(mi AS BIGINT) AS mi, level, CAST(level_id AS BIGINT) AS level_id, round(execution, 4) AS execution, rank() OVER (PARTITION BY metric, mi, level ORDER BY execution DESC) AS rank, count(*) OVER (PARTITION BY metric, mi, level) AS n_units FROM e""", "pf")
def _(i):
    e = planfact(i).groupBy(F.lit("fl").alias("metric"), "mi", "level", "level_id").agg((F.sum("fact") / F.sum("plan")).alias("execution"))
    return wl.rank_units(e)


@query("reference_dates", "SELECT CAST(m AS BIGINT) AS report, CAST(m - 1 AS BIGINT) AS closed, CAST(m - 3 AS BIGINT) AS from_3, CAST(m - 12 AS BIGINT) AS year_ago FROM (SELECT max(mi) FILTER (WHERE pred IS NOT NULL) AS m FROM pf)", "pf")
def _(i):
    return wl.reference_dates(planfact(i))


@query("verdict", f"SELECT level, CAST(mi AS BIGINT) AS mi, CAST(level_id AS BIGINT) AS level_id, round(sum(fact) / sum(plan), 4) AS execution, rank() OVER (PARTITION BY level, mi ORDER BY sum(fact) / sum(plan) DESC) AS rank FROM pf WHERE mi IN ({NOW}, {NOW - 1}, {NOW - 12}) AND level = 'region' GROUP BY level, mi, level_id", "pf")
def _(i):
    e = planfact(i).where((F.col("level") == "region") & F.col("mi").isin(NOW, NOW - 1, NOW - 12)).groupBy(F.lit("fl").alias("metric"), "mi", "level", "level_id").agg((F.sum("fact") / F.sum("plan")).alias("execution"))
    return wl.rank_units(e).drop("metric", "n_units")


cte("mx", f"""WITH p AS (SELECT level_id AS unit, seg, plan FROM pf WHERE level = 'unit' AND mi = {NOW}), q AS (SELECT level_id AS unit, seg, pred FROM pf WHERE level = 'unit' AND mi = {NOW}), b AS (SELECT level_id AS unit, seg, fact AS base FROM pf WHERE level = 'unit' AND mi = {NOW - 1})
 SELECT unit, seg, plan, pred, base, CASE WHEN plan <> 0 THEN pred / plan END AS execution, CASE WHEN pred IS NULL AND plan IS NULL THEN 0.0 ELSE greatest(plan - pred, 0.0) END AS shortfall, pred IS NULL AS no_prediction FROM p FULL JOIN q USING (unit, seg) FULL JOIN b USING (unit, seg)""", "pf")


def matrix(i):
    u = planfact(i).where("level = 'unit'").withColumnRenamed("level_id", "unit")
    now = u.where(F.col("mi") == NOW)
    return wl.unit_matrix(now.select("unit", "seg", "plan"), now.select("unit", "seg", "pred"), u.where(F.col("mi") == NOW - 1).select("unit", "seg", F.col("fact").alias("base")))


@query("unit_matrix", "SELECT CAST(unit AS BIGINT) AS unit, seg, plan, round(pred, 4) AS pred, base, round(execution, 4) AS execution, round(shortfall, 4) AS shortfall, no_prediction FROM mx", "mx")
def _(i):
    return matrix(i)


@query("matrix_totals", "SELECT seg, sum(plan) AS plan, round(sum(pred), 4) AS pred, round(sum(shortfall), 4) AS shortfall, count(*) FILTER (WHERE no_prediction) AS n_no_prediction FROM mx GROUP BY 1", "mx")
def _(i):
    return wl.matrix_totals(matrix(i), ["seg"])


@query("conversion", f"SELECT {_B('unit', 'region')}, round(k, 4) AS k, source FROM cv", "cv")
def _(i):
    return Work(i).conv


@query("pipeline_plan", """WITH x AS (SELECT c.unit, c.org, o_orderkey % 11 AS emp, o_orderkey AS deal, CAST(o_orderdate AS DATE) AS d, o_orderkey % 14 AS n, o_orderkey % 6 AS plan FROM orders JOIN cu c ON c.org = o_custkey),
 y AS (SELECT *, CASE WHEN n BETWEEN 1 AND 12 THEN (n - month(d) + 12) % 12 END AS off FROM x)
 SELECT CAST(unit AS BIGINT) AS unit, org, emp, strftime(last_day(date_trunc('month', d) + to_months(CAST(off AS INTEGER))), '%Y-%m-%d') AS month, CAST(sum(plan) AS BIGINT) AS plan, count(DISTINCT deal) AS n_deals FROM y WHERE off <= 2 GROUP BY 1, 2, 3, 4""", "cu")
def _(i):
    w, k = Work(i), F.col("o_orderkey")
    o = i.table("orders").select(k.alias("deal"), F.col("o_custkey").alias("org"), (k % 11).alias("emp"), F.to_date("o_orderdate").alias("created"), (k % 14).cast("int").alias("month_no"), (k % 6).alias("plan"))
    return wl.pipeline_plan(o.select("deal", "org", "emp", "created").join(w.cust.select("org", "unit"), "org"), o.select("deal", "month_no", "plan"))


@query("pipeline_current", f"SELECT {_B('unit')}, org, plan, fact, rest, round(expected, 4) AS expected FROM pc", "pc")
def _(i):
    w = Work(i)
    return wl.pipeline_current(w.plan, w.fact, w.conv, NOW, 0.5)


@query("deals_due", f"SELECT {_B('unit')}, org, plan_due, n_months, fact_due FROM du", "du")
def _(i):
    w = Work(i)
    return wl.deals_due(w.plan, w.fact, NOW)


@query("funnel_agg", f"SELECT * REPLACE (CAST(unit AS BIGINT) AS unit, strftime(fresh_deal_dt, '%Y-%m-%d') AS fresh_deal_dt, strftime(last_active, '%Y-%m-%d') AS last_active) FROM fa", "fa")
def _(i):
    return wl.funnel_agg(Work(i).tasks.where(F.col("mi").between(NOW - 3, NOW - 1)))


@query("funnel_months", f"SELECT * REPLACE ({_B('unit', 'mi')}) FROM fm", "fm")
def _(i):
    return wl.funnel_months(Work(i).tasks, "outflow")


@query("activity_totals", "SELECT CAST(region AS BIGINT) AS region, count(*) AS n_tasks, count(DISTINCT CASE WHEN org % 10 > 0 THEN org END) AS n_orgs, count(*) FILTER (WHERE org % 10 = 0) AS n_no_org FROM tk GROUP BY 1", "tk")
def _(i):
    return wl.activity_totals(Work(i).tasks.withColumn("org", F.when(F.col("org") % 10 > 0, F.col("org"))))


@query("org_manager", """WITH a AS (SELECT c.unit, c.org, o_orderkey % 40 AS emp, CAST(o_orderdate AS DATE) AS d FROM orders JOIN cu c ON c.org = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'),
 b AS (SELECT unit, org, arg_max(emp, (d, emp)) AS emp FROM a GROUP BY 1, 2), s AS (SELECT c_custkey % 40 AS emp, arg_max(c_name, (c_nationkey, c_name)) AS name FROM customer GROUP BY 1)
 SELECT CAST(unit AS BIGINT) AS unit, org, b.emp, name FROM b LEFT JOIN s USING (emp)""", "cu")
def _(i):
    w = Work(i)
    a = i.table("orders").select(F.col("o_custkey").alias("org"), (F.col("o_orderkey") % 40).alias("emp"), F.col("o_orderpriority").alias("role"), F.to_date("o_orderdate").alias("start_dt"),
                                 F.when(F.col("o_orderstatus") == "F", F.lit("2001-01-01")).alias("end_dt")).join(w.cust.select("org", "unit"), "org")
    s = i.table("customer").select((F.col("c_custkey") % 40).alias("emp"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("report_dt"))
    return wl.org_manager(a, s, "1-URGENT")


@query("outflow_net_returns", f"SELECT * REPLACE ({_B('unit', 'region', 'mi')}) FROM nt", "nt")
def _(i):
    return Work(i).net


@query("org_outflow", f"SELECT {_B('unit')}, org, out_qty, ret_qty, kept, array_to_string(coalesce(ms, []), ',') AS months FROM oo", "oo")
def _(i):
    return wl.org_outflow(Work(i).net, NOW - 3, NOW - 1).withColumn("months", F.array_join(F.transform("out_months", lambda m: m.cast("string")), ",")).drop("out_months")


@query("outflow_with_pipeline", f"""WITH o AS (SELECT oo.*, s.seg FROM oo JOIN (SELECT unit, org, max(CASE WHEN org % 5 <> 0 THEN seg END) AS seg FROM nt WHERE mi BETWEEN {NOW - 3} AND {NOW - 1} GROUP BY 1, 2) s USING (unit, org)),
 d AS (SELECT pc.*, CASE WHEN org % 3 = 0 THEN 'DEAL' END AS seg FROM pc), c AS (SELECT c_custkey AS org, c_mktsegment AS seg FROM customer WHERE c_custkey % 4 <> 0),
 j AS (SELECT coalesce(o.unit, d.unit) AS unit, coalesce(o.org, d.org) AS org, o.seg AS s1, d.seg AS s2, out_qty, ret_qty, kept, ms, plan, fact, rest, expected FROM o FULL JOIN d ON o.unit = d.unit AND o.org = d.org)
 SELECT CAST(unit AS BIGINT) AS unit, j.org, coalesce(s1, s2, c.seg) AS seg, CASE WHEN s1 IS NOT NULL THEN 'outflow' WHEN s2 IS NOT NULL THEN 'deal' WHEN c.seg IS NOT NULL THEN 'directory' END AS seg_source, coalesce(out_qty, 0) AS out_qty, coalesce(ret_qty, 0) AS ret_qty, coalesce(kept, 0) AS kept,
  array_to_string(coalesce(ms, []), ',') AS months, coalesce(plan, 0) AS plan, coalesce(fact, 0) AS fact, coalesce(rest, 0) AS rest, round(coalesce(expected, 0), 4) AS expected FROM j LEFT JOIN c ON c.org = j.org""", ("oo", "nt", "pc"))
def _(i):
    w = Work(i)
    net = w.net.withColumn("seg", F.when(F.col("org") % 5 == 0, " ").otherwise(F.col("seg")))
    pipe = wl.pipeline_current(w.plan, w.fact, w.conv, NOW, 0.5).withColumn("seg_deal", F.when(F.col("org") % 3 == 0, "DEAL"))
    x = wl.outflow_with_pipeline(net, pipe, w.cust.where("org % 4 <> 0").select("org", "seg"), NOW - 3, NOW - 1)
    return x.withColumn("months", F.array_join(F.transform("out_months", lambda m: m.cast("string")), ",")).drop("out_months")


@query("outflow_worked", f"SELECT {_B('unit')}, org, out_qty, ret_qty, kept, out_tasks, out_tasks_outflow, out_done, true AS known, out_done > 0 AS out_worked FROM ow", "ow")
def _(i):
    w = Work(i)
    return wl.outflow_worked(wl.org_outflow(w.net, NOW - 3, NOW - 1), wl.funnel_months(w.tasks, "outflow"), (NOW - 3, NOW)).drop("out_months")


@query("candidates", f"SELECT {_B('unit', 'region')}, org, seg, lever, round(impact, 4) AS impact, round(impact_money, 6) AS impact_money FROM cd", "cd", digits=6)
def _(i):
    return Work(i).cands.select("unit", "region", "org", "seg", "lever", "impact", "impact_money")


@query("work_or_skip", f"SELECT {_B('unit')}, org, reason, CASE WHEN {_SKIP} THEN 'skip' ELSE 'work' END AS decision FROM cd", "cd")
def _(i):
    return Work(i).cands.select("unit", "org", "reason", "decision")


@query("note_audit", f"""SELECT {_B('unit')}, org, reason, CASE WHEN org % 5 = 0 THEN 'checklist' WHEN org % 7 = 0 THEN 'deadline' WHEN org % 3 = 0 THEN 'keyword' ELSE 'none' END AS audit_source,
 CASE WHEN org % 5 = 0 THEN 'gone' WHEN org % 7 = 0 THEN 'until 09.2001' WHEN org % 3 = 0 THEN 'other bank' END AS audit_reason, CASE WHEN org % 5 = 0 OR org % 7 = 0 THEN 'skip' WHEN org % 3 = 0 THEN 'work' WHEN {_SKIP} THEN 'skip' ELSE 'work' END AS decision,
 (CASE WHEN org % 5 = 0 OR org % 7 = 0 THEN 'skip' WHEN org % 3 = 0 THEN 'work' WHEN {_SKIP} THEN 'skip' ELSE 'work' END) <> CASE WHEN {_SKIP} THEN 'skip' ELSE 'work' END AS moved FROM cd""", "cd")
def _(i):
    w, o = Work(i), F.col("org")
    s = lambda r, v: F.struct(F.lit(r).alias("reason"), F.lit(v).alias("verdict"))
    notes = w.cust.select("unit", "org", F.when(o % 5 == 0, s("gone", "no_point")).alias("checklist"), F.when(o % 7 == 0, F.lit("09.2001")).alias("deadline"), F.when(o % 3 == 0, s("other bank", "work")).alias("keyword"))
    return wl.note_audit(w.cands.select("unit", "org", "reason", "decision"), notes)


cte("gp", "SELECT unit, seg, CAST(count(*) AS DOUBLE) AS gap FROM cu GROUP BY 1, 2", "cu")
cte("wk", f"SELECT unit, seg, org, round(impact, 4) AS impact FROM cd WHERE NOT {_SKIP}", "cd")


def _need(k):
    return f"""o{int(k * 10)} AS (SELECT unit, org, false AS filler, impact, seg FROM (SELECT w.*, g.gap * {k} AS t, coalesce(sum(w.impact) OVER (PARTITION BY w.unit, w.seg ORDER BY w.impact DESC, w.org ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM wk w JOIN gp g USING (unit, seg)) WHERE b < t - 1e-9),
 l{int(k * 10)} AS (SELECT unit, sum(greatest(gap * {k} - coalesce(got, 0), 0)) AS t FROM gp LEFT JOIN (SELECT unit, seg, sum(impact) AS got FROM o{int(k * 10)} GROUP BY 1, 2) USING (unit, seg) GROUP BY 1),
 f{int(k * 10)} AS (SELECT unit, org FROM (SELECT w.unit, w.org, l.t, coalesce(sum(w.impact) OVER (PARTITION BY w.unit ORDER BY w.impact DESC, w.org ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM wk w JOIN l{int(k * 10)} l USING (unit) WHERE l.t > 0 AND (w.unit, w.org) NOT IN (SELECT (unit, org) FROM o{int(k * 10)})) WHERE b < t - 1e-9)"""


cte("gc", "SELECT * FROM (WITH " + ", ".join(_need(k) for k in (1.0, 1.2, 1.5)) + ", p AS (" + " UNION ALL ".join(f"SELECT unit, org, {k} AS k, false AS filler FROM o{int(k * 10)} UNION ALL SELECT unit, org, {k}, true FROM f{int(k * 10)}" for k in (1.0, 1.2, 1.5))
    + "), b AS (SELECT unit, org, min(k) AS need_k, arg_min(filler, k) AS filler FROM p GROUP BY 1, 2) SELECT w.*, CAST(coalesce(need_k, 0) AS DOUBLE) AS need_k, coalesce(filler, false) AS filler FROM wk w LEFT JOIN b USING (unit, org))", "wk", "gp")


def cover(i):
    w = Work(i)
    gaps = w.cust.groupBy("unit", "seg").agg(F.count(F.lit(1)).cast("double").alias("gap"))
    rows = w.cands.where("decision = 'work'").select("unit", "region", "seg", "org", F.round("impact", 4).alias("impact"))
    return wl.greedy_cover(rows, gaps, width=2.0)


@query("greedy_cover", f"SELECT {_B('unit')}, seg, org, impact, need_k, filler FROM gc", "gc")
def _(i):
    return cover(i).drop("region")


@query("plan_effect", f"SELECT {_B('unit')}, count(*) AS n_need, round(sum(impact), 4) AS impact, count(*) FILTER (WHERE filler) AS n_fill, round(coalesce(sum(impact) FILTER (WHERE filler), 0), 4) AS impact_fill FROM gc WHERE need_k > 0 AND need_k <= 1.0 GROUP BY unit", "gc")
def _(i):
    return wl.plan_effect(cover(i), ["unit"])


@query("plan_effect_region", "SELECT CAST(region AS BIGINT) AS region, count(*) AS n_need, round(sum(impact), 4) AS impact, count(*) FILTER (WHERE filler) AS n_fill, round(coalesce(sum(impact) FILTER (WHERE filler), 0), 4) AS impact_fill FROM gc JOIN (SELECT org, region FROM cu) USING (org) WHERE need_k > 0 AND need_k <= 1.0 GROUP BY 1", ("gc", "cu"))
def _(i):
    return wl.plan_effect(cover(i), ["region"])


@query("unit_detail", f"""WITH g AS (SELECT unit, org, CASE WHEN ret_qty = 0 THEN 'none returned' ELSE 'partly returned' END AS grp, CAST(kept AS DOUBLE) AS amount FROM oo WHERE kept > 0 UNION ALL
  SELECT unit, org, 'year drop', CAST(a - n AS DOUBLE) FROM (SELECT unit, org, coalesce(sum(fl) FILTER (WHERE mi = {NOW}), 0) AS n, coalesce(sum(fl) FILTER (WHERE mi = {NOW - 12}), 0) AS a FROM pn WHERE mi IN ({NOW}, {NOW - 12}) GROUP BY 1, 2) WHERE n < a),
 x AS (SELECT *, row_number() OVER w AS r, sum(amount) OVER (PARTITION BY unit, grp) AS t, coalesce(sum(amount) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g WINDOW w AS (PARTITION BY unit, grp ORDER BY amount DESC, org))
 SELECT CAST(unit AS BIGINT) AS unit, org, grp, amount, t AS group_total FROM x WHERE r <= 8 AND b < 0.6 * t""", ("oo", "pn"))
def _(i):
    w = Work(i)
    g = w.panel.where(F.col("mi").isin(NOW, NOW - 12)).groupBy("unit", "org").agg(*[F.coalesce(F.sum(F.when(F.col("mi") == m, F.col("fl"))), F.lit(0)).alias(n) for n, m in (("now", NOW), ("ago", NOW - 12))])
    return wl.unit_detail(wl.org_outflow(w.net, NOW - 3, NOW - 1), g)


@query("outflow_by_agency", f"""SELECT seg, CAST(sum(outflow_qty) AS BIGINT) AS out_qty, CAST(sum(ret) AS BIGINT) AS ret_qty, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(base) AS BIGINT) AS base, count(DISTINCT org) AS n_orgs, round(sum(outflow_qty) / greatest(sum(base), 1), 4) AS out_rate,
 round(sum(ret) / greatest(sum(outflow_qty), 1), 4) AS ret_rate, round(sum(kept) / (SELECT sum(kept) FROM nt WHERE mi = {NOW}), 4) AS share FROM nt WHERE mi = {NOW} GROUP BY 1""", "nt")
def _(i):
    return wl.outflow_by(Work(i).net, NOW, "seg")


@query("outflow_trend", "SELECT CAST(mi AS BIGINT) AS mi, CAST(sum(outflow_qty) AS BIGINT) AS out_qty, CAST(sum(ret) AS BIGINT) AS ret_qty, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(base) AS BIGINT) AS base, round(sum(outflow_qty) / greatest(sum(base), 1), 4) AS out_rate FROM nt GROUP BY 1", "nt")
def _(i):
    return wl.outflow_trend(Work(i).net)


cte("cs", f"""WITH t AS (SELECT org, sum(fl) FILTER (WHERE mi = {NOW - 6}) AS fb, sum(staff) FILTER (WHERE mi = {NOW - 6}) AS sb, sum(fl) FILTER (WHERE mi = {NOW}) AS fn, sum(staff) FILTER (WHERE mi = {NOW}) AS sn FROM pn GROUP BY 1),
 x AS (SELECT *, greatest(fb - fn, 0) AS d, least(greatest(sb - sn, 0), greatest(fb - fn, 0)) AS c FROM t WHERE fb IS NOT NULL AND fn IS NOT NULL)
 SELECT org, CAST(fb AS BIGINT) AS fl_base, CAST(sb AS BIGINT) AS staff_base, CAST(fn AS BIGINT) AS fl_now, CAST(sn AS BIGINT) AS staff_now, CAST(d AS BIGINT) AS "drop", CAST(c AS BIGINT) AS staff_cut, CAST(d - c AS BIGINT) AS competitor,
  CASE WHEN d <= 0 THEN 'none' WHEN c / d >= 0.6 THEN 'staff cut' WHEN 1 - c / d >= 0.6 THEN 'competitor' ELSE 'mixed' END AS cause FROM x""", "pn")


@query("cause_split", "SELECT * FROM cs", "cs")
def _(i):
    return wl.cause_split(Work(i).panel, NOW - 6, NOW)


@query("cause_by_region", 'SELECT CAST(region AS BIGINT) AS region, CAST(sum("drop") AS BIGINT) AS "drop", CAST(sum(staff_cut) AS BIGINT) AS staff_cut, CAST(sum(competitor) AS BIGINT) AS competitor, count(*) AS n_orgs, round(sum(staff_cut) / greatest(sum("drop"), 1), 4) AS staff_share FROM cs JOIN (SELECT org, region FROM cu) USING (org) GROUP BY 1', ("cs", "cu"))
def _(i):
    w = Work(i)
    return wl.cause_by(wl.cause_split(w.panel, NOW - 6, NOW).join(w.cust.select("org", "region"), "org"), "region")


@query("macro", f"""WITH g AS (SELECT region, sum(fl) FILTER (WHERE mi = {NOW}) AS fl, sum(staff) FILTER (WHERE mi = {NOW}) AS st, sum(fot) FILTER (WHERE mi = {NOW}) AS fot, sum(fl) FILTER (WHERE mi = {NOW - 12}) AS ago FROM pn GROUP BY 1), p AS (SELECT level_id AS region, sum(plan) AS plan, sum(fact) AS fact FROM pf WHERE level = 'region' AND mi = {NOW} GROUP BY 1)
 SELECT CAST(g.region AS BIGINT) AS region, CAST(fl AS BIGINT) AS fl, round(fl / st, 4) AS penetration, round(fot / fl, 4) AS pay, round((fl - ago) / ago, 4) + 0.0 AS growth, round(fact / plan, 4) AS execution FROM g LEFT JOIN p USING (region)""", ("pn", "pf"))
def _(i):
    return wl.macro(Work(i).panel, planfact(i).where("level = 'region'").withColumnRenamed("level_id", "region"), NOW)


@query("snapshot_asof", "SELECT org, min(seg) AS seg FROM pn WHERE mi = (SELECT max(mi) FROM pn WHERE mi <= 64) GROUP BY 1", "pn")
def _(i):
    return wl.snapshot_asof(Work(i).panel.select("org", "mi", "seg"), 64, "org", "seg")


cte("sr", "SELECT seg, mi, sum(fl) AS fl, coalesce((SELECT sum(kept) FROM nt WHERE nt.seg = pn.seg AND nt.mi = pn.mi), 0) AS kept FROM pn GROUP BY 1, 2", "pn", "nt")
cte("sn", "WITH t AS (SELECT mi, sum(kept) AS kept FROM nt GROUP BY 1) SELECT CAST(mi % 12 AS INTEGER) AS slot, least(greatest(avg(kept) / (SELECT avg(kept) FROM t), 0.5), 2.0) AS k FROM t GROUP BY 1", "nt")


@query("outflow_season", "SELECT CAST(slot AS BIGINT) AS slot, round(k, 4) AS k FROM sn", "sn")
def _(i):
    return wl.outflow_season(Work(i).net)


_PATH = f"""WITH RECURSIVE s AS (SELECT *, fl - lag(fl) OVER (PARTITION BY seg ORDER BY mi) + kept AS inn FROM sr WHERE mi <= {NOW}), t AS (SELECT seg, avg(kept) AS om, max(kept)::DOUBLE AS ow, avg(inn) AS im, max(inn)::DOUBLE AS ib FROM s WHERE inn IS NOT NULL AND mi > {NOW - 6} GROUP BY 1),
 c AS (SELECT t.seg, v.scenario, CASE WHEN v.scenario = 'risk' THEN ow ELSE om END AS o, CASE WHEN v.scenario = 'recover' THEN ib ELSE im END AS i, (SELECT CAST(fl AS DOUBLE) FROM sr WHERE sr.seg = t.seg AND sr.mi = {NOW}) AS f FROM t, (VALUES ('hold'), ('recover'), ('risk')) v(scenario)),
 p AS (SELECT seg, scenario, {NOW} AS mi, f AS fl_start, 0::DOUBLE AS "out", 0::DOUBLE AS inflow, f AS fl_end, o, i FROM c UNION ALL
  SELECT p.seg, p.scenario, p.mi + 1, p.fl_end, least(p.o * k, p.fl_end), p.i, p.fl_end - least(p.o * k, p.fl_end) + p.i, p.o, p.i FROM p JOIN sn ON sn.slot = (p.mi + 1) % 12 WHERE p.mi < {NOW + 6})"""


def paths(i):
    w = Work(i)
    s = w.panel.groupBy("seg", "mi").agg(F.sum("fl").alias("fl")).join(w.net.groupBy("seg", "mi").agg(F.sum("kept").alias("kept")), ["seg", "mi"], "left").na.fill(0, ["kept"])
    return wl.scenario_forecast(s, "seg", NOW, 6, 6, wl.outflow_season(w.net))


@query("scenario_forecast", _PATH + f' SELECT seg, scenario, CAST(mi AS BIGINT) AS mi, round(fl_start, 2) AS fl_start, round("out", 2) AS "out", round(inflow, 2) + 0.0 AS inflow, round(fl_end, 2) AS fl_end FROM p WHERE mi > {NOW}', ("sr", "sn"), digits=2)
def _(i):
    return paths(i)


@query("scenario_summary", _PATH + f""" SELECT scenario, round(sum(fl_start) FILTER (WHERE mi = {NOW + 1}), 2) AS fl_base, round(sum("out"), 2) AS "out", round(sum(inflow), 2) + 0.0 AS inflow, round(sum(fl_end) FILTER (WHERE mi = {NOW + 6}), 2) AS fl_end,
 round(sum(fl_end) FILTER (WHERE mi = {NOW + 6}) - sum(fl_start) FILTER (WHERE mi = {NOW + 1}), 2) + 0.0 AS delta, 0.0::DOUBLE AS residual FROM p WHERE mi > {NOW} GROUP BY 1""", ("sr", "sn"), digits=2)
def _(i):
    return wl.scenario_summary(paths(i), NOW)


@query("consistent_value", "SELECT c_nationkey, CASE WHEN min(v) = max(v) AND count(v) = count(*) THEN max(v) END AS v, min(v) AS lo, max(v) AS hi FROM (SELECT c_nationkey::BIGINT AS c_nationkey, CASE WHEN c_nationkey < 10 THEN 'same' ELSE c_mktsegment END AS v FROM customer) GROUP BY 1")
def _(i):
    return wl.consistent_value(i.table("customer").select("c_nationkey", F.when(F.col("c_nationkey") < 10, "same").otherwise(F.col("c_mktsegment")).alias("v")), ["c_nationkey"], "v")


@query("collapse_dimension", "SELECT c_nationkey::BIGINT AS c_nationkey, min(c_name) AS c_name, bool_or(c_acctbal < 0) AS debt, NOT bool_or(c_acctbal > 9990) AS liquidated, count(DISTINCT c_mktsegment) AS n_segments FROM customer GROUP BY 1")
def _(i):
    return wl.collapse_dimension(i.table("customer").withColumn("debt", F.col("c_acctbal") < 0), "c_nationkey", ["c_name"], ["debt"], F.col("c_acctbal") > 9990, "c_mktsegment")


@query("pair_geo", "SELECT org, unit::BIGINT AS unit, min(d) AS district, count(DISTINCT d) AS n_districts FROM (SELECT s_nationkey::BIGINT AS org, s_suppkey % 3 AS unit, substr(lpad(CAST(s_suppkey * 1000 + 7 AS VARCHAR), 8, '0'), 1, 5) AS d FROM supplier) GROUP BY 1, 2")
def _(i):
    return wl.pair_geo(i.table("supplier").select(F.col("s_nationkey").alias("org"), (F.col("s_suppkey") % 3).alias("unit"), (F.col("s_suppkey") * 1000 + 7).alias("code")), "code")


@query("level_tie", "SELECT CAST(region AS BIGINT) AS region, CAST(mi AS BIGINT) AS mi, CAST(sum(fl) AS BIGINT) AS from_orgs, CAST(sum(fl) AS DOUBLE) AS from_mart, 0.0::DOUBLE AS diff, 1.0::DOUBLE AS ratio FROM pn GROUP BY 1, 2", "pn")
def _(i):
    return wl.level_tie(Work(i).panel, planfact(i).where("level = 'region'").select(F.col("level_id").alias("region"), "mi", F.col("fact").alias("fl")), "fl")
