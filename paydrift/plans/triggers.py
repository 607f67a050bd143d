"""Trigger queries; organisations are parts (metrics) and suppliers (outflow), end month 2001-07."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import series as se
from ..operators import triggers as tg
from ..session import shared_dir
from ..sources import marts
from .registry import cte, query

END, MONTH, MDATE = 78, "2001-07", "2001-07-31"
_S = "{} AS trigger_name"


class Stage:
    def __init__(self, i):
        self.i = i

    @cached_property
    def metrics(self):
        p = self.i.payroll.groupBy(F.col("part").alias("org"), "mi").agg(
            F.sum("amt").alias("fot_amt"), F.countDistinct("person").alias("fl_qty"), F.countDistinct(F.when(F.col("code") == "R", F.col("person"))).alias("new_fl_cnt"))
        full = se.scaffold(p.where(F.col("mi").between(END - 24, END)), ["org"], END - 24, END, ["fot_amt", "fl_qty", "new_fl_cnt"])
        w = W.partitionBy("org").orderBy("mi")
        part = self.i.table("part").select(F.col("p_partkey").alias("org"), "p_size")
        x = full.withColumn("np_cnt", F.col("fl_qty") - F.coalesce(F.lag("fl_qty").over(w), F.lit(0))).join(part, "org")
        x = x.select((F.col("org") % 4).alias("unit"), "org", "mi", "fot_amt", "fl_qty", "np_cnt", "new_fl_cnt", F.floor(F.col("p_size") / 20).alias("potential"),
                     (F.col("fl_qty") / (F.lit(1) + F.col("p_size") % 4)).alias("share"))
        return tg.stage_metrics(x, END)

    @cached_property
    def industry(self):
        return self.i.table("part").select(F.col("p_partkey").alias("org"), F.col("p_type").alias("industry"))

    @cached_property
    def agreements(self):
        return self.i.table("part").select(F.col("p_partkey").alias("org"), F.add_months(F.lit("2001-08-10").cast("date"), -F.col("p_size") % 20).alias("start_dt"),
                                           F.when(F.col("p_size") % 3 == 0, F.lit("2001-06-01").cast("date")).alias("end_dt"))

    @cached_property
    def apps(self):
        d = F.to_date("o_orderdate")
        ago = (2001 - F.year(d)) * 12 + 7 - F.month(d)
        return self.i.table("orders").select((F.col("o_custkey") % 4).alias("unit"), F.col("o_custkey").alias("org"), (F.col("o_orderkey") % 1000).alias("person"), d.alias("app_dt"),
                                             ago.alias("month_ago"), (F.col("o_orderstatus") == "F").alias("is_electronic")).where(F.col("month_ago").between(0, 2))

    @cached_property
    def credits(self):
        e = self.i.payroll.where("code <> 'A'").select("person", "day")
        return tg.last_credit(e, self.apps)

    @cached_property
    def outflow(self):
        p = self.i.payroll.groupBy("org", "unit", "mi", F.col("code").alias("c"), "person").agg(F.lit(1).alias("_")).groupBy(F.concat_ws("-", "org", "c").alias("org"), "unit", "mi").agg(F.count(F.lit(1)).alias("payees"))
        w = W.partitionBy("org", "unit").orderBy("mi")
        x = p.withColumn("prev_payees", F.lag("payees").over(w)).where("prev_payees is not null")
        return x.withColumn("outflow_qty", F.greatest(F.col("prev_payees") - F.col("payees"), F.lit(0)))


cte("hm", f"""
 WITH p AS (SELECT part AS org, mi, sum(amt) AS fot_amt, count(DISTINCT person) AS fl_qty, count(DISTINCT CASE WHEN code = 'R' THEN person END) AS new_fl_cnt FROM payroll WHERE mi BETWEEN {END - 24} AND {END} GROUP BY 1, 2),
 g AS (SELECT o.org, m.mi, coalesce(fot_amt, 0) AS fot_amt, coalesce(fl_qty, 0) AS fl_qty, coalesce(new_fl_cnt, 0) AS new_fl_cnt FROM (SELECT DISTINCT org FROM p) o CROSS JOIN (SELECT range AS mi FROM range({END - 24}, {END + 1})) m
   LEFT JOIN p ON p.org = o.org AND p.mi = m.mi)
 SELECT g.org % 4 AS unit, g.*, fl_qty - coalesce(lag(fl_qty) OVER (PARTITION BY org ORDER BY mi), 0) AS np_cnt, p_size // 20 AS potential, fl_qty / (1 + p_size % 4) AS share, {END} - mi AS ago
 FROM g JOIN part ON p_partkey = g.org""", "payroll")
cte("hmd", f"SELECT unit, org || '-' || code AS org, {END} - mi AS ago, count(DISTINCT person) AS fl_qty FROM payroll GROUP BY 1, 2, 3", "payroll")
cte("agre", "SELECT p_partkey AS org, CAST(DATE '2001-08-10' - to_months(CAST(p_size % 20 AS INTEGER)) AS DATE) AS start_dt, CASE WHEN p_size % 3 = 0 THEN DATE '2001-06-01' END AS end_dt FROM part")
cte("apps", """SELECT * FROM (SELECT o_custkey % 4 AS unit, o_custkey AS org, o_orderkey % 1000 AS person, CAST(o_orderdate AS DATE) AS app_dt, (2001 - year(o_orderdate)) * 12 + 7 - month(o_orderdate) AS ago, o_orderstatus = 'F' AS el FROM orders) WHERE ago BETWEEN 0 AND 2""")
cte("enrl", "SELECT person, max(day) AS last_enrl FROM payroll WHERE code <> 'A' GROUP BY 1", "payroll")
cte("outf", """WITH p AS (SELECT org || '-' || code AS org, unit, mi, count(DISTINCT person) AS payees FROM payroll GROUP BY 1, 2, 3)
 SELECT *, greatest(prev_payees - payees, 0) AS outflow_qty FROM (SELECT *, lag(payees) OVER (PARTITION BY org, unit ORDER BY mi) AS prev_payees FROM p) WHERE prev_payees IS NOT NULL""", "payroll")


def _js(**kv) -> str:
    """JSON object text in SQL: each value is (expression, 's' for text or 'n' for number)."""
    parts = []
    for n, (e, k) in kv.items():
        v = f"CASE WHEN {e} IS NULL THEN 'null' ELSE " + (f"'\"' || CAST({e} AS VARCHAR) || '\"'" if k == "s" else f"CAST({e} AS VARCHAR)") + " END"
        parts.append(f"'\"{n}\":' || {v}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _sel(key: str, js: str, src: str, org: str = "CAST(org AS BIGINT)") -> str:
    n, t = tg.NAMES[key]
    return f"SELECT CAST(unit AS BIGINT) AS unit, {org} AS org, '{n}' AS trigger_name, '{t}' AS trigger_type, {js} AS attributes FROM {src}"


_M = ("'2001-07'", "s")


def _d2(e: str) -> str:
    return f"CAST(round({e}, 2) AS DECIMAL(18,2))"


SQL = {
    "single_order": (_sel("single_order", _js(month=_M, epp_cnt=("n", "n")), "(SELECT l_suppkey % 4 AS unit, l_partkey AS org, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem WHERE year(l_shipdate) = 2001 AND month(l_shipdate) = 7 AND l_partkey % 5 <> 0 GROUP BY 1, 2 HAVING bool_and(l_returnflag = 'A'))"), ()),
    "pay_below_peers": ("WITH c AS (SELECT unit, org, p_type AS ind, CAST(sum(fot_amt) * 100 AS HUGEINT) AS fot, CAST(sum(fl_qty) AS HUGEINT) AS fl FROM hm JOIN part ON p_partkey = org WHERE ago BETWEEN 0 AND 5 AND fl_qty <> 0 GROUP BY 1, 2, 3), "
                        "x AS (SELECT *, sum(fot) OVER w AS sf, sum(fl) OVER w AS sl FROM c WINDOW w AS (PARTITION BY unit, ind)) "
                        + _sel("pay_below_peers", _js(month=_M, avg_salary=("CAST((CAST(sf AS HUGEINT) * 2 + CAST(sl AS HUGEINT)) // (2 * CAST(sl AS HUGEINT)) / 100.0 AS DECIMAL(18,2))", "n"),
                                                      client_salary=("CAST((fot * 2 + fl) // (2 * fl) / 100.0 AS DECIMAL(18,2))", "n")), "x WHERE fot / fl <= 0.8 * (sf / sl)"), ("hm",)),
    "negative_potential": (_sel("negative_potential", _js(month=_M, np_cnt=("np_cnt", "n")), "hm WHERE ago = 0 AND np_cnt > potential"), ("hm",)),
    "first_credit": (_sel("first_credit", _js(month=_M, fl_cnt=("fl", "n")), "(SELECT unit, org, max(fl_qty) FILTER (WHERE ago = 0) AS fl FROM hm WHERE ago BETWEEN 0 AND 12 GROUP BY 1, 2 HAVING bool_or(ago = 0 AND fot_amt > 0) AND count(*) FILTER (WHERE ago > 0 AND fot_amt = 0) = 12)"), ("hm",)),
    "seasonal_activity": (_sel("seasonal_activity", _js(month=_M, fl_uplift=(_d2("((a - b) + (c - d)) / 2"), "n")), "(SELECT unit, org, max(fl_qty) FILTER (WHERE ago = 10) AS a, max(fl_qty) FILTER (WHERE ago = 11) AS b, max(fl_qty) FILTER (WHERE ago = 22) AS c, max(fl_qty) FILTER (WHERE ago = 23) AS d FROM hmd GROUP BY 1, 2) WHERE b > 0 AND d > 0 AND a / b - 1 >= 0.1 AND c / d - 1 >= 0.1", "org"), ("hmd",)),
    "high_turnover": (_sel("high_turnover", _js(month=_M, nfl_cnt=("new_fl_cnt", "n"), np_cnt=("np_cnt", "n"), portf_last_m=("pv", "n"), portf_cur_m=("fl_qty", "n")),
                           "(SELECT c.*, p.fl_qty AS pv FROM hm c JOIN hm p ON p.org = c.org AND p.unit = c.unit AND p.ago = 1 WHERE c.ago = 0) WHERE new_fl_cnt > 0 AND np_cnt < 0.2 * new_fl_cnt AND fl_qty < pv"), ("hm",)),
    "agreement_no_credit": (_sel("agreement_no_credit", _js(month=_M), "(SELECT unit, org FROM hm WHERE ago BETWEEN 0 AND 5 GROUP BY 1, 2 HAVING bool_or(ago = 0) AND count(*) FILTER (WHERE fot_amt = 0) = 6) WHERE org IN (SELECT org FROM agre WHERE (end_dt IS NULL OR end_dt >= DATE '2001-08-10') AND start_dt <= DATE '2001-02-10')"), ("hm", "agre")),
    "contact_policy": (_sel("contact_policy", _js(task_close_date=("strftime(l, '%Y-%m-%d')", "s")), "(SELECT h.unit, h.org, max(CAST(o_orderdate AS DATE)) AS l FROM hm h LEFT JOIN orders ON o_custkey = h.org AND o_custkey % 4 = h.unit AND o_orderstatus = 'F' AND o_orderdate < '2001-07-01' WHERE ago = 0 GROUP BY 1, 2) WHERE l IS NULL OR l < DATE '2001-04-01'"), ("hm",)),
    "outflow_1m": (_sel("outflow_1m", _js(month=_M, portf_last_m=("prev_payees", "n"), portf_cur_m=("payees", "n"), churn_cnt=("prev_payees - payees", "n"), churn_pct=(_d2("(prev_payees - payees) / prev_payees"), "n")), f"outf WHERE mi = {END} AND outflow_qty >= 3 AND payees < prev_payees", "org"), ("outf",)),
    "outflow_3m": (_sel("outflow_3m", _js(month=_M, portf_3m_ago=("w", "n"), portf_cur_m=("n", "n"), churn_pct_3m=(_d2("(w - n) / w"), "n")), f"(SELECT unit, org, max(prev_payees) FILTER (WHERE mi = {END - 2}) AS w, max(payees) FILTER (WHERE mi = {END}) AS n FROM outf WHERE mi BETWEEN {END - 2} AND {END} AND outflow_qty >= 1 AND payees < prev_payees GROUP BY 1, 2 HAVING count(*) = 3)", "org"), ("outf",)),
    "share_over_90": (_sel("share_over_90", _js(month=_M, fl_cnt=("fl_qty", "n"), fl_dolay=(_d2("share"), "n")), "hm WHERE ago = 0 AND share > 0.9"), ("hm",)),
}
_AP = "SELECT unit, org, el, count(*) FILTER (WHERE ago = 0) AS c1, min(app_dt) FILTER (WHERE ago = 0) AS f1, count(*) FILTER (WHERE ago = 0 AND last_enrl >= app_dt) AS p1, count(*) AS c3, min(app_dt) AS f3, count(*) FILTER (WHERE last_enrl >= app_dt) AS p3 FROM apps LEFT JOIN enrl USING (person) GROUP BY 1, 2, 3"
cte("apair", _AP, "apps", "enrl")
for _el, _k in ((False, "paper"), (True, "electronic")):
    _w = "el" if _el else "NOT el"
    SQL[f"apps_{_k}_1m"] = (_sel(f"apps_{_k}_1m", _js(month=_M, app_cnt=("c1", "n"), app_with_zachisl_cnt=("p1", "n"), first_app_date=("strftime(f1, '%Y-%m-%d')", "s")), f"apair WHERE c1 > 0 AND {_w}"), ("apair",))
    SQL[f"apps_{_k}_3m"] = (_sel(f"apps_{_k}_3m", _js(month=_M, app_cnt_3m=("c3", "n"), app_with_zachisl_cnt_3m=("p3", "n"), first_app_date=("strftime(f3, '%Y-%m-%d')", "s")), f"apair WHERE {_w}"), ("apair",))
_WK = "(SELECT a.unit, a.org, bool_or(a.org IN (SELECT org FROM agre WHERE end_dt IS NULL OR end_dt >= DATE '2001-07-20')) AS agr, min(app_dt) AS f, count(*) AS n, count(*) FILTER (WHERE last_enrl >= app_dt) AS k FROM apps a LEFT JOIN enrl USING (person) WHERE app_dt BETWEEN DATE '2001-07-09' AND DATE '2001-07-15' GROUP BY 1, 2) WHERE n > k AND "
for _k, _c in (("week_with_agreement", "agr"), ("week_no_agreement", "NOT agr")):
    SQL[_k] = (_sel(_k, _js(first_app_date=("strftime(f, '%Y-%m-%d')", "s"), app_cnt=("n", "n"), app_with_zachisl_cnt=("k", "n"), app_no_zachisl_cnt=("n - k", "n")), _WK + _c), ("apps", "enrl", "agre"))


def frames(i) -> dict:
    s = Stage(i)
    m = s.metrics
    d = F.to_date("l_shipdate")
    base = i.table("lineitem").where((F.year(d) == 2001) & (F.month(d) == 7)).select(
        (F.col("l_suppkey") % 4).alias("unit"), F.when(F.col("l_partkey") % 5 == 0, "n/a").otherwise(F.col("l_partkey").cast("string")).alias("org_text"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("bigint").alias("fl_count"))
    tasks = i.table("orders").where("o_orderstatus = 'F' and o_orderdate < '2001-07-01'").select(F.col("o_custkey").alias("org"), (F.col("o_custkey") % 4).alias("unit"), F.to_date("o_orderdate").alias("closed_at"))
    apps = tg.application_triggers(tg.application_pairs(s.apps, s.credits), MONTH)
    week = tg.weekly_applications(s.apps, s.agreements, s.credits, "2001-07-11", "2001-07-20")
    out = {
        "single_order": tg.single_order(base, MONTH, "A"), "pay_below_peers": tg.pay_below_peers(m, s.industry, MONTH), "negative_potential": tg.negative_potential(m, MONTH),
        "first_credit": tg.first_credit(m, MONTH), "seasonal_activity": tg.seasonal_activity(tg.stage_metrics(s.outflow.withColumn("fl_qty", F.col("payees")), END), MONTH), "high_turnover": tg.high_turnover(m, MONTH),
        "agreement_no_credit": tg.agreement_no_credit(m, s.agreements, MONTH, "2001-08-10"), "contact_policy": tg.contact_policy(m, tasks, "2001-07-01"),
        "outflow_1m": tg.outflow_last_month(s.outflow, END, MONTH), "outflow_3m": tg.outflow_three_months(s.outflow, END, MONTH, 1), "share_over_90": tg.share_over_90(m, MONTH)}
    for k in ("apps_paper_1m", "apps_electronic_1m", "apps_paper_3m", "apps_electronic_3m"):
        out[k] = apps.where(F.col("trigger_name") == tg.NAMES[k][0])
    for k in ("week_with_agreement", "week_no_agreement"):
        out[k] = week.where(F.col("trigger_name") == tg.NAMES[k][0])
    return out


for _k, (_sql, _needs) in SQL.items():
    @query(f"trigger_{_k}", _sql, _needs)
    def _(i, k=_k):
        return frames(i)[k]


MONTHLY = [k for k in SQL if not k.startswith(("week", "outflow", "seasonal"))]


def _union_sql(keys) -> tuple[str, tuple]:
    needs: list[str] = []
    for k in keys:
        needs += [n for n in SQL[k][1] if n not in needs]
    return " UNION ALL ".join(f"SELECT * FROM ({SQL[k][0]})" for k in keys), tuple(needs)


_U, _UN = _union_sql(MONTHLY)


def fresh(i) -> str:
    return f"{shared_dir(i.spark)}/marts/{uuid.uuid4().hex}"


@query("run_triggers", f"SELECT *, '2001-07-31' AS period, 'month' AS owner FROM ({_U})", _UN)
def _(i):
    s = Stage(i)
    gate = marts.source_gate([("metrics", s.metrics, F.col("month_ago") == 0, None), ("applications", s.apps, None, "app_dt")])
    path, parts = fresh(i), frames(i)
    stale = parts["contact_policy"].withColumn("trigger_name", F.lit("stopped firing"))
    marts.mart_replace_period(stale, path, MDATE, "month")
    return tg.run_triggers([parts[k] for k in MONTHLY], gate, path, MDATE, "month")


@query("source_gate", """SELECT CAST(1 AS BIGINT) AS pos, 'metrics' AS source, true AS ok, NULL::VARCHAR AS last_date UNION ALL
 SELECT 2, 'orders', (SELECT count(*) FROM orders WHERE o_orderdate > '2030-01-01') > 0, (SELECT CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) FROM orders)""")
def _(i):
    return marts.source_gate([("metrics", Stage(i).metrics, F.col("month_ago") == 0, None),
                              ("orders", i.table("orders").withColumn("d", F.to_date("o_orderdate")), F.col("o_orderdate") > "2030-01-01", "d")])


@query("first_missing_source", "SELECT 'orders' AS source, (SELECT CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) FROM orders) AS last_date")
def _(i):
    o = i.table("orders").withColumn("d", F.to_date("o_orderdate"))
    return marts.first_missing(marts.source_gate([("lines", i.lines, F.col("mi") == 3, None), ("orders", o, F.col("o_orderdate") > "2030-01-01", "d"), ("late", o, F.col("d") > "2031-01-01", "d")]))


@query("duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(i):
    return marts.duplicate_keys(i.table("orders"), ["o_custkey"])


# ------------------------------------------------------------- mart round trips

def _day(i, mi):
    return i.lines.where(F.col("mi") == mi).groupBy("org", "unit").agg(F.sum("amt").alias("amt"), F.count(F.lit(1)).alias("n"))


@query("mart_replace_period", """SELECT org, CAST(unit AS BIGINT) AS unit, CAST(sum(amt) AS DOUBLE) AS amt, count(*) AS n, CASE WHEN mi = 5 THEN '2024-01-06' ELSE '2024-01-07' END AS period, 'a' AS owner
 FROM lines WHERE mi = 6 OR (mi = 5 AND org = 'view') GROUP BY org, unit, mi""", "lines")
def _(i):
    path = fresh(i)
    marts.mart_replace_period(_day(i, 5), path, "2024-01-06", "a")
    marts.mart_replace_period(_day(i, 6), path, "2024-01-07", "a")
    marts.mart_replace_period(_day(i, 5).where("org = 'view'"), path, "2024-01-06", "a")
    return marts.read_mart(i.spark, path)


@query("mart_swap", "SELECT org, CAST(unit AS BIGINT) AS unit, CAST(sum(amt) AS DOUBLE) AS amt, count(*) AS n FROM lines WHERE mi = 5 GROUP BY 1, 2", "lines")
def _(i):
    path = fresh(i)
    ok = marts.mart_swap({"s": _day(i, 5), "p": _day(i, 7)}, path, 1, lambda f: f["s"].where("n < 0").isEmpty())
    bad = marts.mart_swap({"s": _day(i, 6), "p": _day(i, 8)}, path, 2, lambda f: f["s"].isEmpty())
    assert ok and not bad
    return marts.read_current(i.spark, path, "s")


@query("generation_load", "SELECT org, CAST(unit AS BIGINT) AS unit, count(*) AS n, CAST(NULL AS DOUBLE) AS old_measure, CAST(2 AS BIGINT) AS run_id FROM lines WHERE mi = 6 GROUP BY 1, 2", "lines")
def _(i):
    path = fresh(i)
    for run, mi in ((1, 5), (2, 6)):
        g = _day(i, mi).select("org", "unit", "n", F.lit(run).alias("run_id"), F.lit("atom").alias("lvl"))
        marts.append_rows(g, path, ("run_id", "lvl"))
    return marts.generation_load(i.spark, path, ["old_measure"]).select("org", "unit", "n", "old_measure", "run_id")


@query("period_cache", "SELECT CAST(mi AS BIGINT) AS mi, org, count(*) AS n FROM lines WHERE mi IN (2, 3, 4) GROUP BY 1, 2", "lines")
def _(i):
    path, asked = fresh(i), []

    def compute(ps):
        asked.append(list(ps))
        return i.lines.where(F.col("mi").isin(ps)).groupBy("mi", "org").agg(F.count(F.lit(1)).alias("n"))

    marts.period_cache(i.spark, path, [2, 3], "v1", compute)
    out = marts.period_cache(i.spark, path, [2, 3, 4], "v1", compute)
    assert asked == [[2, 3], [4]]
    return out.select("mi", "org", "n")


@query("day_window_cache", "SELECT CAST(mi AS BIGINT) AS mi, strftime(period, '%Y-%m-%d') AS period, count(*) AS n_rows, CAST(sum(amt) AS DOUBLE) AS amt FROM lines WHERE mi BETWEEN 13 AND 17 GROUP BY 1, 2", "lines")
def _(i):
    from ..operators.calendar import day_window
    return marts.period_cache(i.spark, fresh(i), list(range(13, 18)), "v1", lambda ps: day_window(i.lines.where(F.col("mi").isin(ps)), ["mi", "period"])).select("mi", "period", "n_rows", "amt")


@query("csv_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(i):
    from ..sources.scans import scan_dimension_csv
    path = fresh(i)
    marts.csv_sink({"nation": i.table("nation")}, path, ";")
    return scan_dimension_csv(i.spark, f"{path}/nation", "n_nationkey int, n_name string, n_regionkey int")


@query("work_set", "SELECT org, CAST(sum(amt) AS DOUBLE) AS amt FROM lines WHERE mi = 5 GROUP BY 1", "lines")
def _(i):
    w = marts.WorkSet(i.spark, f"ws_{uuid.uuid4().hex}")
    w.add("day", lambda f: i.lines.where("mi = 5"), stage=True)
    return w.add("sum", lambda f: f["day"].groupBy("org").agg(F.sum("amt").alias("amt")))
