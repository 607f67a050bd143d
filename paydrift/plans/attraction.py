"""Queries on new recipients: actions are orders, first payments are first shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from .registry import cte, query

cte("nfl", """SELECT o_custkey AS person, s_nationkey AS org, l_returnflag || l_linestatus AS unit, CAST(min(l_shipdate) AS DATE) AS pay_dt, min(s_nationkey % 3) AS region
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")
cte("nf", "SELECT *, CASE WHEN year(pay_dt) = 2000 THEN 'cur' ELSE 'prev' END AS yr, CASE WHEN pay_dt < DATE '2000-01-01' THEN 'archive' ELSE 'current' END AS source FROM nfl WHERE year(pay_dt) IN (1999, 2000)", "nfl")
_D = """SELECT o_orderkey AS deal, CAST(o_orderdate AS DATE) AS act_dt, CAST(o_custkey % 25 AS INTEGER) AS org, CASE WHEN o_custkey % 3 = 0 THEN 'R' WHEN o_custkey % 3 = 1 THEN 'A' ELSE 'N' END
 || CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS unit, CAST(o_custkey % 25 % 3 AS INTEGER) AS region, o_custkey % 40 AS emp, CAST(o_custkey % 9 AS BIGINT) AS plan, CAST(o_custkey % 5 AS BIGINT) AS fact, o_custkey AS person, o_orderpriority AS pr FROM orders"""
cte("acts", _D)
cte("deals", "SELECT * FROM acts WHERE pr = '1-URGENT'", "acts")
_VT = "last_day(date_trunc('month', a.act_dt) + INTERVAL 2 MONTH)"
cte("act", f"""SELECT n.person, n.org, n.unit, n.pay_dt, 'mzp' AS ch, 1 AS prio, a.act_dt, CAST(a.deal AS VARCHAR) AS act_key FROM nf n JOIN deals a ON a.org = n.org AND a.unit = n.unit AND a.act_dt <= n.pay_dt AND n.pay_dt <= {_VT}
 UNION ALL SELECT n.person, n.org, n.unit, n.pay_dt, 'vsp', 2, a.act_dt, NULL FROM nf n JOIN acts a ON a.pr = '2-HIGH' AND a.person = n.person AND a.act_dt <= n.pay_dt AND n.pay_dt <= {_VT}
 UNION ALL SELECT n.person, n.org, n.unit, n.pay_dt, 'dig', 3, a.act_dt, NULL FROM nf n JOIN acts a ON a.pr = '3-MEDIUM' AND a.person = n.person AND a.act_dt <= n.pay_dt AND n.pay_dt <= {_VT}""", "nf", "deals", "acts")
cte("touch", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY person, org, unit ORDER BY act_dt, prio, act_key) AS rn FROM act),
 f AS (SELECT person, org, unit, bool_or(ch = 'mzp') AS has_mzp, bool_or(ch = 'vsp') AS has_vsp, bool_or(ch = 'dig') AS has_dig FROM act GROUP BY 1, 2, 3)
 SELECT n.*, coalesce(w.ch, 'other') AS ch, w.act_dt, w.act_key, CAST((year(n.pay_dt) - year(w.act_dt)) * 12 + month(n.pay_dt) - month(w.act_dt) AS BIGINT) AS lag_m,
  coalesce(has_mzp, false) AS has_mzp, coalesce(has_vsp, false) AS has_vsp, coalesce(has_dig, false) AS has_dig
 FROM nf n LEFT JOIN w ON w.person = n.person AND w.org = n.org AND w.unit = n.unit AND rn = 1 LEFT JOIN f ON f.person = n.person AND f.org = n.org AND f.unit = n.unit""", "nf", "act")

EK = ("person", "org", "unit")


class Attraction:
    def __init__(self, i):
        self.i = i
        li, od, su = i.table("lineitem"), i.table("orders"), i.table("supplier")
        j = li.join(od, li.l_orderkey == od.o_orderkey).join(su, li.l_suppkey == su.s_suppkey)
        nfl = j.groupBy(F.col("o_custkey").alias("person"), F.col("s_nationkey").alias("org"), F.concat("l_returnflag", "l_linestatus").alias("unit")).agg(
            F.to_date(F.min("l_shipdate")).alias("pay_dt"), F.min(F.col("s_nationkey") % 3).alias("region"))
        nfl = nfl.where(F.year("pay_dt").isin(1999, 2000)).withColumn("yr", F.when(F.year("pay_dt") == 2000, "cur").otherwise("prev"))
        self.nf = at.newcomers(nfl, nfl, "pay_dt", F.lit("1999-12-31").cast("date"), ["person", "org", "unit", "pay_dt", "region", "yr"])
        k = F.col("o_custkey")
        self.acts = od.select(
            F.col("o_orderkey").alias("deal"), F.to_date("o_orderdate").alias("act_dt"), F.to_date("o_orderdate").alias("report_dt"), (k % 25).cast("int").alias("org"),
            F.concat(F.when(k % 3 == 0, "R").when(k % 3 == 1, "A").otherwise("N"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O")).alias("unit"),
            (k % 25 % 3).cast("int").alias("region"), (k % 40).alias("emp"), (k % 9).alias("plan"), (k % 5).alias("fact"), k.alias("person"), F.col("o_orderpriority").alias("pr"))
        self.deals = at.latest_deals(self.acts.where("pr = '1-URGENT'"))
        m = [at.interval_match(self.nf, "pay_dt", at.earliest_actions(self.deals, ["org", "unit"], "mzp", "deal"), ["org", "unit"], EK)]
        for ch, pr in (("vsp", "2-HIGH"), ("dig", "3-MEDIUM")):
            m.append(at.interval_match(self.nf, "pay_dt", at.earliest_actions(self.acts.where(F.col("pr") == pr), ["person"], ch), ["person"], EK))
        self.match = m[0].unionByName(m[1]).unionByName(m[2])
        self.touch = at.first_touch(self.nf, self.match, EK, "pay_dt")
        cells = i.payroll.select("person", F.col("org"), F.col("unit"), F.year("day").alias("mi"), F.col("org").alias("region"))
        self.cells = at.cell_counts(cells.withColumn("unit", F.concat_ws("-", "unit", "org")).withColumn("org", F.col("person") % 200))
        self.classes = at.cell_classes(self.cells, {"cur": (1999, 2000), "prev": (1998, 1999)})


cte("cell", "SELECT mi, org, unit, count(*) AS n, max(region) AS region FROM (SELECT year(day) AS mi, person % 200 AS org, unit || '-' || org AS unit, person, max(org) AS region FROM payroll GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3", "payroll")
_CP = """SELECT '{t}' AS pair, coalesce(c.org, b.org) AS org, coalesce(c.unit, b.unit) AS unit, coalesce(c.region, b.region) AS region, coalesce(b.n, 0) AS n_b, coalesce(c.n, 0) AS n_c
 FROM (SELECT * FROM cell WHERE mi = {b}) b FULL JOIN (SELECT * FROM cell WHERE mi = {c}) c ON c.org = b.org AND c.unit = b.unit"""
cte("ccls", "SELECT *, CASE WHEN n_b = 0 THEN 'new' WHEN n_c = 0 THEN 'closed' WHEN n_c > n_b THEN 'grow' WHEN n_c < n_b THEN 'decl' ELSE 'flat' END AS cls FROM ("
    + _CP.format(t="cur", b=1999, c=2000) + " UNION ALL " + _CP.format(t="prev", b=1998, c=1999) + ")", "cell")
_STEP = "CASE WHEN abs(n_c - n_b) = 0 THEN '0' WHEN abs(n_c - n_b) = 1 THEN '1' WHEN abs(n_c - n_b) <= 5 THEN '2-5' WHEN abs(n_c - n_b) <= 20 THEN '6-20' WHEN abs(n_c - n_b) <= 100 THEN '21-100' ELSE '100+' END"


@query("interval_match", "SELECT person, CAST(org AS BIGINT) AS org, unit, ch, strftime(min(act_dt), '%Y-%m-%d') AS act_dt, arg_min(act_key, strftime(act_dt, '%Y-%m-%d') || act_key) AS act_key FROM act GROUP BY 1, 2, 3, 4", "act")
def _(i):
    return Attraction(i).match


@query("first_touch", """SELECT person, CAST(org AS BIGINT) AS org, unit, strftime(pay_dt, '%Y-%m-%d') AS pay_dt, yr, source, ch, strftime(act_dt, '%Y-%m-%d') AS act_dt, act_key, lag_m, has_mzp, has_vsp, has_dig FROM touch""", "touch")
def _(i):
    return Attraction(i).touch.drop("region")


@query("cell_classes", "SELECT pair, org, unit, CAST(region AS BIGINT) AS region, n_b, n_c, cls FROM ccls", "ccls")
def _(i):
    return Attraction(i).classes


@query("cell_summary", f"SELECT pair, cls, {_STEP} AS step, count(*) AS n_cells, CAST(sum(n_b) AS BIGINT) AS n_b, CAST(sum(n_c) AS BIGINT) AS n_c FROM ccls GROUP BY 1, 2, 3", "ccls")
def _(i):
    return at.cell_summary(Attraction(i).classes)


_CA = """count(*) FILTER (WHERE cls IN ('grow','new')) AS n_grow, count(*) FILTER (WHERE cls IN ('decl','closed')) AS n_decl, count(*) FILTER (WHERE cls = 'flat') AS n_flat, CAST(sum(n_b) AS BIGINT) AS n_b,
 CAST(sum(n_c) AS BIGINT) AS n_c, CAST(sum(CASE WHEN cls IN ('grow','new') THEN n_c - n_b ELSE 0 END) AS BIGINT) AS d_grow, CAST(sum(CASE WHEN cls IN ('decl','closed') THEN n_c - n_b ELSE 0 END) AS BIGINT) AS d_decl"""
cte("corg", "SELECT DISTINCT c_custkey % 200 AS org, CASE WHEN c_custkey % 200 % 3 = 0 THEN 'A' ELSE 'B' END AS seg, CASE WHEN c_custkey % 200 < 150 THEN 'H' || (c_custkey % 200 % 4) END AS hold, 'I' || (c_custkey % 200 % 6) AS industry FROM customer")


def corg(i):
    o = (F.col("c_custkey") % 200)
    return i.table("customer").select(o.alias("org"), F.when(o % 3 == 0, "A").otherwise("B").alias("seg"), F.when(o < 150, F.concat(F.lit("H"), (o % 4).cast("string"))).alias("hold"),
                                      F.concat(F.lit("I"), (o % 6).cast("string")).alias("industry")).distinct()


@query("cells_by_dim", "WITH s AS (SELECT * FROM ccls LEFT JOIN corg USING (org)) " + " UNION ALL ".join(
    f"SELECT '{d}' AS dim, CAST({c} AS VARCHAR) AS key, pair, {_CA} FROM s GROUP BY 2, 3" for d, c in (("seg", "seg"), ("holding", "hold"), ("industry", "industry"), ("region", "region"))), ("ccls", "corg"))
def _(i):
    return at.cells_by_dim(Attraction(i).classes, corg(i))


cte("tcell", "SELECT yr, ch, person % 200 AS org, CASE WHEN unit LIKE '%O' THEN '1' ELSE '0' END || '-' || n_regionkey AS unit FROM touch JOIN nation ON n_nationkey = org", "touch")


def tcell(i, a):
    n = i.table("nation").select(F.col("n_nationkey").alias("org"), F.col("n_regionkey").alias("rk"))
    return a.touch.join(n, "org").select("yr", "ch", (F.col("person") % 200).alias("org"), F.concat_ws("-", F.when(F.col("unit").endswith("O"), "1").otherwise("0"), F.col("rk").cast("string")).alias("unit"))


@query("growth_cells", """WITH n AS (SELECT org, unit, count(*) AS n_new, count(*) FILTER (WHERE ch='mzp') AS n_mzp, count(*) FILTER (WHERE ch='vsp') AS n_vsp, count(*) FILTER (WHERE ch='dig') AS n_dig, count(*) FILTER (WHERE ch='other') AS n_other FROM tcell WHERE yr='cur' GROUP BY 1, 2)
 SELECT pair, c.org, c.unit, CAST(region AS BIGINT) AS region, n_b, n_c, cls, n_c - n_b AS delta, coalesce(n_new, 0) AS n_new, coalesce(n_mzp, 0) AS n_mzp, coalesce(n_vsp, 0) AS n_vsp, coalesce(n_dig, 0) AS n_dig, coalesce(n_other, 0) AS n_other, seg, hold, industry
 FROM ccls c LEFT JOIN corg o ON o.org = c.org LEFT JOIN n ON n.org = c.org AND n.unit = c.unit WHERE pair = 'cur' AND cls IN ('grow','new') ORDER BY n_c - n_b DESC, c.org, c.unit LIMIT 20""", ("ccls", "corg", "tcell"))
def _(i):
    a = Attraction(i)
    return at.growth_cells(a.classes, tcell(i, a).where("yr = 'cur'"), corg(i), 20)


for _name, _by in (("channel_by_month", ("source", "ch", "month")), ("channel_overlap", ("yr", "ch", "has_mzp", "has_vsp", "has_dig")), ("channel_lag", ("yr", "ch", "lag_m"))):
    @query(_name, f"SELECT {', '.join(_by)}, count(*) AS n FROM (SELECT *, CAST(month(pay_dt) AS BIGINT) AS month FROM touch) GROUP BY ALL", "touch")
    def _(i, by=_by):
        return at.channel_counts(Attraction(i).touch.withColumn("month", F.month("pay_dt")), by)


@query("channel_by_cell_class", "SELECT yr, coalesce(cls, 'none') AS cls, ch, count(*) AS n FROM tcell t LEFT JOIN ccls c ON c.pair = t.yr AND c.org = t.org AND c.unit = t.unit GROUP BY 1, 2, 3", ("tcell", "ccls"))
def _(i):
    a = Attraction(i)
    c = a.classes.select(F.col("pair").alias("yr"), "org", "unit", "cls")
    return at.channel_counts(tcell(i, a).join(c, ["yr", "org", "unit"], "left").withColumn("cls", F.coalesce("cls", F.lit("none"))), ("yr", "cls", "ch"))


@query("channel_by_growth_step", f"SELECT yr, {_STEP} AS step, ch, count(*) AS n FROM tcell t JOIN ccls c ON c.pair = t.yr AND c.org = t.org AND c.unit = t.unit WHERE cls IN ('grow','new') GROUP BY 1, 2, 3", ("tcell", "ccls"))
def _(i):
    a = Attraction(i)
    return at.by_growth_step(tcell(i, a), a.classes)


@query("channel_by_dim", """WITH d AS (SELECT t.yr, t.ch, o.* FROM touch t JOIN corg o ON o.org = t.person % 200)
 SELECT 'seg' AS dim, seg AS key, yr, ch, count(*) AS n FROM d GROUP BY 2, 3, 4 UNION ALL SELECT 'holding', hold, yr, ch, count(*) FROM d GROUP BY 2, 3, 4 UNION ALL SELECT 'industry', industry, yr, ch, count(*) FROM d GROUP BY 2, 3, 4""", ("touch", "corg"))
def _(i):
    from ..operators.yoy import dim_breakdown
    t = Attraction(i).touch.select("yr", "ch", (F.col("person") % 200).alias("org"), F.lit(1).alias("n")).join(corg(i), "org")
    return dim_breakdown(t, {"seg": "seg", "holding": "hold", "industry": "industry"}, ["yr", "ch"], ["n"], keep_null=("seg", "holding", "industry"))


@query("channel_year_change", """WITH g AS (SELECT ch, count(*) FILTER (WHERE yr='prev') AS prev, count(*) FILTER (WHERE yr='cur') AS cur FROM touch GROUP BY 1), t AS (SELECT sum(prev) AS p, sum(cur) AS c FROM g)
 SELECT ch, prev, cur, cur - prev AS delta, round((cur-prev)/prev, 4) + 0.0 AS pct, round(prev/p, 4) AS share_prev, round(cur/c, 4) AS share_cur, round((cur-prev)/abs(c-p), 4) + 0.0 AS contrib FROM g, t""", "touch")
def _(i):
    return at.channel_year_change(Attraction(i).touch)


@query("deal_productivity", """WITH w AS (SELECT act_key, count(*) AS n FROM touch WHERE ch = 'mzp' GROUP BY 1), e AS (SELECT last_day(act_dt) AS month, region, emp, count(*) AS n_deals, sum(plan) AS plan, sum(fact) AS fact, sum(coalesce(n, 0)) AS n_new
  FROM deals d LEFT JOIN w ON w.act_key = CAST(d.deal AS VARCHAR) GROUP BY 1, 2, 3)
 SELECT strftime(month, '%Y-%m-%d') AS month, CAST(region AS BIGINT) AS region, CAST(sum(n_deals) AS BIGINT) AS n_deals, CAST(sum(plan) AS BIGINT) AS plan, CAST(sum(fact) AS BIGINT) AS fact, CAST(sum(n_new) AS BIGINT) AS n_new, count(*) AS n_emp FROM e GROUP BY 1, 2""", ("deals", "touch"))
def _(i):
    a = Attraction(i)
    return at.deal_productivity(a.deals, a.touch)


@query("staff_counts", "SELECT strftime(last_day(act_dt), '%Y-%m-%d') AS report_dt, CAST(region AS BIGINT) AS region, count(DISTINCT emp) AS n_staff FROM acts GROUP BY 1, 2", "acts")
def _(i):
    return at.staff_counts(Attraction(i).acts.withColumn("report_dt", F.last_day("act_dt")))


@query("staff_counts_total", "SELECT strftime(last_day(act_dt), '%Y-%m-%d') AS report_dt, count(DISTINCT emp) AS n_staff FROM acts GROUP BY 1", "acts")
def _(i):
    return at.staff_counts(Attraction(i).acts.withColumn("report_dt", F.last_day("act_dt")), ["report_dt"])


@query("deal_match", """WITH k AS (SELECT DISTINCT org, unit FROM nf WHERE yr = 'cur')
 SELECT CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.org = d.org AND k.unit = d.unit) THEN 'same_unit' WHEN d.org IN (SELECT org FROM k) THEN 'other_unit' ELSE 'no_org' END AS match, count(*) AS n_deals FROM deals d GROUP BY 1""", ("nf", "deals"))
def _(i):
    a = Attraction(i)
    return at.deal_match(a.deals, a.nf.where("yr = 'cur'"))


@query("productivity_ratio", """WITH y AS (SELECT CASE WHEN year(act_dt) = 2000 THEN 'cur' ELSE 'prev' END AS yr, count(DISTINCT emp) AS staff, count(*) AS deals, CAST(sum(fact) AS BIGINT) AS fact FROM deals WHERE year(act_dt) IN (1999, 2000) GROUP BY 1),
 z AS (SELECT y.*, (SELECT count(*) FROM touch t WHERE t.yr = y.yr AND ch = 'mzp') AS n_new FROM y),
 o AS (SELECT c.staff AS staff_cur, p.staff AS staff_prev, c.deals AS deals_cur, p.deals AS deals_prev, c.fact AS fact_cur, p.fact AS fact_prev, c.n_new AS n_new_cur, p.n_new AS n_new_prev FROM z c, z p WHERE c.yr = 'cur' AND p.yr = 'prev')
 SELECT *, round(staff_cur/staff_prev, 4) AS k_staff, round(deals_cur/deals_prev, 4) AS k_deals, round(fact_cur/fact_prev, 4) AS k_fact, round(n_new_cur/n_new_prev, 4) AS k_n_new, round(n_new_prev/staff_prev*staff_cur, 4) AS expected_new, round(n_new_cur - n_new_prev/staff_prev*staff_cur, 4) + 0.0 AS gap FROM o""", ("deals", "touch"))
def _(i):
    a = Attraction(i)
    d = a.deals.where(F.year("act_dt").isin(1999, 2000)).withColumn("yr", F.when(F.year("act_dt") == 2000, "cur").otherwise("prev"))
    n = a.touch.where("ch = 'mzp'").groupBy("yr").agg(F.count(F.lit(1)).alias("n_new"))
    y = d.groupBy("yr").agg(F.countDistinct("emp").alias("staff"), F.count(F.lit(1)).alias("deals"), F.sum("fact").alias("fact")).join(n, "yr")
    return at.productivity_ratio(y)
