"""Watch queries: a panel of market segment × nation over monthly buyers; 2001-02 is the month looked at."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import functions as F

from ..operators import watch as wa
from .registry import CTES, cte, query

MI, MINB = 73, 4


class Watch:
    def __init__(self, i):
        self.i = i

    @cached_property
    def panel(self):
        def build():
            p = self.i.payroll.groupBy(F.col("person"), "mi").agg(F.count(F.lit(1)).alias("k"))
            prev = p.select("person", (F.col("mi") + 1).alias("mi"), F.lit(True).alias("was"))
            nxt = p.select("person", (F.col("mi") - 1).alias("mi"), F.lit(True).alias("will"))
            j = p.select("person", "mi", "k", F.lit(True).alias("here")).join(prev, ["person", "mi"], "full_outer").join(nxt, ["person", "mi"], "left").where("mi between 1 and 82")
            c = self.i.table("customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("region"))
            was, here = F.coalesce("was", F.lit(False)), F.coalesce("here", F.lit(False))
            return j.join(c, "person").groupBy(F.concat_ws("|", "grp", F.col("region").cast("string")).alias("key"), "grp", "region", "mi").agg(
                F.count_if(was).alias("base"), F.count_if(was & ~here).alias("out_left"), F.count_if(here & ~was).alias("in_new"), F.count_if(was & ~here & F.coalesce("will", F.lit(False))).alias("temp_left"),
                F.count_if(here & (F.col("k") == 1)).alias("single_pay"), F.coalesce(F.sum("k"), F.lit(0)).alias("raw_rows"))
        return self.i.staged("watch_panel", build)

    def expected(self, flow="out_left"):
        return wa.row_offset(wa.peer_expected(self.panel, flow, MINB), flow).withColumn("cls", F.when(F.col("region") < 12, "a").otherwise("b"))

    def interval(self, flow="out_left", z=1.2):
        return wa.log_count_interval(self.expected(flow), flow, z, min_mean=1.0)


cte("wpan", """WITH p AS (SELECT person, mi, count(*) AS k FROM payroll GROUP BY 1, 2),
 j AS (SELECT coalesce(a.person, b.person) AS person, coalesce(a.mi, b.mi + 1) AS mi, a.k, a.person IS NOT NULL AS here, b.person IS NOT NULL AS was FROM p a FULL JOIN p b ON b.person = a.person AND b.mi + 1 = a.mi)
 SELECT c_mktsegment || '|' || c_nationkey AS key, c_mktsegment AS grp, c_nationkey AS region, mi, count(*) FILTER (WHERE was) AS base, count(*) FILTER (WHERE was AND NOT here) AS out_left, count(*) FILTER (WHERE here AND NOT was) AS in_new,
  count(*) FILTER (WHERE was AND NOT here AND EXISTS (SELECT 1 FROM p n WHERE n.person = j.person AND n.mi = j.mi + 1)) AS temp_left, count(*) FILTER (WHERE here AND k = 1) AS single_pay, CAST(coalesce(sum(k), 0) AS BIGINT) AS raw_rows
 FROM j JOIN customer ON c_custkey = person WHERE mi BETWEEN 1 AND 82 GROUP BY 1, 2, 3, 4""", "payroll")
cte("wcal", """WITH r AS (SELECT region, mi, sum(base) AS b, sum(temp_left) AS v, sum(temp_left) / greatest(sum(base), 1) AS rate FROM wpan GROUP BY 1, 2),
 x AS (SELECT a.mi, a.rate - y.rate AS d, a.rate - y.rate > 3 * sqrt(a.v + y.v + 1) / greatest(a.b, 1) AS hit FROM r a JOIN r y ON y.region = a.region AND y.mi = a.mi - 12 WHERE a.b >= 4 AND y.b >= 4),
 s AS (SELECT mi, sum(single_pay) AS s FROM wpan GROUP BY 1)
 SELECT mi, median(d) AS common FROM x WHERE mi IN (SELECT a.mi FROM s a JOIN s b ON b.mi = a.mi - 1 WHERE a.s > b.s) GROUP BY 1 HAVING count(*) >= 3 AND avg(hit::INT) >= 0.0 AND median(d) > 0""", "wpan")
cte("wexp", f"""WITH g AS (SELECT grp, region, mi, CASE WHEN sum(base) >= {MINB} THEN sum(out_left) / sum(base) END AS rate FROM wpan GROUP BY 1, 2, 3), a AS (SELECT region, mi, CASE WHEN sum(base) >= {MINB} THEN sum(out_left) / sum(base) END AS rate FROM wpan GROUP BY 1, 2)
 SELECT p.*, base * coalesce((SELECT CASE WHEN count(rate) >= 3 THEN median(rate) END FROM g WHERE g.grp = p.grp AND g.mi = p.mi AND g.region <> p.region), (SELECT median(rate) FROM a WHERE a.mi = p.mi AND a.region <> p.region)) AS raw_exp FROM wpan p""", "wpan")
cte("woff", """WITH x AS (SELECT *, CASE WHEN raw_exp > 0 THEN out_left / raw_exp END AS r FROM wexp), y AS (SELECT *, coalesce(median(r) OVER w, 1.0) AS med, coalesce(sum(raw_exp) OVER w, 0) AS se FROM x WINDOW w AS (PARTITION BY key ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
 SELECT * EXCLUDE (r, med, se), (se * med + 20) / (se + 20) AS "offset", CASE WHEN region < 12 THEN 'a' ELSE 'b' END AS cls, row_number() OVER (PARTITION BY key ORDER BY mi) AS rn FROM y""", "wexp")
cte("wk2", """WITH h AS (SELECT a.cls, a.mi, p.out_left AS o, p.raw_exp * a."offset" AS e FROM woff a JOIN woff p ON p.key = a.key AND p.rn BETWEEN a.rn - 12 AND a.rn - 1),
 k AS (SELECT cls, mi, median(CASE WHEN e >= 1 THEN (pow(o - e, 2) / 0.455 - e) / pow(greatest(e, 1), 2) END) AS k FROM h GROUP BY 1, 2) SELECT cls, mi, least(greatest(coalesce(k, 0), 0), 1) AS k2 FROM k""", "woff")
cte("wsc", """WITH r AS (SELECT a.key, a.mi, p.out_left - p.raw_exp * a."offset" AS r FROM woff a JOIN woff p ON p.key = a.key AND p.rn BETWEEN a.rn - 12 AND a.rn - 1 WHERE p.raw_exp IS NOT NULL AND p.base > 0),
 m AS (SELECT key, mi, median(r) AS m, count(*) AS n FROM r GROUP BY 1, 2), o AS (SELECT r.key, r.mi, 1.4826 * median(abs(r - m)) AS own FROM r JOIN m ON m.key = r.key AND m.mi = r.mi GROUP BY 1, 2),
 x AS (SELECT w.*, coalesce(m.n, 0) AS n, own, coalesce(k2, 0) AS k2, raw_exp * "offset" AS e FROM woff w LEFT JOIN m ON m.key = w.key AND m.mi = w.mi LEFT JOIN o ON o.key = w.key AND o.mi = w.mi LEFT JOIN wk2 k ON k.cls = w.cls AND k.mi = w.mi)
 SELECT key, mi, base, out_left AS obs, n >= 6 AND coalesce(base, 0) > 0 AS ok, e, sqrt(greatest(greatest(e, 0) + k2 * e * e + 1, pow(coalesce(own, 0), 2))) AS s, n FROM x""", "woff", "wk2")
_B = lambda *cols: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


@query("watch_panel", "SELECT * REPLACE (CAST(region AS BIGINT) AS region, CAST(mi AS BIGINT) AS mi) FROM wpan", "wpan")
def _(i):
    return Watch(i).panel


@query("dense_panel", """WITH g AS (SELECT 'atom|' || seg_rep || '|' || region || '|' || unit AS key, mi, seg_rep, region, unit, CAST(sum(pf_recip) AS BIGINT) AS pf_recip FROM summ GROUP BY 1, 2, 3, 4, 5), k AS (SELECT DISTINCT key, seg_rep, region, unit FROM g)
 SELECT k.key, CAST(m.range AS BIGINT) AS mi, pf_recip, pf_recip IS NOT NULL AS present, 'atom' AS lvl, k.seg_rep, CAST(k.region AS BIGINT) AS region, CAST(k.unit AS BIGINT) AS unit, NULL::VARCHAR AS org FROM k CROSS JOIN range(30) m LEFT JOIN g ON g.key = k.key AND g.mi = m.range""", "summ")
def _(i):
    from ..operators import summary as sm
    return wa.panel(sm.generation(i.summary, 1), ["pf_recip"], 0, 29)


@query("watch_residual", """WITH a AS (SELECT mi, seg_rep, region, unit, sum(pf_recip) AS v, sum(pf_recip) FILTER (WHERE org IN ('view', 'purchase')) AS o FROM summ GROUP BY 1, 2, 3, 4)
 SELECT seg_rep, CAST(region AS BIGINT) AS region, CAST(unit AS BIGINT) AS unit, CAST(mi AS BIGINT) AS mi, CAST(v - coalesce(o, 0) AS BIGINT) AS pf_recip, false AS negative FROM a""", "summ")
def _(i):
    from ..operators import summary as sm
    g = sm.generation(i.summary, 1, i.orgs.where(F.col("org").isin("view", "purchase")))
    return wa.residual(wa.panel(g, ["pf_recip"], 0, 29), ["pf_recip"]).where("pf_recip is not null")


@query("calendar_component", "SELECT p.key, CAST(p.mi AS BIGINT) AS mi, round(CASE WHEN common IS NOT NULL THEN least(temp_left, common * base) ELSE 0 END, 4) AS calendar FROM wpan p LEFT JOIN wcal USING (mi)", ("wpan", "wcal"))
def _(i):
    return wa.calendar_component(Watch(i).panel, 4, 0.0)


@query("peer_expected", "SELECT key, CAST(mi AS BIGINT) AS mi, round(raw_exp, 4) AS raw_exp FROM wexp", "wexp")
def _(i):
    return wa.peer_expected(Watch(i).panel, "out_left", MINB).select("key", "mi", "raw_exp")


@query("row_offset", 'SELECT key, CAST(mi AS BIGINT) AS mi, round("offset", 6) AS "offset" FROM woff', "woff", digits=6)
def _(i):
    return Watch(i).expected().select("key", "mi", "offset")


@query("overdispersion", "SELECT cls, CAST(mi AS BIGINT) AS mi, round(k2, 4) AS k2 FROM wk2", "wk2")
def _(i):
    return wa.overdispersion(Watch(i).expected(), "out_left", least=1.0)


@query("count_score", """SELECT key, CAST(mi AS BIGINT) AS mi, base, obs, CASE WHEN ok THEN round(e, 4) END AS expected, CASE WHEN ok THEN round(s, 4) END AS noise, CASE WHEN ok THEN round(obs - e, 4) + 0.0 END AS delta, CASE WHEN ok THEN round((obs - e) / s, 4) + 0.0 END AS z, n AS n_history, ok AS supported FROM wsc""", "wsc")
def _(i):
    x = Watch(i).expected()
    return wa.count_score(x, "out_left", wa.overdispersion(x, "out_left", least=1.0))


cte("wlog", """WITH h AS (SELECT a.key, a.mi, a.grp, p.raw_exp * a."offset" AS raw, ln(1 + p.out_left) - ln(1 + p.raw_exp * a."offset") AS e FROM woff a JOIN woff p ON p.key = a.key AND p.rn BETWEEN a.rn - 12 AND a.rn - 1 WHERE p.raw_exp >= 0 AND p.base > 0),
 l AS (SELECT key, mi, median(e) AS loc, count(*) AS n FROM h GROUP BY 1, 2), c AS (SELECT h.*, abs(e - loc) AS a FROM h JOIN l USING (key, mi)), o AS (SELECT key, mi, 1.4826 * median(a) AS own FROM c GROUP BY 1, 2), q AS (SELECT grp, mi, 1.4826 * median(a) AS pooled FROM c WHERE raw >= 1 GROUP BY 1, 2),
 x AS (SELECT w.*, l.n, loc, own, pooled, ln(1 + greatest(raw_exp * "offset", 0)) + loc AS center FROM woff w LEFT JOIN l USING (key, mi) LEFT JOIN o USING (key, mi) LEFT JOIN q ON q.grp = w.grp AND q.mi = w.mi),
 y AS (SELECT *, greatest(coalesce(pooled, 0), coalesce(own, 0), sqrt(ln(1 + 1 / exp(center)))) AS sigma, coalesce(n, 0) >= 6 AND coalesce(base, 0) > 0 AND center IS NOT NULL AS ok FROM x)
 SELECT *, greatest(exp(center + 0.5 * sigma * sigma) - 1, 0) AS mean, exp(center + 1.2 * sigma) - 1 AS up, greatest(exp(center - 1.2 * sigma) - 1, 0) AS lo FROM y""", "woff")


@query("log_count_interval", """SELECT key, CAST(mi AS BIGINT) AS mi, CASE WHEN ok THEN round(mean, 4) END AS expected, CASE WHEN ok THEN round(greatest(up, mean), 4) END AS upper, CASE WHEN ok THEN round(least(lo, mean), 4) END AS lower, CASE WHEN ok THEN round((ln(1 + out_left) - center) / sigma, 4) + 0.0 END AS z, ok AS supported FROM wlog""", "wlog")
def _(i):
    return Watch(i).interval().select("key", "mi", "expected", "upper", "lower", "z", "supported")


_T = lambda u: f"least(0.5 * exp(-0.5 * pow({u}, 2)), exp(-0.5 * pow({u}, 2)) / (sqrt(2 * pi()) * greatest({u}, 1e-300)))"
_UP = _T("((greatest(center + z * sigma, ln(fl)) + ln(1 + exp(-abs(center + z * sigma - ln(fl))))) - center) / sigma")
_LO = _T("((center - (center - z * sigma) - ln(1 - exp(least(ln(fl) - (center - z * sigma), -1e-12)))) / sigma)")


def threshold_sql(rows: str, budget: float) -> str:
    """Bisection over all rows (center, sigma, fl) from 0 to 64."""
    return f"""WITH RECURSIVE f AS MATERIALIZED ({rows}), s(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 64.0::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN b > {budget} THEN z ELSE lo END, CASE WHEN b > {budget} THEN hi ELSE z END FROM (SELECT k, lo, hi, z, sum({_UP} + CASE WHEN center - z * sigma > ln(1 + fl) THEN {_LO} ELSE 0 END) AS b
   FROM (SELECT *, (lo + hi) / 2 AS z FROM s WHERE k < 60), f GROUP BY k, lo, hi, z))
 SELECT hi AS z FROM s WHERE k = 60"""


@query("z_threshold", f"SELECT round(z, 4) AS z, 0.5::DOUBLE AS false_bound FROM ({threshold_sql(f'SELECT center, sigma, greatest(1.0, 0) AS fl FROM wlog WHERE mi = {MI} AND ok', 0.5)})", "wlog")
def _(i):
    return wa.z_threshold(Watch(i).interval().where(F.col("mi") == MI), 0.5, people=1.0, share=0.0)


@query("pick_signals", f"""SELECT key, 'out_left' AS flow, base, out_left AS obs, round(mean, 4) AS expected, round(greatest(out_left - greatest(up, mean), least(lo, mean) - out_left), 4) AS excess, CAST(1 AS BIGINT) AS n_flows FROM wlog WHERE mi = {MI} AND ok AND greatest(out_left - greatest(up, mean), least(lo, mean) - out_left) >= greatest(0.25, 0)""", "wlog")
def _(i):
    return wa.pick_signals({"out_left": Watch(i).interval()}, MI, 0.25, 0.0)


cte("umc", f"SELECT n_regionkey AS org, grp, 'x' AS region, p.region AS unit, CAST(sum(out_left) - sum(in_new) AS DOUBLE) AS net FROM wpan p JOIN nation ON n_nationkey = p.region WHERE mi = {MI} GROUP BY 1, 2, 4", "wpan")


@query("unit_move_evidence", """WITH t AS (SELECT org, grp, region, sum(greatest(net, 0)) AS l, sum(greatest(-net, 0)) AS g FROM umc GROUP BY 1, 2, 3), m AS (SELECT *, least(l, g) AS moved FROM t WHERE least(l, g) > 0 AND least(l, g) >= 0.2 * greatest(l, g)),
 c AS (SELECT u.*, moved, CASE WHEN net > 0 THEN 'lost' ELSE 'gained' END AS side FROM umc u JOIN m USING (org, grp, region) WHERE net <> 0),
 e AS (SELECT *, greatest(least(abs(net), moved - coalesce(sum(abs(net)) OVER (PARTITION BY org, grp, region, side ORDER BY abs(net) DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS explained FROM c)
 SELECT CAST(org AS BIGINT) AS org, grp, region, CAST(unit AS BIGINT) AS unit, side, moved, explained FROM e WHERE moved >= 1 AND explained > 0""", "umc")
def _(i):
    n = i.table("nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").alias("org"))
    c = Watch(i).panel.where(F.col("mi") == MI).join(n, "region").groupBy("org", "grp", F.lit("x").alias("reg"), F.col("region").alias("unit")).agg((F.sum("out_left") - F.sum("in_new")).cast("double").alias("net")).withColumnRenamed("reg", "region")
    return wa.unit_move_evidence(c, 1, 0.2)


#: Share of the base that would leave anyway; both sides of the check use it.
USUAL = 0.66
#: Deviation from which a row is a signal.
SIGNAL = 2.6


@query("cover_parents", f"""WITH k AS (SELECT grp, sign(out_left - base * {USUAL}::DOUBLE) AS sg, sum(out_left - base * {USUAL}::DOUBLE) AS e FROM wpan WHERE mi = {MI} AND abs(out_left - base * {USUAL}::DOUBLE) >= {SIGNAL} GROUP BY 1, 2), p AS (SELECT grp, sum(out_left - base * {USUAL}::DOUBLE) AS delta FROM wpan WHERE mi = {MI} GROUP BY 1)
 SELECT p.grp, 'out_left' AS flow, round(delta, 4) AS delta, round(e, 4) AS explained FROM p LEFT JOIN k ON k.grp = p.grp AND k.sg = sign(p.delta) WHERE coalesce(abs(e), 0) < 0.7 * abs(delta)""", "wpan")
def _(i):
    d = (F.col("out_left") - F.col("base") * USUAL).alias("delta")
    x = Watch(i).panel.where(F.col("mi") == MI).withColumn("delta", d)
    parents = x.groupBy("grp").agg(F.sum(F.col("out_left") - F.col("base") * USUAL).alias("delta")).withColumn("flow", F.lit("out_left"))
    return wa.cover_parents(parents, x.where(F.abs("delta") >= SIGNAL).select("grp", F.lit("out_left").alias("flow"), "delta"), ["grp"]).select("grp", "flow", "delta", "explained")


@query("watch_underload", f"""WITH z AS (SELECT p.region, avg(CASE WHEN ok AND (obs - e) / s >= 0 THEN 1 ELSE 0 END) AS share, count(*) AS n FROM wsc w JOIN (SELECT DISTINCT key, region FROM wpan) p USING (key) WHERE w.mi = {MI} AND w.base >= 1 GROUP BY 1),
 r AS (SELECT region, CAST(sum(raw_rows) FILTER (WHERE mi = {MI - 1}) AS BIGINT) AS prev, CAST(sum(raw_rows) FILTER (WHERE mi = {MI}) AS BIGINT) AS cur FROM wpan GROUP BY 1) SELECT CAST(region AS BIGINT) AS region, n, round(share, 4) AS share, prev, cur FROM z JOIN r USING (region) WHERE n >= 3 AND share >= 0.2 AND cur < 0.97 * prev""", ("wsc", "wpan"))
def _(i):
    w = Watch(i)
    x = w.expected()
    return wa.underload(wa.count_score(x, "out_left", wa.overdispersion(x, "out_left", least=1.0)), w.panel, MI, 1, 0.0, 0.2)


@query("seasonal_rate", f"""WITH t AS (SELECT grp, mi, sum(base) AS base, sum(out_left) AS obs, sum(out_left) / greatest(sum(base), 1) AS rate FROM wpan GROUP BY 1, 2), p AS (SELECT a.*, CASE WHEN a.mi >= 16 THEN y.rate * CASE WHEN ago > 0 THEN now / ago ELSE 1 END END AS pred FROM (SELECT *, avg(rate) OVER (PARTITION BY grp ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS now,
   avg(rate) OVER (PARTITION BY grp ORDER BY mi RANGE BETWEEN 15 PRECEDING AND 13 PRECEDING) AS ago FROM t) a LEFT JOIN t y ON y.grp = a.grp AND y.mi = a.mi - 12),
 e AS (SELECT grp, rate - pred AS e FROM p WHERE mi < {MI} AND pred IS NOT NULL), m AS (SELECT grp, median(e) AS m FROM e GROUP BY 1), d AS (SELECT e.grp, median(abs(e - m)) AS mad FROM e JOIN m USING (grp) GROUP BY 1),
 x AS (SELECT p.*, pred * base AS ex, greatest(1.4826 * mad * base, sqrt(greatest(pred * base, 1))) AS s FROM p JOIN d USING (grp) WHERE mi = {MI})
 SELECT grp, CAST(mi AS BIGINT) AS mi, {_B('base', 'obs')}, round(ex, 4) AS expected, round(s, 4) AS noise, round(obs - ex, 4) + 0.0 AS delta, round(abs(obs - ex) - 0.5 * s, 4) + 0.0 AS excess, abs(obs - ex) - 0.5 * s >= 1 AS signal FROM x""", "wpan")
def _(i):
    return wa.seasonal_rate(Watch(i).panel, "out_left", MI, ["grp"], 0.5, 1.0, 0.0)


@query("simple_rival", f"""WITH y AS (SELECT a.key, a.mi, CAST(a.out_left - b.out_left AS DOUBLE) AS yoy FROM wpan a JOIN wpan b ON b.key = a.key AND b.mi = a.mi - 12), m AS (SELECT key, median(yoy) AS m FROM y WHERE mi < {MI} GROUP BY 1), d AS (SELECT y.key, m, median(abs(yoy - m)) AS mad FROM y JOIN m USING (key) WHERE mi < {MI} GROUP BY 1, 2)
 SELECT key, yoy, round((yoy - m) / greatest(1.4826 * mad, 1), 4) + 0.0 AS z FROM y JOIN d USING (key) WHERE mi = {MI} ORDER BY abs((yoy - m) / greatest(1.4826 * mad, 1)) DESC, key LIMIT 25""", "wpan")
def _(i):
    return wa.simple_rival(Watch(i).panel, "out_left", MI)


# The cascade, level by level: limits of both flows at one common z, rows over them, segments that rows do not explain.
BUDGET, FLOWS = 60.0, ("out_left", "in_new")
for _f in FLOWS:
    for _n in ("wexp", "woff", "wlog"):
        _needs, _body = CTES[_n]
        _body = re.sub(r"\b(wexp|woff)\b", rf"\1_{_f}", _body.replace("out_left", _f)).replace("raw >= 1 ", f"raw >= {wa.MIN_NULL_MEAN} ")
        cte(f"{_n}_{_f}", _body, *[f"{_x}_{_f}" if _x in ("wexp", "woff") else _x for _x in _needs])
cte("wz", threshold_sql(" UNION ALL ".join(f"SELECT center, sigma, greatest(0.25, 0) AS fl FROM wlog_{f} WHERE mi = {MI} AND ok" for f in FLOWS), BUDGET), *[f"wlog_{f}" for f in FLOWS])
cte("wrow", " UNION ALL ".join(f"""SELECT key, grp, '{f}' AS flow, {f} AS obs, mean AS expected, greatest({f} - greatest(exp(center + z * sigma) - 1, mean), least(greatest(exp(center - z * sigma) - 1, 0), mean) - {f}) AS excess
 FROM wlog_{f}, wz WHERE mi = {MI} AND ok""" for f in FLOWS), "wz", *[f"wlog_{f}" for f in FLOWS])
cte("wbest", "SELECT * FROM wrow WHERE excess >= 0.25 QUALIFY row_number() OVER (PARTITION BY key ORDER BY excess DESC, flow DESC) = 1", "wrow")
cte("wseg", " UNION ALL ".join(f"""SELECT grp, '{f}' AS flow, obs, ex AS expected, obs - ex AS delta, abs(obs - ex) - 4 * s AS excess FROM (WITH t AS (SELECT grp, mi, sum(base) AS base, sum({f}) AS obs, sum({f}) / greatest(sum(base), 1) AS rate FROM wpan GROUP BY 1, 2),
  p AS (SELECT a.*, CASE WHEN a.mi >= 16 THEN y.rate * CASE WHEN ago > 0 THEN now / ago ELSE 1 END END AS pred FROM (SELECT *, avg(rate) OVER (PARTITION BY grp ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS now,
   avg(rate) OVER (PARTITION BY grp ORDER BY mi RANGE BETWEEN 15 PRECEDING AND 13 PRECEDING) AS ago FROM t) a LEFT JOIN t y ON y.grp = a.grp AND y.mi = a.mi - 12),
  e AS (SELECT grp, rate - pred AS e FROM p WHERE mi < {MI} AND pred IS NOT NULL), m AS (SELECT grp, median(e) AS m FROM e GROUP BY 1), d AS (SELECT e.grp, median(abs(e - m)) AS mad FROM e JOIN m USING (grp) GROUP BY 1)
  SELECT p.grp, obs, pred * base AS ex, greatest(1.4826 * mad * base, sqrt(greatest(pred * base, 1))) AS s FROM p JOIN d USING (grp) WHERE mi = {MI}) WHERE abs(obs - ex) - 4 * s >= 0.25""" for f in FLOWS), "wpan")


@query("watch_detect", f"""WITH k AS (SELECT grp, flow, sign(obs - expected) AS sg, sum(obs - expected) AS explained FROM wbest GROUP BY 1, 2, 3),
 c AS (SELECT 'row' AS level, key, flow, obs, expected, obs - expected AS delta, excess FROM wbest UNION ALL
  SELECT 'slice', w.grp, w.flow, obs, expected, delta, excess FROM wseg w LEFT JOIN k ON k.grp = w.grp AND k.flow = w.flow AND k.sg = sign(delta) WHERE coalesce(abs(explained), 0) < 0.7 * abs(delta))
 SELECT level, key, flow, CAST(obs AS BIGINT) AS obs, round(expected, 4) AS expected, round(delta, 4) + 0.0 AS delta, round(excess, 4) + 0.0 AS excess, row_number() OVER (PARTITION BY level ORDER BY excess DESC, key, flow) AS rank FROM c""", ("wbest", "wseg"))
def _(i):
    return wa.detect(Watch(i).panel, FLOWS, MI, BUDGET, 0.25, 0.0, MINB)
