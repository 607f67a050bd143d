"""Backtest queries: organisations are customers, stock = their line items of a month, units are nations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import backtest as bt
from .registry import cte, query

FIRST, LAST, T0, T1 = 24, 79, 70, 79


class Backtest:
    def __init__(self, i):
        self.i = i

    @cached_property
    def by_org(self):
        def build():
            f = self.i.payroll.where(F.col("mi").between(FIRST, LAST)).groupBy(F.col("person").alias("org"), "mi").agg(F.count(F.lit(1)).alias("stock"))
            meta = self.i.table("customer").select(F.col("c_custkey").alias("org"), F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("seg"))
            p = bt.org_rows(f, meta, FIRST, LAST)
            more = lambda r: {"pipe": F.when((F.col("org") + r["mi"]) % 5 == 0, 2).otherwise(0), "booked_in": F.least(r["inflow"], F.lit(1)), "booked_out": F.least(r["outflow"], F.lit(1))}
            names = p.schema["rows"].dataType.elementType.names
            return p.select("org", F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in names], *[v.alias(n) for n, v in more(r).items()])).alias("rows"))
        return self.i.staged("backtest_panel", build)

    @cached_property
    def panel(self):
        return self.by_org.select("org", F.inline("rows"))

    @cached_property
    def terms(self):
        wide = self.i.staged("backtest_terms", lambda: bt.wide_terms(self.panel, bt.pooled_rates(self.panel, "outflow"), bt.pooled_rates(self.panel, "inflow"), by_org=self.by_org, months=(T0, T1)))
        return bt.long_terms(wide, bt.term_names())

    @cached_property
    def rolled(self):
        return bt.roll_terms(self.terms, ["unit"])

    @cached_property
    def facts(self):
        return bt.actuals(self.panel.where(F.col("mi").between(T0, T1)), ["unit"])

    @cached_property
    def pred(self):
        return self.i.staged("backtest_pred", lambda: bt.combine(self.rolled, self.facts, ["unit"], (0.8, 1.0)))


cte("bp", f"""WITH f AS (SELECT person AS org, mi, count(*) AS stock FROM payroll WHERE mi BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2),
 g AS (SELECT o.org, m.range AS mi, coalesce(f.stock, 0) AS stock, f.stock IS NOT NULL AS present FROM (SELECT DISTINCT org FROM f) o CROSS JOIN range({FIRST}, {LAST + 1}) m LEFT JOIN f ON f.org = o.org AND f.mi = m.range),
 d AS (SELECT g.*, lag(stock) OVER (PARTITION BY org ORDER BY mi) AS p FROM g)
 SELECT d.org, mi, stock, present, c_nationkey AS unit, c_mktsegment AS seg, greatest(coalesce(p - stock, 0), 0) AS outflow, greatest(coalesce(stock - p, 0), 0) AS inflow, coalesce(p, 0) AS base, CASE WHEN (d.org + mi) % 5 = 0 THEN 2 ELSE 0 END AS pipe,
  least(greatest(coalesce(stock - p, 0), 0), 1) AS booked_in, least(greatest(coalesce(p - stock, 0), 0), 1) AS booked_out FROM d JOIN customer ON c_custkey = d.org""", "payroll")
cte("brr", """WITH x AS (SELECT *, mi % 12 AS sl, CASE WHEN present THEN stock END AS x FROM bp), y AS (SELECT *, coalesce(avg(x) OVER (PARTITION BY org, sl ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ac, count(*) OVER (PARTITION BY org, sl ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nc,
   coalesce(avg(x) OVER (PARTITION BY org, sl ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ai, count(*) OVER (PARTITION BY org, sl ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ni FROM x),
 z AS (SELECT *, lag(ai) OVER w AS al, lag(ni) OVER w AS nl, lag(outflow) OVER w AS o1, lag(outflow, 2) OVER w AS o2, lag(stock, 13) OVER w AS bf, lag(stock, 12) OVER w AS fy, lag(outflow, 12) OVER w AS oy, greatest(lag(stock, 11) OVER w, lag(stock, 10) OVER w, lag(stock, 9) OVER w) AS af FROM y WINDOW w AS (PARTITION BY org ORDER BY mi)),
 r AS (SELECT *, coalesce(CASE WHEN nc >= 2 AND nl >= 2 AND al > 0 THEN ac / al END, CASE WHEN bf >= 5 THEN fy / greatest(bf, 1) END) AS ratio, o1 > 0 AND o2 > 0 AS bth, coalesce(oy > 0 AND bf > 0 AND af >= 0.95 * bf, false) AS rec FROM z)
 SELECT * FROM r""", "bp")
cte("brf", """WITH q AS (SELECT *, CASE WHEN ratio > 1.1 THEN -base * (ratio - 1) WHEN ratio < 0.9 THEN greatest(CASE WHEN bth THEN (o1 + o2) / 2 ELSE 0 END, base * (1 - ratio)) * CASE WHEN rec THEN 0.5 ELSE 1 END WHEN bth THEN (o1 + o2) / 2 WHEN o1 > 0 THEN o1 * 0.5 ELSE 0 END AS pr FROM brr)
 SELECT org, mi, CASE WHEN pr > 0 THEN least(pr, base) ELSE pr END AS rule FROM q""", "brr")
for _p, _c in (("o", "outflow"), ("i", "inflow")):
    cte(f"bpr{_p}", f"""WITH m AS (SELECT seg, mi, sum({_c}) AS p, sum(base) AS q FROM bp WHERE present GROUP BY 1, 2), t AS (SELECT mi, sum(p) AS p, sum(q) AS q FROM m GROUP BY 1),
     u AS (SELECT mi, sum(p) OVER w / nullif(sum(q) OVER w, 0) AS rate_all FROM t WINDOW w AS (ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
     SELECT seg, mi, sum(p) OVER w / nullif(sum(q) OVER w, 0) AS rate_seg, rate_all FROM m JOIN u USING (mi) WINDOW w AS (PARTITION BY seg ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "bp")


def _terms() -> str:
    t = {("out", "none"): "0", ("out", "rule"): "greatest(rule, 0)", ("in", "none"): "0", ("in", "rule"): "greatest(-rule, 0)", ("pipe", "none"): "0"}
    fr = "OVER (PARTITION BY org ORDER BY mi ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    for fam, c, r in (("out", "vo", "r_out"), ("in", "vi", "r_in")):
        for k in (1, 3, 6):
            w = fr.format(k)
            t[(fam, f"mean_k{k}")] = f"coalesce(avg({c}) {w}, 0)"
            for lam in (0, 5):
                t[(fam, f"rate_k{k}_lam{lam}")] = f"base * coalesce((coalesce(sum({c}) {w}, 0) + {lam} * coalesce({r}, 0)) / nullif(coalesce(sum(vb) {w}, 0) + {lam}, 0), {r}, 0)"
        t[(fam, "median_k3")] = f"coalesce(median({c}) {fr.format(3)}, 0)"
        for a in (0.3, 0.5):
            lag = "lag({}, {}) OVER (PARTITION BY org ORDER BY mi)"
            num = " + ".join(f"coalesce({lag.format(c, j)} * {a * (1 - a) ** (j - 1)!r}, 0)" for j in range(1, 13))
            den = " + ".join(f"CASE WHEN {lag.format(c, j)} IS NOT NULL THEN {a * (1 - a) ** (j - 1)!r} ELSE 0 END" for j in range(1, 13))
            t[(fam, f"ewma{a:g}")] = f"coalesce(({num}) / nullif({den}, 0), 0)"
    for k in (0.5, 1.0):
        t[("pipe", f"plan_k{k:g}")] = f"pipe * {k}"
    wide = ", ".join(f"CAST({e} AS DOUBLE) AS t{n}" for n, e in enumerate(t.values()))
    x = f"SELECT org, unit, seg, mi, stock, base, {wide} FROM (SELECT bp.*, rule, o.rate_seg AS r_out, n.rate_seg AS r_in, CASE WHEN present THEN outflow::DOUBLE END AS vo, CASE WHEN present THEN inflow::DOUBLE END AS vi, CASE WHEN present THEN base::DOUBLE END AS vb FROM bp JOIN brf USING (org, mi) LEFT JOIN bpro o ON o.seg = bp.seg AND o.mi = bp.mi LEFT JOIN bpri n ON n.seg = bp.seg AND n.mi = bp.mi)"
    return f"WITH x AS ({x}) " + " UNION ALL ".join(f"SELECT org, unit, seg, mi, stock, base, '{f}' AS family, '{n}' AS term, t{k} AS value FROM x WHERE mi BETWEEN {T0} AND {T1}" for k, (f, n) in enumerate(t))


cte("btm", _terms(), "bp", "brf", "bpro", "bpri")
cte("bro", "SELECT unit, mi, family, term, sum(value) AS value FROM btm GROUP BY 1, 2, 3, 4", "btm")
cte("bfa", f"SELECT unit, mi, sum(stock) AS fact, sum(base) AS base, sum(outflow) AS outflow FROM bp WHERE mi BETWEEN {T0} AND {T1} GROUP BY 1, 2", "bp")
cte("bpd", """SELECT f.unit, f.mi, o.term AS out_term, i.term AS in_term, p.term AS pipe_term, s.scale, f.fact, f.base, f.base - s.scale * o.value + s.scale * i.value + p.value AS pred
 FROM bfa f JOIN bro o ON o.unit = f.unit AND o.mi = f.mi AND o.family = 'out' JOIN bro i ON i.unit = f.unit AND i.mi = f.mi AND i.family = 'in' JOIN bro p ON p.unit = f.unit AND p.mi = f.mi AND p.family = 'pipe', (VALUES (0.8::DOUBLE), (1.0::DOUBLE)) s(scale)
 WHERE NOT (i.term = 'rule' AND p.term <> 'none')""", "bfa", "bro")
_CB = "out_term, in_term, pipe_term, scale"


@query("org_panel", "SELECT org, CAST(mi AS BIGINT) AS mi, stock, present, CAST(unit AS BIGINT) AS unit, seg, outflow, inflow, base FROM bp", "bp")
def _(i):
    return Backtest(i).panel.drop("pipe", "booked_in", "booked_out")


@query("rule_forecast", f"SELECT org, CAST(mi AS BIGINT) AS mi, round(rule, 4) + 0.0 AS rule FROM brf WHERE mi >= {T0}", "brf")
def _(i):
    return bt.rule_forecast(Backtest(i).panel).where(F.col("mi") >= T0)


@query("pooled_rates", "SELECT seg, CAST(mi AS BIGINT) AS mi, round(rate_seg, 4) AS rate_seg, round(rate_all, 4) AS rate_all FROM bpro", "bpro")
def _(i):
    return bt.pooled_rates(Backtest(i).panel)


@query("roll_terms_unit", "SELECT CAST(unit AS BIGINT) AS unit, CAST(mi AS BIGINT) AS mi, family, term, round(value, 6) + 0.0 AS value FROM bro", "bro", digits=6)
def _(i):
    return Backtest(i).rolled


@query("roll_terms_whole", "SELECT CAST(mi AS BIGINT) AS mi, family, term, round(sum(value), 6) + 0.0 AS value FROM btm GROUP BY mi, family, term", "btm", digits=6)
def _(i):
    return bt.roll_terms(Backtest(i).terms, [])


@query("term_grid", "SELECT CAST(mi AS BIGINT) AS mi, seg, family, term, round(sum(value), 6) + 0.0 AS value, count(*) AS n FROM btm GROUP BY mi, seg, family, term", "btm", digits=6)
def _(i):
    return Backtest(i).terms.groupBy("mi", "seg", "family", "term").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("combine_and_score", f"SELECT {_CB}, round(sum(abs(pred - fact)) / sum(fact), 4) AS wape, round(sum(pred - fact) / sum(fact), 4) + 0.0 AS bias FROM bpd GROUP BY {_CB}", "bpd")
def _(i):
    b = Backtest(i)
    return bt.totals(bt.combine(b.rolled, b.facts, ["unit"], (0.8, 1.0)))


@query("forecast_metrics", f"""WITH x AS (SELECT *, abs(pred - fact) AS e FROM bpd WHERE pipe_term = 'none' AND scale = 1.0), m AS (SELECT {_CB}, mi, sum(e) / sum(fact) AS w FROM x GROUP BY {_CB}, mi), w AS (SELECT {_CB}, max(w) AS worst, stddev(w) AS sd FROM m GROUP BY {_CB})
 SELECT x.out_term, x.in_term, x.pipe_term, x.scale, round(sum(e) / sum(fact), 4) AS wape, round(sum(pred - fact) / sum(fact), 4) + 0.0 AS bias, round(quantile_cont(e / nullif(fact, 0), 0.9), 4) AS p90, round(any_value(worst), 4) AS worst_month, round(any_value(sd), 4) AS std_month
 FROM x JOIN w USING ({_CB}) GROUP BY 1, 2, 3, 4""", "bpd")
def _(i):
    return bt.metrics(Backtest(i).pred.where("pipe_term = 'none' and scale = 1.0"))


@query("rank_correlation", """WITH x AS (SELECT mi, round(pred - base, 9) AS x, (fact - base)::DOUBLE AS y FROM bpd WHERE out_term = 'mean_k3' AND in_term = 'mean_k3' AND pipe_term = 'none' AND scale = 1.0),
 r AS (SELECT mi, rank() OVER (PARTITION BY mi ORDER BY x) + (count(*) OVER (PARTITION BY mi, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY mi ORDER BY y) + (count(*) OVER (PARTITION BY mi, y) - 1) / 2 AS ry FROM x) SELECT CAST(mi AS BIGINT) AS mi, round(corr(rx, ry), 3) AS spearman FROM r GROUP BY 1""", "bpd", digits=3)
def _(i):
    p = Backtest(i).pred.where("out_term = 'mean_k3' and in_term = 'mean_k3' and pipe_term = 'none' and scale = 1.0")
    return bt.rank_correlation(p)


@query("calibrate", """WITH j AS (SELECT r.family, r.term, r.mi, r.value AS v, f.outflow::DOUBLE AS a FROM bro r JOIN bfa f USING (unit, mi) WHERE family = 'out'), m AS (SELECT family, term, mi, sum(v) AS p, sum(a) AS a, sum(v * v) AS pp, sum(v * a) AS pa, count(*) AS n FROM j GROUP BY 1, 2, 3),
 s AS (SELECT family, term, mi, sum(p) OVER w AS p, sum(a) OVER w AS a, sum(pp) OVER w AS pp, sum(pa) OVER w AS pa, sum(n) OVER w AS n FROM m WINDOW w AS (PARTITION BY family, term ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT *, CASE WHEN n * pp - p * p > 1e-9 THEN (n * pa - p * a) / (n * pp - p * p) END AS sl FROM s)
 SELECT family, term, CAST(mi AS BIGINT) AS mi, round(least(greatest(coalesce(a / nullif(p, 0), 1), 0.5), 2.0), 4) AS k_global, round(coalesce(sl, 1), 4) AS slope, round(coalesce((a - sl * p) / n, 0), 4) + 0.0 AS intercept FROM t""", ("bro", "bfa"))
def _(i):
    b = Backtest(i)
    a = b.panel.where(F.col("mi").between(T0, T1)).groupBy("unit", "mi").agg(F.sum("outflow").cast("double").alias("actual"))
    return bt.calibrate(b.rolled.where("family = 'out'"), a, ["unit"])


@query("bookkeeping_coverage", """SELECT CAST(mi AS BIGINT) AS mi, CAST(sum(greatest(stock - base, 0)) FILTER (WHERE stock > base) AS BIGINT) AS up, CAST(sum(base - stock) FILTER (WHERE stock < base) AS BIGINT) AS down, round(sum(booked_in) / sum(stock - base) FILTER (WHERE stock > base), 4) AS share_up,
 round(sum(booked_out) / sum(base - stock) FILTER (WHERE stock < base), 4) AS share_down FROM bp WHERE present GROUP BY 1""", "bp")
def _(i):
    return bt.coverage(Backtest(i).panel)


@query("forecast_baselines", f"""WITH f AS (SELECT unit, mi, sum(stock) AS fact, sum(base) AS base, sum(base) + sum(pipe) AS plan FROM bp GROUP BY 1, 2), l AS (SELECT *, lag(fact) OVER w AS a, lag(fact, 4) OVER w AS b FROM f WINDOW w AS (PARTITION BY unit ORDER BY mi)),
 u AS (SELECT unit, mi, 'last fact' AS name, a::DOUBLE AS pred, fact, base FROM l UNION ALL SELECT unit, mi, 'trend 3', a + (a - b) / 3.0, fact, base FROM l UNION ALL SELECT unit, mi, 'plan', plan::DOUBLE, fact, base FROM l)
 SELECT CAST(unit AS BIGINT) AS unit, CAST(mi AS BIGINT) AS mi, name, round(pred, 4) AS pred, CAST(fact AS BIGINT) AS fact, CAST(base AS BIGINT) AS base FROM u WHERE pred IS NOT NULL""", "bp")
def _(i):
    p = Backtest(i).panel.groupBy("unit", "mi").agg(F.sum("stock").alias("fact"), F.sum("base").alias("base"), (F.sum("base") + F.sum("pipe")).alias("plan"))
    return bt.baselines(p, ["unit"])


@query("honest_selection", f"""WITH m AS (SELECT {_CB}, mi, sum(abs(pred - fact)) AS e, sum(fact) AS f FROM bpd GROUP BY {_CB}, mi), x AS (SELECT *, sum(e) OVER w / sum(f) OVER w AS past, e / f AS wape FROM m WINDOW w AS (PARTITION BY {_CB} ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT CAST(mi AS BIGINT) AS mi, round(past, 4) AS past, round(wape, 4) AS wape FROM x WHERE past IS NOT NULL AND mi >= 73 QUALIFY row_number() OVER (PARTITION BY mi ORDER BY past, {_CB}) = 1""", "bpd")
def _(i):
    return bt.honest_selection(Backtest(i).pred, first=73).select("mi", "past", "wape")


@query("ablation", """SELECT variant, round(sum(abs(pred - fact)) / sum(fact), 4) AS wape FROM (
 SELECT 'full' AS variant, * FROM bpd WHERE out_term = 'mean_k3' AND in_term = 'mean_k3' AND pipe_term = 'plan_k0.5' AND scale = 1.0 UNION ALL SELECT 'out_term', * FROM bpd WHERE out_term = 'none' AND in_term = 'mean_k3' AND pipe_term = 'plan_k0.5' AND scale = 1.0
 UNION ALL SELECT 'in_term', * FROM bpd WHERE out_term = 'mean_k3' AND in_term = 'none' AND pipe_term = 'plan_k0.5' AND scale = 1.0 UNION ALL SELECT 'pipe_term', * FROM bpd WHERE out_term = 'mean_k3' AND in_term = 'mean_k3' AND pipe_term = 'none' AND scale = 1.0) GROUP BY 1""", "bpd")
def _(i):
    return bt.ablation(Backtest(i).pred, {"out_term": "mean_k3", "in_term": "mean_k3", "pipe_term": "plan_k0.5", "scale": 1.0})


@query("family_best", f"SELECT out_term, round(min(w), 4) AS wape FROM (SELECT {_CB}, sum(abs(pred - fact)) / sum(fact) AS w FROM bpd GROUP BY {_CB}) GROUP BY 1", "bpd")
def _(i):
    return bt.family_best(bt.metrics(Backtest(i).pred), "out_term").select("out_term", "wape")
