"""Forecast grid: variants of every term, combined and calibrated at unit × segment, scored over the last year.

Organisations are customers over all months of the ledger, units are nations, regions their regions; the last
``MONTHS`` months are forecast.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import forecast_grid as fg
from ..operators import forecast_terms as ft
from .registry import CTES, cte, query

MONTHS = 12
KEYS = ["unit", "region", "seg"]
BASES = ["metrics", "orgs"]


class Grid:
    def __init__(self, i):
        self.i = i

    @cached_property
    def facts(self):
        return self.i.staged("grid_facts", lambda: self.i.payroll.groupBy(F.col("person").alias("org"), "mi").agg(F.count(F.lit(1)).alias("stock")))

    @cached_property
    def period(self) -> tuple[int, int]:
        row = self.facts.agg(F.min("mi"), F.max("mi")).first()
        return (row[0], row[1]) if row[0] is not None else (0, 0)

    @property
    def first(self) -> int:
        return self.period[1] - MONTHS + 1

    @cached_property
    def by_org(self):
        """The panel with one row per customer, its months in an array."""
        def build():
            nation = self.i.table("nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
            meta = self.i.table("customer").select(F.col("c_custkey").alias("org"), F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("seg")).join(nation, "unit")
            p = bt.org_rows(self.facts, meta, *self.period)
            more = lambda r: {"pipe": F.when((F.col("org") + r["mi"]) % 5 == 0, 2).otherwise(0), "won": F.least(r["inflow"], F.lit(1))}
            names = p.schema["rows"].dataType.elementType.names
            return p.select("org", F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in names], *[v.alias(n) for n, v in more(r).items()])).alias("rows"))
        return self.i.staged("grid_panel", build)

    @cached_property
    def panel(self):
        return self.by_org.select("org", F.inline("rows"))

    @cached_property
    def history(self):
        return ft.with_history(self.panel, self.panel.select("mi", F.col("pipe").alias("plan"), F.col("won").alias("fact")), self.by_org)

    @cached_property
    def rolled(self):
        v = ft.all_variants()
        return self.i.staged("grid_terms", lambda: ft.roll_cells(ft.term_columns(self.history, v, KEYS, self.first), v, KEYS))

    @cached_property
    def mart(self):
        """The mart at the small grain: fact, plan (not everywhere), its own prediction, and the two bases."""
        w = W.partitionBy(*KEYS).orderBy("mi")
        p = self.panel.groupBy(*KEYS, "mi").agg(F.sum("stock").alias("fact"), F.sum("base").alias("metrics"), F.sum(F.when(F.col("base") >= 2, F.col("base")).otherwise(0)).alias("orgs"), F.sum("pipe").alias("pipe"))
        plan = F.when((F.col("unit") + F.col("mi")) % 7 != 0, F.col("metrics") + F.col("pipe"))
        return p.select(*KEYS, "mi", "fact", "metrics", "orgs", plan.alias("plan"), F.floor((F.lag("fact", 1).over(w) + F.lag("fact", 2).over(w)) / 2).alias("prediction"))

    @cached_property
    def cells(self):
        return self.mart.join(self.rolled, [*KEYS, "mi"])

    @cached_property
    def errors(self):
        return self.i.staged("grid_errors", lambda: fg.month_errors(self.cells, ft.all_variants(), BASES))


# ------------------------------------------------------------------ SQL twins
cte("gf", "SELECT person AS org, mi, count(*) AS stock FROM payroll GROUP BY 1, 2", "payroll")
cte("gp", """WITH g AS (SELECT o.org, m.mi, coalesce(f.stock, 0) AS stock, f.stock IS NOT NULL AS present FROM (SELECT DISTINCT org FROM gf) o CROSS JOIN (SELECT unnest(range((SELECT min(mi) FROM gf), (SELECT max(mi) FROM gf) + 1)) AS mi) m LEFT JOIN gf f ON f.org = o.org AND f.mi = m.mi),
 d AS (SELECT g.*, lag(stock) OVER (PARTITION BY org ORDER BY mi) AS p FROM g)
 SELECT d.org, mi, stock, present, c_nationkey AS unit, n_regionkey AS region, c_mktsegment AS seg, greatest(coalesce(p - stock, 0), 0) AS outflow, coalesce(p, 0) AS base,
  CASE WHEN (d.org + mi) % 5 = 0 THEN 2 ELSE 0 END AS pipe, least(greatest(coalesce(stock - p, 0), 0), 1) AS won FROM d JOIN customer ON c_custkey = d.org JOIN nation ON n_nationkey = c_nationkey""", "gf")
cte("grr", CTES["brr"][1].replace("FROM bp)", "FROM gp)"), "gp")
for _n, _k in (("whole", "1"), ("region", "region"), ("seg", "seg")):
    cte(f"gg{_n}", f"""WITH m AS (SELECT {_k} AS k, mi, sum(stock) AS s FROM gp GROUP BY 1, 2), r AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY mi) AS p FROM m)
     SELECT k, mi, coalesce(avg(CASE WHEN p > 0 THEN (s - p) / p END) OVER (PARTITION BY k ORDER BY mi ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS growth FROM r""", "gp")
_KS = (1, 3, 6, None)


def _rows(k: int | None) -> str:
    return f"ROWS BETWEEN {k or 'UNBOUNDED'} PRECEDING AND 1 PRECEDING"


cte("gsr", "WITH m AS (SELECT seg, mi, sum(outflow) AS p, sum(stock) AS q FROM gp GROUP BY 1, 2) SELECT seg, mi, " + ", ".join(
    f"CASE WHEN sum(q) OVER (PARTITION BY seg ORDER BY mi {_rows(k)}) > 0 THEN sum(p) OVER (PARTITION BY seg ORDER BY mi {_rows(k)}) / sum(q) OVER (PARTITION BY seg ORDER BY mi {_rows(k)}) ELSE 0 END AS rate_{k or 'all'}" for k in _KS) + " FROM m", "gp")
cte("gpr", f"WITH m AS (SELECT mi, sum(pipe) AS p, sum(won) AS f FROM gp GROUP BY 1) SELECT mi, CASE WHEN sum(p) OVER (ORDER BY mi {_rows(None)}) > 0 THEN least(greatest(sum(f) OVER (ORDER BY mi {_rows(None)}) / sum(p) OVER (ORDER BY mi {_rows(None)}), 0), 2) ELSE 1 END AS realised FROM m", "gp")


def _rule(one_off="0.5", rec="0.5", up="1.1", down="0.9", per="(o1 + o2) / 2") -> str:
    keep = f"CASE WHEN bth THEN {per} ELSE 0 END"
    raw = (f"CASE WHEN ratio > {up} THEN -base * (ratio - 1) WHEN ratio < {down} THEN greatest({keep}, base * (1 - ratio)) * CASE WHEN rec THEN {rec} ELSE 1 END"
           f" WHEN bth THEN {per} WHEN o1 > 0 THEN o1 * {one_off} ELSE 0 END")
    return f"least({raw}, base)"


def _sql_terms() -> dict[str, list[tuple[str, str]]]:
    over = lambda e, k: f"{e} OVER (PARTITION BY org ORDER BY mi {_rows(k)})"

    def weighted(c, a):
        lag = lambda j: f"lag({c}, {j}) OVER (PARTITION BY org ORDER BY mi)"
        num = " + ".join(f"coalesce({lag(j)} * {a * (1 - a) ** (j - 1)!r}, 0)" for j in range(1, 13))
        den = " + ".join(f"CASE WHEN {lag(j)} IS NOT NULL THEN {a * (1 - a) ** (j - 1)!r} ELSE 0 END" for j in range(1, 13))
        return f"coalesce(({num}) / nullif({den}, 0), 0)"

    def rate(k, lam):
        num, den = f"coalesce({over('sum(vo)', k)}, 0)", f"coalesce({over('sum(vs)', k)}, 0)"
        own = f"coalesce({num} / nullif({den}, 0), 0)"
        return f"base * (({den} * {own} + {lam} * rate_{k or 'all'}) / ({den} + {lam}))" if lam else f"base * {own}"

    out = [("none", "0"), ("rule", _rule())] + [(f"rule_one_off{k}", _rule(one_off=k)) for k in ("0", "0.25", "1")] + [(f"rule_recovered{k}", _rule(rec=k)) for k in ("0.2", "0.7", "1")]
    out += [("rule_season1.05_0.95", _rule(up="1.05", down="0.95")), ("rule_season1.2_0.8", _rule(up="1.2", down="0.8"))] + [(f"rule_persist_{p}", _rule(per=f"{f}(o1, o2)")) for p, f in (("max", "greatest"), ("min", "least"))]
    out = [(n, f"greatest({e}, 0)") for n, e in out]
    out += [(f"rate_k{k or 'all'}_lam{lam}", rate(k, lam)) for k in _KS for lam in (0, 5)] + [(f"ewma{a}", weighted("vo", a)) for a in (0.3, 0.5, 0.7)] + [(f"median_k{k}", f"coalesce({over('median(vo)', k)}, 0)") for k in (3, 6)]
    mean = lambda c, k: f"coalesce({over(f'avg({c})', k)}, 0)"
    ins = [("none", "0"), ("rule_season", f"greatest(-({_rule()}), 0)")] + [(f"won_mean_k{k}", mean("vw", k)) for k in (1, 2, 3, 6)] + [(f"won_median_k{k}", f"coalesce({over('median(vw)', k)}, 0)") for k in (3, 6)]
    ins += [(f"won_ewma{a}", weighted("vw", a)) for a in (0.3, 0.5, 0.7)] + [(f"growth_{n}", f"greatest(g_{n} * base, 0)") for n in ("whole", "region", "seg")] + [(f"delta_ewma{a}", weighted("vd", a)) for a in (0.3, 0.5)]
    ins += [(f"delta_median_k{k}", f"coalesce({over('median(vd)', k)}, 0)") for k in (3, 6)] + [(f"delta_mean_k{k}", mean("vd", k)) for k in (3, 6)]
    ins += [(f"ratio_mean_k{k}", f"base * {mean('vr', k)}") for k in (3, 6, 12)] + [(f"ratio_ewma{a}", f"base * {weighted('vr', a)}") for a in (0.3, 0.5)]
    ins += [(f"ratio_shrunk_lam{lam}", f"base * ((base * {mean('vr', 6)} + {lam} * g_seg) / (base + {lam}))") for lam in (20, 100)]
    pipe = [("none", "0")] + [(f"plan_x{k}", f"pipe * {k}") for k in ("0.3", "0.5", "0.7", "1")] + [("plan_x_past", "pipe * realised")]
    return {"out": out, "in": ins, "pipe": pipe}


_TERMS = _sql_terms()
_ALL = [(f, n, e) for f, rows in _TERMS.items() for n, e in rows]
cte("gw", "WITH h AS (SELECT r.*, lag(stock) OVER (PARTITION BY org ORDER BY mi) AS was, coalesce(lag(present) OVER (PARTITION BY org ORDER BY mi), false) AS there FROM grr r), x AS (SELECT h.*, "
    "CASE WHEN present THEN outflow::DOUBLE END AS vo, CASE WHEN present THEN won::DOUBLE END AS vw, CASE WHEN present THEN stock::DOUBLE END AS vs, CASE WHEN present AND there THEN (stock - was)::DOUBLE END AS vd, "
    "CASE WHEN present AND there AND was >= 5 THEN least(greatest(stock / was, 0.5), 2) - 1 END AS vr, s.* EXCLUDE (seg, mi), gw_.growth AS g_whole, gr_.growth AS g_region, gs_.growth AS g_seg, realised "
    "FROM h LEFT JOIN gsr s ON s.seg = h.seg AND s.mi = h.mi JOIN ggwhole gw_ ON gw_.mi = h.mi JOIN ggregion gr_ ON gr_.mi = h.mi AND gr_.k = h.region JOIN ggseg gs_ ON gs_.mi = h.mi AND gs_.k = h.seg JOIN gpr ON gpr.mi = h.mi) "
    "SELECT org, unit, region, seg, mi, " + ", ".join(f"coalesce(CAST({e} AS DOUBLE), 0) AS t{k}" for k, (_, _, e) in enumerate(_ALL)) + " FROM x", "grr", "gsr", "ggwhole", "ggregion", "ggseg", "gpr")
cte("gc", f"SELECT unit, region, seg, mi, {', '.join(f'sum(t{k}) AS t{k}' for k in range(len(_ALL)))} FROM gw WHERE mi > (SELECT max(mi) FROM gf) - {MONTHS} GROUP BY 1, 2, 3, 4", "gw", "gf")
for _f in ft.FAMILIES:
    cte(f"gt{_f}", " UNION ALL ".join(f"SELECT unit, seg, region, mi, '{n}' AS term, t{k} AS v FROM gc" for k, (f, n, _) in enumerate(_ALL) if f == _f), "gc")
cte("gm", """SELECT unit, region, seg, mi, fact, metrics, orgs, CASE WHEN (unit + mi) % 7 <> 0 THEN metrics + pipe END AS plan, floor((lag(fact) OVER w + lag(fact, 2) OVER w) / 2) AS prediction FROM (
 SELECT unit, region, seg, mi, sum(stock)::DOUBLE AS fact, sum(base)::DOUBLE AS metrics, sum(CASE WHEN base >= 2 THEN base ELSE 0 END)::DOUBLE AS orgs, sum(pipe)::DOUBLE AS pipe FROM gp GROUP BY 1, 2, 3, 4) WINDOW w AS (PARTITION BY unit, region, seg ORDER BY mi)""", "gp")
_V = ", ".join(fg.VARIANT)
_C = "base, out_term, in_term, pipe_term"
cte("gx", """SELECT m.unit, m.region, m.seg, m.mi, m.fact, m.plan, b.base, o.term AS out_term, i.term AS in_term, p.term AS pipe_term, greatest(CASE b.base WHEN 'orgs' THEN m.orgs ELSE m.metrics END - o.v + i.v + p.v, 0) AS pred
 FROM gm m JOIN gtout o USING (unit, region, seg, mi) JOIN gtin i USING (unit, region, seg, mi) JOIN gtpipe p USING (unit, region, seg, mi), (VALUES ('metrics'), ('orgs')) b(base)
 WHERE m.fact > 0 AND (o.term = 'none' OR NOT (i.term LIKE 'delta%' OR i.term LIKE 'ratio%')) AND (p.term = 'none' OR i.term IN ('none', 'rule_season'))""", "gm", "gtout", "gtin", "gtpipe")


def _factor(level: str) -> str:
    w = f"(PARTITION BY {_C}{level} ORDER BY mi RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"coalesce(CASE WHEN sum(sp) OVER {w} > 0 THEN least(greatest(sum(sa) OVER {w} / sum(sp) OVER {w}, 0.5), 2) END, 1)"


cte("gk", f"""WITH m AS (SELECT {_C}, mi, region, seg, sum(pred) AS sp, sum(fact) AS sa, sum(pred * pred) AS spp, sum(pred * fact) AS spa, count(*)::DOUBLE AS n FROM gx GROUP BY {_C}, mi, region, seg),
 s AS (SELECT {_C}, mi, region, seg, {_factor('')} AS k_global, {_factor(', region')} AS k_region, {_factor(', seg')} AS k_seg, sum(sp) OVER w AS p, sum(sa) OVER w AS a, sum(spp) OVER w AS pp, sum(spa) OVER w AS pa, sum(n) OVER w AS n
  FROM m WINDOW w AS (PARTITION BY {_C} ORDER BY mi RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT *, CASE WHEN n >= 10 AND n * pp - p * p > 1e-9 * n * pp THEN (n * pa - p * a) / (n * pp - p * p) END AS slope FROM s)
 SELECT {_C}, mi, region, seg, k_global, k_region, k_seg, slope, (a - slope * p) / n AS intercept FROM t""", "gx")
cte("ge", f"""WITH j AS (SELECT gx.*, k_global, k_region, k_seg, slope, intercept FROM gx JOIN gk USING ({_C}, mi, region, seg)),
 c AS ({' UNION ALL '.join(f"SELECT {_C}, mi, fact, plan, '{n}' AS calib, {e} - fact AS e FROM j" for n, e in (("none", "pred"), ("global", "pred * k_global"), ("region", "pred * k_region"), ("seg", "pred * k_seg"), ("affine", "coalesce(CASE WHEN slope IS NOT NULL THEN greatest(intercept + slope * pred, 0) END, pred)")))})
 SELECT {_V}, mi, sum(fact) AS y, sum(abs(e)) AS err, sum(e) AS sign, sum(CASE WHEN plan > 0 THEN abs(e) / plan * 100 END) AS exec, count(*) FILTER (WHERE plan > 0 AND round(abs(e) / plan * 100, 9) > 5) AS gt5, count(*) FILTER (WHERE plan > 0) AS n_plan FROM c GROUP BY {_V}, mi""", "gx", "gk")
cte("gs", f"""SELECT {_V}, sum(err) / sum(y) AS wape, sum(sign) / sum(y) AS bias, sum(exec) / nullif(sum(n_plan), 0) AS exec_pp, sum(gt5) / nullif(sum(n_plan), 0) AS share_gt5pp, max(err / y) AS wape_worst, stddev_pop(err / y) AS wape_std, count(*) AS months FROM ge GROUP BY {_V}""", "ge")


def _round(*cols: str) -> str:
    return ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in cols)


@query("forecast_rates_by_level", f"""SELECT seg, CAST(mi AS BIGINT) AS mi, {_round('rate_1', 'rate_3', 'rate_6', 'rate_all', 'growth')} FROM gsr JOIN (SELECT k AS seg, mi, growth FROM ggseg) USING (seg, mi)""", ("gsr", "ggseg"))
def _(i):
    p = Grid(i).panel
    return ft.window_rates(p, ["seg"], "outflow", "stock").join(ft.growth_rates(p, ["seg"]), ["seg", "mi"])


@query("growth_rates", "SELECT 'whole' AS level, NULL::BIGINT AS region, CAST(mi AS BIGINT) AS mi, round(growth, 4) + 0.0 AS growth FROM ggwhole UNION ALL SELECT 'region', CAST(k AS BIGINT), CAST(mi AS BIGINT), round(growth, 4) + 0.0 FROM ggregion", ("ggwhole", "ggregion"))
def _(i):
    p = Grid(i).panel
    whole = ft.growth_rates(p, []).select(F.lit("whole").alias("level"), F.lit(None).cast("bigint").alias("region"), "mi", "growth")
    return whole.unionByName(ft.growth_rates(p, ["region"]).select(F.lit("region").alias("level"), F.col("region").cast("bigint").alias("region"), "mi", "growth"))


@query("plan_realisation", "SELECT CAST(mi AS BIGINT) AS mi, round(realised, 4) AS realised FROM gpr", "gpr")
def _(i):
    return ft.plan_realisation(Grid(i).panel.select("mi", F.col("pipe").alias("plan"), F.col("won").alias("fact")))


def _family(name: str):
    @query(f"term_variants_{name}", f"SELECT CAST(unit AS BIGINT) AS unit, seg, CAST(mi AS BIGINT) AS mi, term, round(v, 6) + 0.0 AS value FROM gt{name}", f"gt{name}", digits=6)
    def _(i):
        names = F.array(*[F.lit(v.name) for v in ft.all_variants() if v.family == name])
        return Grid(i).rolled.select("unit", "seg", "mi", F.posexplode(f"{name}_terms").alias("at", "value")).select("unit", "seg", "mi", F.get(names, F.col("at")).alias("term"), F.round("value", 12).alias("value"))


for _f in ft.FAMILIES:
    _family(_f)


@query("calibration_factors", f"SELECT {_C}, CAST(mi AS BIGINT) AS mi, CAST(region AS BIGINT) AS region, seg, {_round('k_global', 'k_region', 'k_seg')}, round(slope, 3) + 0.0 AS slope FROM gk WHERE out_term = 'rule' AND in_term IN ('none', 'growth_seg')", "gk")
def _(i):
    g, v = Grid(i), ft.all_variants()
    name = lambda f, at: F.get(F.array(*[F.lit(x.name) for x in v if x.family == f]), F.col(at))
    k = fg.calibration_factors(g.cells, v, BASES).select("base", name("out", "o").alias("out_term"), name("in", "i").alias("in_term"), name("pipe", "p").alias("pipe_term"), "mi", "region", "seg",
                                                          "k_global", "k_region", "k_seg", F.round("slope", 3).alias("slope"))
    return k.where("out_term = 'rule' and in_term in ('none', 'growth_seg')")


@query("forecast_grid", f"SELECT {_V}, {_round('wape', 'bias', 'exec_pp', 'share_gt5pp', 'wape_worst', 'wape_std')}, months FROM gs", "gs")
def _(i):
    return fg.scores(Grid(i).errors)


@query("forecast_months", f"""SELECT {_V}, CAST(mi AS BIGINT) AS mi, round(err / y, 4) AS wape, round(sign / y, 4) + 0.0 AS bias, round(exec / nullif(n_plan, 0), 4) AS exec_pp FROM ge JOIN (SELECT {_V} FROM gs ORDER BY round(wape, 9), {_V} LIMIT 25) USING ({_V})""", ("ge", "gs"))
def _(i):
    e = Grid(i).errors
    return fg.month_detail(e, fg.leaders(e, 25))


@query("forecast_honest", f"""WITH x AS (SELECT *, sum(err) OVER w / sum(y) OVER w AS wape_past, err / y AS wape FROM ge WINDOW w AS (PARTITION BY {_V} ORDER BY mi RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT mi, min(wape) AS wape_best FROM x GROUP BY 1)
 SELECT CAST(mi AS BIGINT) AS mi, {_round('wape_past', 'wape', 'wape_best')} FROM x JOIN b USING (mi) WHERE wape_past IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mi ORDER BY round(wape_past, 9), {_V}) = 1""", "ge")
def _(i):
    return fg.honest_choice(Grid(i).errors).select("mi", "wape_past", "wape", "wape_best")


@query("forecast_without_terms", f"""WITH w AS (SELECT * FROM gs ORDER BY round(wape, 9), {_V} LIMIT 1), c AS (SELECT * FROM (VALUES ('winner', 0, 0, 0, 0), ('no outflow', 1, 0, 0, 0), ('no inflow', 0, 1, 0, 0), ('no pipeline', 0, 0, 1, 0), ('no calibration', 0, 0, 0, 1), ('base only', 1, 1, 1, 1)) v("case", o, i, p, k)),
 d AS (SELECT "case", base, CASE WHEN o = 1 THEN 'none' ELSE out_term END AS out_term, CASE WHEN i = 1 THEN 'none' ELSE in_term END AS in_term, CASE WHEN p = 1 THEN 'none' ELSE pipe_term END AS pipe_term, CASE WHEN k = 1 THEN 'none' ELSE calib END AS calib FROM w, c)
 SELECT "case", {_V}, {_round('wape', 'bias', 'exec_pp')} FROM d JOIN gs USING ({_V})""", "gs")
def _(i):
    return fg.without_terms(Grid(i).errors)


@query("forecast_best_outflow", "SELECT out_term, round(min(wape), 4) AS wape FROM gs GROUP BY 1", "gs")
def _(i):
    return fg.best_of_family(Grid(i).errors, "out_term").select("out_term", "wape")


@query("forecast_naive", f"""WITH l AS (SELECT *, min(mi) OVER (PARTITION BY unit, region, seg) AS lo, coalesce(lag(fact, 1) OVER w, 0) AS f1, coalesce(lag(fact, 2) OVER w, 0) AS f2, coalesce(lag(fact, 3) OVER w, 0) AS f3, coalesce(lag(fact, 4) OVER w, 0) AS f4 FROM gm WINDOW w AS (PARTITION BY unit, region, seg ORDER BY mi)),
 g AS (SELECT *, CASE WHEN f2 > 0 THEN (f1 - f2) / f2 ELSE 0 END AS g1, CASE WHEN f3 > 0 THEN (f2 - f3) / f3 ELSE 0 END AS g2, CASE WHEN f4 > 0 THEN (f3 - f4) / f4 ELSE 0 END AS g3 FROM l WHERE fact > 0 AND mi > (SELECT max(mi) FROM gf) - {MONTHS}),
 r AS (SELECT mi, fact, plan, 'last fact' AS name, f1 AS pred FROM g UNION ALL SELECT mi, fact, plan, 'plan', coalesce(plan, 0) FROM g UNION ALL SELECT mi, fact, plan, 'mart prediction', coalesce(prediction, 0) FROM g UNION ALL SELECT mi, fact, plan, 'sum of organisations', orgs FROM g
  UNION ALL SELECT mi, fact, plan, 'trend 2', greatest(f1 * (1 + (g1 + g2) / 2), 0) FROM g UNION ALL SELECT mi, fact, plan, 'trend 3', greatest(f1 * (1 + (g1 + g2 + g3) / 3), 0) FROM g),
 m AS (SELECT name, mi, sum(abs(pred - fact)) AS err, sum(pred - fact) AS sign, sum(fact) AS y, sum(CASE WHEN plan > 0 THEN abs(pred - fact) / plan * 100 END) AS exec, count(*) FILTER (WHERE plan > 0) AS n, sum(abs(pred)) AS size FROM r GROUP BY 1, 2)
 SELECT name, round(sum(err) / sum(y), 4) AS wape, round(sum(sign) / sum(y), 4) + 0.0 AS bias, round(sum(exec) / sum(n), 4) AS exec_pp, round(max(err / y), 4) AS wape_worst FROM m GROUP BY 1 HAVING sum(size) > 0""", ("gm", "gf"))
def _(i):
    g = Grid(i)
    return fg.naive_forecasts(g.mart, KEYS, g.first)
