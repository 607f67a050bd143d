"""Queries of the watch's cascade: organisations are suppliers' nations, cells are market segment, region and nation of buyers."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cascade as cs
from .registry import CTES, cte, query

MI = 73
#: Limits for a table of a few thousand persons; the operators' own are for millions.
LIMITS = dict(z=1.2, place_z=0.8, season_z=0.4, people=0.25, share=0.0, min_base=4, min_mean=1.0, cal_base=4, cal_share=0.0, under_base=1, under_z=0.0, under_share=0.2, rows_drop=0.97, noises=0.1)
SIDES = ("base", *cs.FLOWS, "temp_left", "single_pay", "raw_rows", "stopped")


def sides(p):
    """What a person's month adds to its organisation: in that month as one who is there, in the next as one who was.

    ``p``: person, mi, org, k, one row per person and month; neighbouring months come from a window of the person's few rows.
    A month with an unknown organisation counts as paid, but neither as staying with one nor as coming from one.
    """
    w, mi = W.partitionBy("person").orderBy("mi"), F.col("mi")
    p = p.where("person is not null and mi is not null").select("*", *[F.lag(c).over(w).alias(f"before_{c}") for c in ("mi", "org")], *[F.lead(c).over(w).alias(f"after_{c}") for c in ("mi", "org")], F.lead("mi", 2).over(w).alias("later_mi"))
    at = lambda c, m: F.coalesce(F.col(c) == m, F.lit(False))
    was, then = F.when(at("before_mi", mi - 1), F.col("before_org")), F.when(at("after_mi", mi + 1), F.col("after_org"))
    p = p.select("person", "mi", "org", "k", was.alias("was"), then.alias("then"), (at("after_mi", mi + 2) | at("later_mi", mi + 2)).alias("will"))
    other = lambda c: F.coalesce(F.col("org") != F.col(c), F.lit(False))
    p = p.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("late"))
    old, new = F.col("late") == 1, F.col("late") == 0
    one = lambda c: c.cast("int")
    return p.select("person", "org", (mi + F.col("late")).alias("mi"), one(old).alias("base"), one(new & F.col("was").isNull()).alias("in_new"), one(new & other("was")).alias("in_other"),
                    one(old & F.col("then").isNull()).alias("out_left"), one(old & other("then")).alias("out_other"), one(old & F.col("then").isNull() & F.col("will")).alias("temp_left"),
                    one(new & (F.col("k") == 1)).alias("single_pay"), F.when(new, F.col("k")).otherwise(0).alias("raw_rows"), one(new).alias("here"))


class Panels:
    def __init__(self, i):
        self.i = i

    @cached_property
    def cells(self):
        """Flows of all organisations by cell and month: a person's organisation of the month is the one with most lines."""
        def build():
            i = self.i
            sup = i.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("org"))
            day = F.to_date("l_shipdate")
            li = i.table("lineitem").select("l_orderkey", "l_suppkey", ((F.year(day) - 1995) * 12 + F.month(day) - 1).cast("int").alias("mi"))
            od = i.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person")).hint("shuffle_hash")
            # one shuffle by person serves both groupings, the window and the join with the person's cell
            k = li.join(od, "l_orderkey").join(sup, "l_suppkey").select("person", "mi", "org").repartition("person").groupBy("person", "mi", "org").agg(F.count(F.lit(1)).alias("k"))
            p = k.groupBy("person", "mi").agg(F.max_by("org", F.struct("k", -F.col("org"))).alias("org"), F.sum("k").alias("k"))
            nation = i.table("nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
            cell = i.table("customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("unit")).join(nation, "unit")
            x = sides(p).join(cell.hint("shuffle_hash"), "person").where("org is not null and mi between 1 and 82")
            g = x.groupBy("org", *cs.CELL, "mi").agg(*[F.sum(n).alias(n) for n in ("base", *cs.FLOWS, "temp_left", "single_pay", "raw_rows", "here")])
            return g.withColumn("stopped", F.when(F.col("here") == 0, F.col("out_left")).otherwise(0)).drop("here")
        return self.i.staged("watch_cells", build)

    @cached_property
    def cascade(self):
        tracked = self.cells.groupBy("org").agg(F.sum("base").alias("n"))
        mean = tracked.agg(F.avg("n")).scalar()
        tracked = tracked.where(F.col("n") >= mean).select("org")
        orgs = self.i.table("nation").select(F.col("n_nationkey").alias("org"), F.concat(F.lit("n"), (F.col("n_nationkey") % 2).cast("string")).alias("grp"), F.col("n_regionkey").alias("region"))
        atoms = self.cells.groupBy(*cs.CELL, "mi").agg(*[F.sum(c).alias(c) for c in SIDES])
        keep = lambda name, build: self.i.staged(f"watch_cascade/{name}", build)
        return cs.Cascade(atoms, self.cells.join(tracked, "org", "left_semi"), orgs, MI, **LIMITS, keep=keep)


cte("cpm", """WITH k AS (SELECT o_custkey AS person, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS mi, s_nationkey AS org, count(*) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)
 SELECT person, mi, arg_min(org, n) AS org, sum(k) AS k FROM (SELECT *, row_number() OVER (PARTITION BY person, mi ORDER BY k DESC, org) AS n FROM k) GROUP BY 1, 2""")
cte("ccell", """WITH j AS (SELECT coalesce(a.person, b.person) AS person, coalesce(a.mi, b.mi + 1) AS mi, a.org, b.org AS was, a.k FROM cpm a FULL JOIN cpm b ON b.person = a.person AND b.mi + 1 = a.mi),
 x AS (SELECT j.*, c_mktsegment AS seg, n_regionkey AS region, c_nationkey AS unit, EXISTS (SELECT 1 FROM cpm n WHERE n.person = j.person AND n.mi = j.mi + 1) AS will FROM j JOIN customer ON c_custkey = person JOIN nation ON n_nationkey = c_nationkey WHERE mi BETWEEN 1 AND 82),
 s AS (SELECT was AS org, seg, region, unit, mi, 1 AS base, 0 AS in_new, 0 AS in_other, CAST(org IS NULL AS INT) AS out_left, CAST(coalesce(org <> was, false) AS INT) AS out_other, CAST(org IS NULL AND will AS INT) AS temp_left, 0 AS single_pay, 0 AS raw_rows, 0 AS here FROM x WHERE was IS NOT NULL
  UNION ALL SELECT org, seg, region, unit, mi, 0, CAST(was IS NULL AS INT), CAST(coalesce(org <> was, false) AS INT), 0, 0, 0, CAST(k = 1 AS INT), k, 1 FROM x WHERE org IS NOT NULL)
 SELECT org, seg, region, unit, mi, sum(base) AS base, sum(in_new) AS in_new, sum(in_other) AS in_other, sum(out_left) AS out_left, sum(out_other) AS out_other, sum(temp_left) AS temp_left, sum(single_pay) AS single_pay, sum(raw_rows) AS raw_rows, CASE WHEN sum(here) = 0 THEN sum(out_left) ELSE 0 END AS stopped FROM s GROUP BY 1, 2, 3, 4, 5""", "cpm")
cte("ctrack", "WITH t AS (SELECT org, sum(base) AS n FROM ccell GROUP BY 1) SELECT * FROM ccell WHERE org IN (SELECT org FROM t WHERE n >= (SELECT avg(n) FROM t))", "ccell")
cte("catom", "SELECT seg || '/' || region || '/' || unit AS key, seg AS grp, seg, region, unit, mi, " + ", ".join(f"sum({c}) AS {c}" for c in SIDES) + " FROM ccell GROUP BY 1, 2, 3, 4, 5, 6", "ccell")
# the calendar's verdict on this panel
_needs, _body = CTES["wcal"]
cte("ccal", _body.replace("wpan", "catom"), "catom")
_ADJ = "CASE WHEN common IS NOT NULL THEN least(temp_left, common * base) ELSE 0 END"
cte("catoms", f"SELECT p.* REPLACE (out_left - {_ADJ} AS out_left) FROM catom p LEFT JOIN ccal USING (mi)", "catom", "ccal")
cte("crest", f"""WITH o AS (SELECT seg, region, unit, mi, {', '.join(f'sum({c}) AS {c}' for c in ('base', *cs.FLOWS, 'temp_left'))} FROM ctrack GROUP BY 1, 2, 3, 4),
 r AS (SELECT a.* REPLACE ({', '.join(f'greatest(a.{c} - coalesce(o.{c}, 0), 0) AS {c}' for c in ('base', *cs.FLOWS, 'temp_left'))}) FROM catom a LEFT JOIN o USING (seg, region, unit, mi))
 SELECT p.* REPLACE (out_left - {_ADJ} AS out_left) FROM r p LEFT JOIN ccal USING (mi)""", "catom", "ctrack", "ccal")
cte("corg", f"""WITH r AS (SELECT org, mi, {', '.join(f'sum({c}) AS {c}' for c in ('base', *cs.FLOWS, 'temp_left', 'stopped'))} FROM ctrack GROUP BY 1, 2)
 SELECT CAST(org AS VARCHAR) AS key, 'n' || (org % 2) AS grp, n_regionkey AS region, p.* REPLACE (out_left - {_ADJ} AS out_left) FROM r p JOIN nation ON n_nationkey = org LEFT JOIN ccal USING (mi)""", "ctrack", "ccal")
Z = LIMITS["z"]
for _p, _panel in (("o", "corg"), ("r", "crest"), ("a", "catoms")):
    for _f in cs.FLOWS:
        for _n in ("wexp", "woff", "wlog"):
            _needs, _body = CTES[_n]
            _body = re.sub(r"\b(wexp|woff)\b", rf"\1_{_p}_{_f}", re.sub(r"\bwpan\b", _panel, _body.replace("out_left", _f)))
            cte(f"{_n}_{_p}_{_f}", _body, *[_panel if _x == "wpan" else f"{_x}_{_p}_{_f}" for _x in _needs])
    cte(f"cscan_{_p}", " UNION ALL ".join(f"""SELECT '{f}' AS flow, key, mi, base, {f} AS obs, mean AS expected, (ln(1 + {f}) - center) / sigma AS z, {f} - mean AS d,
      greatest({f} - greatest(exp(center + {Z} * sigma) - 1, mean), least(greatest(exp(center - {Z} * sigma) - 1, 0), mean) - {f}) AS score,
      greatest(greatest(exp(center + {Z} * sigma) - 1, mean) - mean, mean - least(greatest(exp(center - {Z} * sigma) - 1, 0), mean)) / {Z} AS sd FROM wlog_{_p}_{f} WHERE ok""" for f in cs.FLOWS), *[f"wlog_{_p}_{f}" for f in cs.FLOWS])
    cte(f"cbest_{_p}", f"SELECT * FROM cscan_{_p} WHERE mi = {MI} AND score >= 0.25 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, flow DESC) = 1", f"cscan_{_p}")
# moves between units: pairs of overlapping intervals
cte("cdev", f"""WITH h AS (SELECT org, seg, region, unit, in_other AS i, out_other AS o FROM ctrack WHERE mi BETWEEN {MI - 12} AND {MI - 1}), m AS (SELECT org, seg, region, unit, median(i) AS mi_, median(o) AS mo FROM h GROUP BY 1, 2, 3, 4),
 d AS (SELECT org, seg, region, unit, 1.4826 * median(abs(i - mi_)) AS si, 1.4826 * median(abs(o - mo)) AS so FROM h JOIN m USING (org, seg, region, unit) GROUP BY 1, 2, 3, 4),
 x AS (SELECT c.org, c.seg, c.region, c.unit, in_other - coalesce(mi_, 0) AS di, out_other - coalesce(mo, 0) AS do_, greatest(coalesce(si, 0), sqrt(coalesce(mi_, 0) + 1)) AS ni, greatest(coalesce(so, 0), sqrt(coalesce(mo, 0) + 1)) AS no
  FROM ctrack c LEFT JOIN m USING (org, seg, region, unit) LEFT JOIN d USING (org, seg, region, unit) WHERE c.mi = {MI})
 SELECT *, do_ - di AS net, {LIMITS['noises']} * sqrt(ni * ni + no * no) AS u FROM x""", "ctrack")


def moves_sql(dev: str, people: float, matched: float) -> str:
    return f"""WITH a AS (SELECT * FROM {dev} WHERE abs(net) >= {people} + u), t AS (SELECT org, seg, region, sum(greatest(net, 0)) AS l, sum(greatest(-net, 0)) AS g FROM a GROUP BY 1, 2, 3),
 c AS (SELECT a.*, net > 0 AS lost, sum(abs(net)) OVER (PARTITION BY org, seg, region, net > 0 ORDER BY abs(net) DESC, unit) AS hi, abs(net) AS n FROM a JOIN t USING (org, seg, region) WHERE least(l, g) > 0 AND least(l, g) >= {matched} * greatest(l, g)),
 p AS (SELECT s.org, s.seg, s.region, s.unit AS su, g.unit AS gu, s.u AS s_u, g.u AS g_u, least(s.hi, g.hi) - greatest(s.hi - s.n, g.hi - g.n) AS n FROM c s JOIN c g ON g.org = s.org AND g.seg = s.seg AND g.region = s.region AND s.lost AND NOT g.lost WHERE least(s.hi, g.hi) - greatest(s.hi - s.n, g.hi - g.n) > 0),
 q AS (SELECT org, seg, region, su AS unit, 'out_other' AS flow, sum(n) AS matched, sum(g_u) AS more FROM p GROUP BY 1, 2, 3, 4 UNION ALL SELECT org, seg, region, gu, 'in_other', sum(n), sum(s_u) FROM p GROUP BY 1, 2, 3, 4),
 e AS (SELECT q.org, q.seg, q.region, q.unit, flow, matched, least(greatest(CASE WHEN flow = 'out_other' THEN do_ ELSE di END, 0), matched + more) AS explained FROM q JOIN {dev} d ON d.org = q.org AND d.seg = q.seg AND d.region = q.region AND d.unit = q.unit)
 SELECT * FROM e WHERE org IN (SELECT org FROM e WHERE flow = 'out_other' GROUP BY org HAVING sum(explained) >= {people})"""


cte("cmove", moves_sql("cdev", LIMITS["people"], 0.6), "cdev")
cte("cscope", f"""SELECT org, {', '.join(f"CASE WHEN min({c}) FILTER (mi = {m}) = max({c}) FILTER (mi = {m}) THEN min({c}) FILTER (mi = {m}) END AS {n}{c}" for m, n in ((MI, ''), (MI - 1, 'was_')) for c in cs.CELL)},
 coalesce(sum(temp_left) FILTER (mi = {MI - 1}), 0) > 0 AS returns FROM ctrack WHERE mi IN ({MI - 1}, {MI}) GROUP BY 1""", "ctrack")
cte("cunder", f"""WITH z AS (SELECT region, avg(CASE WHEN z >= {LIMITS['under_z']} THEN 1 ELSE 0 END) AS s, count(*) AS n FROM cscan_a JOIN (SELECT DISTINCT key, region FROM catom) USING (key) WHERE flow = 'out_left' AND mi = {MI} AND base >= {LIMITS['under_base']} GROUP BY 1),
 r AS (SELECT region, sum(raw_rows) FILTER (mi = {MI - 1}) AS p, sum(raw_rows) FILTER (mi = {MI}) AS c FROM catom GROUP BY 1) SELECT region FROM z JOIN r USING (region) WHERE n >= 3 AND s >= {LIMITS['under_share']} AND c < {LIMITS['rows_drop']} * p""", "cscan_a", "catom")
_WAS = ", ".join(f"was_{c}" for c in cs.CELL)
cte("clorg", f"""WITH m AS (SELECT CAST(org AS VARCHAR) AS key, flow, sum(explained) AS moved FROM cmove GROUP BY 1, 2), s AS (SELECT CAST(org AS VARCHAR) AS key, sum(stopped) AS stopped FROM ctrack WHERE mi = {MI} GROUP BY 1)
 SELECT 'org' AS level, b.key, b.flow, base, obs, expected, d, score, 0.25 AS floor, CASE WHEN b.flow IN ('in_other', 'out_other') AND d > 0 AND coalesce(moved, 0) >= 0.7 * d AND score - coalesce(moved, 0) < 0.25 THEN 'recode' WHEN b.flow = 'out_left' AND d > 0 AND coalesce(stopped, 0) >= 0.5 * d THEN 'stop'
   WHEN b.flow = 'out_left' AND region IN (SELECT region FROM cunder) THEN 'underload' END AS label, seg, region, unit, {_WAS}, returns
 FROM cbest_o b LEFT JOIN s USING (key) LEFT JOIN m ON m.key = b.key AND m.flow = b.flow LEFT JOIN cscope c ON CAST(c.org AS VARCHAR) = b.key""", "cbest_o", "cmove", "ctrack", "cscope", "cunder")
_CELLS = f"(SELECT key, seg, region, unit, base AS whole FROM catom WHERE mi = {MI})"
_UNDER = "CASE WHEN flow = 'out_left' AND region IN (SELECT region FROM cunder) THEN 'underload' END"
_HERE = "seg AS was_seg, region AS was_region, unit AS was_unit, false AS returns"
cte("clrest", f"SELECT 'rest' AS level, key, flow, whole AS base, obs, expected, d, score, 0.25 AS floor, {_UNDER} AS label, seg, region, unit, {_HERE} FROM cbest_r JOIN {_CELLS} USING (key)", "cbest_r", "catom", "cunder")
cte("clow", "SELECT * FROM clorg WHERE label IS DISTINCT FROM 'recode' UNION ALL SELECT * FROM clrest", "clorg", "clrest")


def cover_sql(parents: str, level: str, cards: str, share: float = cs.COVER_SHARE) -> str:
    """Amounts of ``cards`` and of moves inside each parent, by joins on its scope columns."""
    place = cs.PLACES[level]
    on = "".join(f" AND c.{c} = p.{c}" for c in place)
    was = "".join(f" AND c.was_{c} = p.{c}" for c in place) or " AND true"
    kinds = ", ".join(f"'{k}'" for k in cs.INSIDE[level])
    return f"""WITH c AS (SELECT level AS kind, key AS child, flow, d, seg, region, unit, {_WAS}, returns FROM {cards} WHERE level IN ({kinds}) UNION ALL SELECT 'org', CAST(org AS VARCHAR), flow, t.d, seg, region, unit, {_WAS}, returns FROM (SELECT org, flow, sum(explained) AS d FROM cmove GROUP BY 1, 2) t JOIN cscope USING (org)),
 f AS (SELECT p.key, p.flow, c.kind, c.child, abs(c.d) AS d FROM {parents} p JOIN c ON c.flow = p.flow AND sign(c.d) = sign(p.d){on} WHERE c.d <> 0 AND (c.kind <> 'org' OR c.flow <> 'in_new' OR NOT c.returns OR (true{was}))
  UNION ALL SELECT p.key, p.flow, 'org', CAST(c.org AS VARCHAR), sum(c.explained) FROM {parents} p JOIN cmove c ON c.flow = p.flow{on} WHERE p.d > 0 AND c.explained > 0 GROUP BY 1, 2, 4),
 k AS (SELECT key, flow, kind, child, max(d) AS d FROM f GROUP BY 1, 2, 3, 4), g AS (SELECT key, flow, CASE WHEN kind IN ('org', 'rest') THEN 'x' ELSE kind END AS kind, sum(d) AS d FROM k GROUP BY 1, 2, 3), m AS (SELECT key, flow, max(d) AS amount FROM g GROUP BY 1, 2)
 SELECT p.*, coalesce(amount, 0) AS amount, coalesce(amount, 0) >= {share} * abs(d) AND score - coalesce(amount, 0) < floor AS covered FROM {parents} p LEFT JOIN m USING (key, flow)"""


cte("catomp", f"SELECT 'atom' AS level, key, flow, base, obs, expected, d, score, 0.25 AS floor, {_UNDER} AS label, seg, region, unit, {_HERE} FROM cbest_a JOIN {_CELLS} USING (key)", "cbest_a", "catom", "cunder")
cte("catomc", cover_sql("catomp", "atom", "clow"), "catomp", "clow", "cmove", "cscope")
cte("clatom", "SELECT * EXCLUDE (amount, covered) FROM catomc WHERE NOT covered", "catomc")
_LOWER = {"unit": "SELECT * FROM clow UNION ALL SELECT * FROM clatom", "region": "SELECT * FROM clow UNION ALL SELECT * FROM clatom UNION ALL SELECT * FROM clunit"}
for _l in ("unit", "region"):
    _rest = [c for c in cs.CELL if c != _l]
    cte(f"cp{_l}", f"""WITH m AS (SELECT {_l}, flow, mi, sum(d) AS d, sum(s.base) AS base, sum(obs) AS obs, sum(expected) AS expected, sqrt(sum(sd * sd)) AS sd FROM cscan_a s JOIN (SELECT key AS k, mi AS m, {_l} FROM catom) ON k = key AND m = mi WHERE mi BETWEEN {MI - 12} AND {MI} GROUP BY 1, 2, 3),
 h AS (SELECT {_l}, flow, median(d) AS md FROM m WHERE mi < {MI} GROUP BY 1, 2), n AS (SELECT {_l}, flow, 1.4826 * median(abs(d - md)) AS own FROM m JOIN h USING ({_l}, flow) WHERE mi < {MI} GROUP BY 1, 2)
 SELECT '{_l}' AS level, CAST({_l} AS VARCHAR) AS key, {_l}, flow, base, obs, expected, d, abs(d) - {LIMITS['place_z']} * greatest(sd, coalesce(own, 0)) AS score, 0.25 AS floor FROM m LEFT JOIN n USING ({_l}, flow) WHERE mi = {MI}""", "cscan_a", "catom")
    cte(f"cs{_l}", f"SELECT * FROM cp{_l} WHERE score >= floor", f"cp{_l}")
    cte(f"clo{_l}", _LOWER[_l], "clow", "clatom", *["clunit"] * (_l == "region"))
    cte(f"cc{_l}", cover_sql(f"cs{_l}", _l, f"clo{_l}"), f"cs{_l}", f"clo{_l}", "cmove", "cscope")
    cte(f"cl{_l}", f"""WITH w AS (SELECT {_l}, {', '.join(f'CASE WHEN min({c}) = max({c}) THEN min({c}) END AS {c}' for c in _rest)} FROM catom WHERE mi = {MI} GROUP BY 1)
 SELECT level, key, flow, base, obs, expected, d, score, floor, {_UNDER} AS label, seg, region, unit, {_HERE} FROM cc{_l} JOIN w USING ({_l}) WHERE NOT covered""", f"cc{_l}", "catom", "cunder")
_SEASON = """SELECT {names}, '{f}' AS flow, base, obs, ex AS expected, obs - ex AS d, abs(obs - ex) - {zs} * s AS score, {people} AS floor FROM (WITH t AS (SELECT {by}, mi, sum(base) AS base, sum({f}) AS obs, sum({f}) / greatest(sum(base), 1) AS rate FROM catoms GROUP BY 1, 2),
  p AS (SELECT a.*, CASE WHEN a.mi >= 16 THEN y.rate * CASE WHEN ago > 0 THEN now / ago ELSE 1 END END AS pred FROM (SELECT *, avg(rate) OVER (PARTITION BY seg ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS now,
   avg(rate) OVER (PARTITION BY seg ORDER BY mi RANGE BETWEEN 15 PRECEDING AND 13 PRECEDING) AS ago FROM t) a LEFT JOIN t y ON y.seg = a.seg AND y.mi = a.mi - 12),
  e AS (SELECT seg, rate - pred AS e FROM p WHERE mi < {mi} AND pred IS NOT NULL), m AS (SELECT seg, median(e) AS m FROM e GROUP BY 1), d AS (SELECT e.seg, median(abs(e - m)) AS mad FROM e JOIN m USING (seg) GROUP BY 1)
  SELECT p.seg, base, obs, pred * base AS ex, greatest(1.4826 * mad * base, sqrt(greatest(pred * base, 1))) AS s FROM p JOIN d USING (seg) WHERE mi = {mi}) WHERE abs(obs - ex) - {zs} * s >= {people}"""
for _l, _by, _names in (("seg", "seg", "'seg' AS level, seg AS key, seg"), ("whole", "'whole' AS seg", "'whole' AS level, 'whole' AS key, NULL::VARCHAR AS seg")):
    cte(f"cs{_l}", " UNION ALL ".join(_SEASON.format(names=_names, by=_by, f=f, mi=MI, zs=LIMITS["season_z"], people=LIMITS["people"]) for f in cs.FLOWS), "catoms")
    cte(f"cc{_l}", cover_sql(f"cs{_l}", _l, "(SELECT * FROM clorg WHERE false)"), f"cs{_l}", "clorg", "cmove", "cscope")
cte("cltemp", f"""WITH l AS (SELECT seg, sum(d) AS late FROM cscan_a JOIN {_CELLS} USING (key) WHERE mi = {MI} AND flow = 'out_left' AND region IN (SELECT region FROM cunder) GROUP BY 1)
 SELECT level, key, flow, base, obs, expected, d, score, CASE WHEN covered THEN 'recode' WHEN flow = 'out_left' AND late >= 0.5 * abs(d) THEN 'underload' END AS label FROM (SELECT c.*, late FROM ccseg c LEFT JOIN l USING (seg) UNION ALL SELECT c.*, (SELECT sum(late) FROM l) FROM ccwhole c)""", "ccseg", "ccwhole", "cscan_a", "catom", "cunder")
_D = lambda *cols: ", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0.0 AS {c}" for c in cols)
_CARD = f"SELECT level, key, flow, {_D('base', 'obs', 'expected')}, round(CASE WHEN flow LIKE 'out%' THEN -d ELSE d END, 4) + 0.0 AS delta, {_D('score')}, label FROM "


def shown(c, x):
    return c.as_cards(x).withColumns({n: F.col(n).cast("double") for n in ("base", "obs", "expected", "delta", "score")})


for _name, _table in (("org", "clorg"), ("rest", "clrest"), ("atom", "clatom"), ("unit", "clunit"), ("region", "clregion"), ("temporal", "cltemp")):
    def _level(i, name=_name):
        c = Panels(i).cascade
        return shown(c, getattr(c, f"{name}_level"))
    query(f"watch_{_name}_level", _CARD + _table, _table)(_level)


@query("watch_cascade", " UNION ALL ".join(_CARD + t for t in ("clorg", "clrest", "clatom", "clunit", "clregion", "cltemp")) + " UNION ALL SELECT 'region', CAST(region AS VARCHAR), 'out_left', NULL, NULL, NULL, 0.0::DOUBLE, 0.0::DOUBLE, 'underload' FROM cunder", ("clorg", "clrest", "clatom", "clunit", "clregion", "cltemp", "cunder"))
def _(i):
    return Panels(i).cascade.cards()


_MOVE = "SELECT CAST(org AS BIGINT) AS org, seg, CAST(region AS BIGINT) AS region, CAST(unit AS BIGINT) AS unit, flow, " + _D("matched", "explained") + " FROM "


@query("unit_moves_by_cell", _MOVE + "cmove", "cmove")
def _(i):
    return Panels(i).cascade.moves


@query("place_cover", "SELECT level, key, flow, " + _D("d", "score", "amount") + ", covered FROM (" + " UNION ALL ".join(f"SELECT level, key, flow, d, score, amount, covered FROM cc{_l}" for _l in ("unit", "region")) + " UNION ALL SELECT level, key, flow, d, score, amount, covered FROM catomc)", ("ccunit", "ccregion", "catomc"))
def _(i):
    c = Panels(i).cascade
    low = c.low_cards.unionByName(c.atom_level)
    signals = [c.atom_signals, c.place_signals("unit", low), c.place_signals("region", low.unionByName(c.unit_level))]
    return signals[0].select("level", "key", "flow", "d", "score", "amount", "covered").union(signals[1].select("level", "key", "flow", "d", "score", "amount", "covered")).union(signals[2].select("level", "key", "flow", "d", "score", "amount", "covered"))
