"""Queries of the deviation feed, the calendar shift and the business review, read from the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import business as bu
from ..operators import calendar as ca
from ..operators import feed as fd
from ..operators import summary as sm
from .registry import cte, query

EDGES, HOLD_MIN, ORG_MIN = (60, 45, 30), 60, 60
FLOATY = ("pf_fl", "m_fl_in", "m_fl_out", "m_in_conc", "m_out_conc", "y_fl_in", "y_fl_out", "y_in_conc", "y_out_conc")

# ------------------------------------------------------------- SQL twins
cte("sseg", """SELECT mi, org, arg_min(seg_rep, k) AS seg_rep FROM (SELECT *, row_number() OVER (PARTITION BY mi, org ORDER BY r, pf DESC, seg_rep) AS k FROM (
  SELECT mi, org, seg_rep, min(CASE WHEN seg_src IN ('history', 'org history') THEN 0 ELSE 1 END) AS r, sum(pf_recip) AS pf FROM summ GROUP BY 1, 2, 3)) GROUP BY 1, 2""", "summ")
_ACT = "(coalesce(s.pf_recip, 0) > 0 OR coalesce(s.m_base_pf, 0) > 0)"
cte("coll", f"""WITH om AS (SELECT org, max(pf) AS pm FROM (SELECT mi, org, sum(pf_recip) AS pf FROM summ GROUP BY 1, 2) GROUP BY 1),
 hs AS (SELECT hold FROM om JOIN orgs USING (org) WHERE hold IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND sum(pm) >= {HOLD_MIN})
 SELECT s.mi, coalesce(g.seg_rep, '(none)') AS seg_rep, coalesce(o.seg, '(not in dimension)') AS seg_cur, s.region, s.unit, coalesce(o.industry, '(not given)') AS industry,
  CASE WHEN hs.hold IS NOT NULL THEN 'holding ' || md5(hs.hold) END AS hold_code,
  CASE WHEN pm >= 60 THEN '1) 60+' WHEN pm >= 45 THEN '2) 45+' WHEN pm >= 30 THEN '3) 30+' ELSE '4) under 30' END AS size,
  CASE WHEN pm >= {ORG_MIN} THEN 'org ' || md5(s.org) END AS org_code,
  {', '.join(f'sum(s.{m}) AS {m}, count(*) FILTER (WHERE s.{m} IS NULL AND {_ACT}) AS nn_{m}' for m in fd.MEASURES)}
 FROM summ s LEFT JOIN om ON om.org = s.org LEFT JOIN orgs o ON o.org = s.org LEFT JOIN hs ON hs.hold = o.hold LEFT JOIN sseg g ON g.mi = s.mi AND g.org = s.org GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""", "summ", "orgs", "sseg")


def _slice(name, parts):
    key = " || ' / ' || ".join("'bank'" if p == "k_bank" else f"CAST({p} AS VARCHAR)" for p in parts)
    meas = ", ".join((f"sum({m})" if m in FLOATY else f"CAST(sum({m}) AS BIGINT)") + f" AS {m}, CAST(sum(nn_{m}) AS BIGINT) AS nn_{m}" for m in fd.MEASURES)
    return f"SELECT '{name}' AS slice_type, {key} AS slice_key, mi, {meas} FROM coll WHERE {key} IS NOT NULL GROUP BY 1, 2, 3"


cte("sl", " UNION ALL ".join(_slice(n, p) for n, p in fd.SLICES), "coll")
cte("kn", "SELECT slice_type, slice_key, mi, " + ", ".join(f"CASE WHEN nn_{m} = 0 THEN CAST({m} AS DOUBLE) END AS {m}" for m in fd.MEASURES) + " FROM sl", "sl")
cte("cmpn", """WITH x AS (SELECT a.*, b.pf_recip AS prev, b.pf_fl AS prev_fl, a.m_out_temp_left IS NOT NULL AS t FROM kn a LEFT JOIN kn b ON b.slice_type = a.slice_type AND b.slice_key = a.slice_key AND b.mi = a.mi - 1),
 y AS (SELECT slice_type, slice_key, mi, pf_recip, m_base_pf IS NOT NULL AND prev IS NOT NULL AS ok, t,
  -(m_out_left_bank - m_out_temp_left) AS "left", m_in_from_outside - m_in_temp_outside AS came, m_in_from_other_org - m_out_to_other_org AS moves, CASE WHEN t THEN -m_out_temp_left ELSE 0 END AS temp_out,
  m_in_temp_outside AS temp_back, m_base_pf - prev AS reclass, m_in_from_nonzp - m_out_to_nonzp AS codes, m_in_from_zp_out - m_out_zp_out AS threshold, CASE WHEN t THEN 0 ELSE -m_out_left_bank END AS left_unk,
  pf_recip - prev AS reported, pf_fl - prev_fl AS people, -m_fl_out AS p_out, -(m_out_person_gone - m_fl_out) AS p_out_extra, m_fl_in AS p_in, m_in_person_new - m_fl_in AS p_in_extra,
  m_in_conc - m_out_conc AS p_conc, (pf_recip - prev - (m_in_person_new - m_out_person_gone)) - (m_in_conc - m_out_conc) AS p_move FROM x)
 SELECT slice_type, slice_key, mi, pf_recip, """ + ", ".join(f"CASE WHEN ok THEN CAST({e} AS DOUBLE) END AS {n}" for n, e in [
    ('"left"', 'CASE WHEN t THEN "left" END'), *[(c, c) for c in ("came", "moves", "temp_out", "temp_back", "reclass", "codes", "threshold", "left_unk")],
    ("gap", 'reported - (CASE WHEN t THEN "left" ELSE 0 END + came + moves + temp_out + temp_back + reclass + codes + threshold + left_unk)'), ("reported", "reported"), ("people", "people"), *[(p, p) for p in fd.PERSON_PARTS]]) + " FROM y", "kn")
_Q = lambda k: '"left"' if k == "left" else k
_CC = (*fd.GROUPS, "reported")


def _compare_sql(cols) -> str:
    out = []
    for n in fd.WINDOWS:
        w = ", ".join(f"(SELECT CASE WHEN count({_Q(k)}) = {n} THEN sum({_Q(k)}) END FROM cmpn c WHERE c.slice_type = a.slice_type AND c.slice_key = a.slice_key AND c.mi BETWEEN a.mi - {n - 1} AND a.mi) AS w_{k}" for k in cols)
        out.append(f"SELECT slice_type, slice_key, mi, {n} AS length, {w}, (SELECT pf_recip FROM cmpn c WHERE c.slice_type = a.slice_type AND c.slice_key = a.slice_key AND c.mi = a.mi - {n}) AS level_before FROM cmpn a")
    return " UNION ALL ".join(out)


cte("win", _compare_sql(_CC), "cmpn")


def _bases(cols) -> str:
    parts = []
    for b in fd.BASES:
        e = {"none": "CASE WHEN a.w_{k} IS NOT NULL THEN 0.0 END", "y1": "y.w_{k}", "y2": "z.w_{k}", "avg": "(y.w_{k} + z.w_{k}) / 2"}[b]
        parts.append(f"SELECT a.*, '{b}' AS base, y.w_reported IS NOT NULL AS has_y1, " + ", ".join(f"{e.format(k=k)} AS b_{k}, a.w_{k} - {e.format(k=k)} AS d_{k}" for k in cols)
                     + " FROM win a LEFT JOIN win y ON y.slice_type = a.slice_type AND y.slice_key = a.slice_key AND y.length = a.length AND y.mi = a.mi - 12"
                       " LEFT JOIN win z ON z.slice_type = a.slice_type AND z.slice_key = a.slice_key AND z.length = a.length AND z.mi = a.mi - 24")
    return " UNION ALL ".join(parts)


cte("cmpr", _bases(_CC), "win")
_GR = sorted(set(fd.GROUPS.values()))
SCAN = {"z_min": 1.5, "min_history": 6, "mat_abs": 3.0, "mat_rel": 0.002}
cte("scan", f"""WITH g AS (SELECT *, {', '.join('(' + ' + '.join(f'd_{k}' for k, gg in fd.GROUPS.items() if gg == n) + f') AS g_{n}' for n in _GR)}, greatest(3.0, 0.002 * coalesce(level_before, 0)) AS floor FROM cmpr),
 m AS (SELECT slice_type, slice_key, length, base, median(d_reported) AS m1, median(g_real) AS m2, count(d_reported) AS n1, count(g_real) AS n2 FROM g GROUP BY 1, 2, 3, 4),
 s AS (SELECT g.slice_type, g.slice_key, g.length, g.base, median(abs(d_reported - m1)) * 1.4826 AS s1, median(abs(g_real - m2)) * 1.4826 AS s2, any_value(n1) AS n1, any_value(n2) AS n2 FROM g JOIN m USING (slice_type, slice_key, length, base) GROUP BY 1, 2, 3, 4),
 z AS (SELECT g.*, CASE WHEN n1 >= 6 THEN d_reported / greatest(s1, floor) END AS z, CASE WHEN n2 >= 6 THEN g_real / greatest(s2, floor) END AS z_real FROM g JOIN s USING (slice_type, slice_key, length, base)),
 q AS (SELECT *, coalesce(abs(z) >= 1.5 AND abs(d_reported) >= floor, false) AS sig, coalesce(abs(z_real) >= 1.5 AND abs(g_real) >= floor, false) AS sig_r FROM z)
 SELECT * FROM q WHERE mi IN (26, 27, 28, 29) AND d_reported IS NOT NULL AND {' AND '.join(f'g_{n} IS NOT NULL' for n in _GR if n != 'real')} AND (base <> 'none' OR length = 12 OR NOT has_y1) AND (sig OR sig_r)""", "cmpr")
_RN = lambda cols: ", ".join(f"round({_Q(c)}, 4) + 0.0 AS {_Q(c)}" for c in cols)


def collapsed(i):
    return fd.collapse_summary(i.summary, i.orgs, HOLD_MIN, ORG_MIN, EDGES)


def series(i):
    """The slice table every feed report reads; written once, as its plan is long."""
    return i.staged("feed_series", lambda: fd.slice_series(collapsed(i)))


def comps(i):
    return i.staged("feed_components", lambda: fd.components(series(i)))


@query("summary_segment", "SELECT * FROM sseg", "sseg")
def _(i):
    return fd.summary_segment(i.summary)


@query("segment_conflicts", """WITH a AS (SELECT mi, org, sum(pf_recip) AS pf, min(h) AS lo, max(h) AS hi, min(seg_rep) <> max(seg_rep) AS d FROM (SELECT *, CASE WHEN seg_src IN ('history', 'org history') THEN seg_rep END AS h FROM summ) GROUP BY 1, 2)
 SELECT mi, count(*) FILTER (WHERE lo <> hi) AS n_org, CAST(coalesce(sum(pf) FILTER (WHERE lo <> hi), 0) AS BIGINT) AS pf, count(*) FILTER (WHERE lo = hi AND d) AS n_mix, CAST(coalesce(sum(pf) FILTER (WHERE lo = hi AND d), 0) AS BIGINT) AS pf_mix FROM a GROUP BY 1""", "summ")
def _(i):
    return fd.segment_conflicts(i.summary)


@query("slice_coverage", """WITH j AS (SELECT mi, org, sum(pf_recip) AS pf, any_value(industry) AS ind, any_value(hold) AS hold FROM summ LEFT JOIN orgs USING (org) GROUP BY 1, 2)
 SELECT mi, count(*) AS n_orgs, CAST(sum(pf) AS BIGINT) AS pf, count(ind) AS orgs_industry, CAST(coalesce(sum(pf) FILTER (WHERE ind IS NOT NULL), 0) AS BIGINT) AS pf_industry, count(hold) AS orgs_hold,
  CAST(coalesce(sum(pf) FILTER (WHERE hold IS NOT NULL), 0) AS BIGINT) AS pf_hold FROM j GROUP BY 1""", ("summ", "orgs"))
def _(i):
    return fd.slice_coverage(i.summary, i.orgs)


@query("slice_series", f"SELECT * EXCLUDE ({', '.join(FLOATY)}), {_RN(FLOATY)} FROM sl", "sl")
def _(i):
    return fd.slice_series(collapsed(i))


_CN = (*fd.GROUPS, "reported", "people", *fd.PERSON_PARTS)


@query("components", f"SELECT slice_type, slice_key, mi, pf_recip, {_RN(_CN)} FROM cmpn", "cmpn")
def _(i):
    return fd.components(series(i))


@query("deviation_scan", f"""SELECT slice_type, slice_key, mi, CAST(length AS BIGINT) AS length, base, CAST(list_position(['none','y1','y2','avg'], base) - 1 AS BIGINT) AS base_pos, round(z, 4) + 0.0 AS z, round(z_real, 4) + 0.0 AS z_real, sig_r AS real_sig,
 round(d_reported, 4) + 0.0 AS excess, round(w_reported, 4) + 0.0 AS this, round(b_reported, 4) + 0.0 AS base_value, {_RN([f'g_{n}' for n in _GR])} FROM scan""", "scan")
def _(i):
    return fd.deviation_scan(comps(i), (26, 27, 28, 29), **SCAN)


@query("stories")
def _(i):
    return fd.stories(fd.deviation_scan(comps(i), (26, 27, 28, 29), **SCAN), fd.known(series(i)), mat_abs=3.0).drop("n_seen")


_K = (*_CC, *fd.PERSON_PARTS)


@query("deviation_card", " UNION ALL ".join(f"""SELECT '{k}' AS component, '{fd.GROUPS.get(k, 'persons' if k in fd.PERSON_PARTS else 'total')}' AS grp, round(a.w, 4) + 0.0 AS in_window, round(b.w, 4) + 0.0 AS in_base, round(a.w - b.w, 4) + 0.0 AS deviation
 FROM (SELECT CASE WHEN count({_Q(k)}) = 3 THEN sum({_Q(k)}) END AS w FROM cmpn WHERE slice_type = 'bank' AND mi BETWEEN 26 AND 28) a, (SELECT CASE WHEN count({_Q(k)}) = 3 THEN sum({_Q(k)}) END AS w FROM cmpn WHERE slice_type = 'bank' AND mi BETWEEN 14 AND 16) b""" for k in _K), "cmpn")
def _(i):
    return fd.deviation_card(comps(i), "bank", "bank", 28, 3, "y1")


@query("resegmentation", """WITH p AS (SELECT slice_key, CAST(sum(pf_recip) FILTER (WHERE slice_type = 'segment') AS BIGINT) AS c, CAST(sum(pf_recip) FILTER (WHERE slice_type = 'segment at pay date') AS BIGINT) AS r FROM sl WHERE mi = 28 AND slice_type IN ('segment', 'segment at pay date') GROUP BY 1),
 m AS (SELECT slice_key, CASE WHEN count(reclass) = 12 THEN sum(reclass) END AS t FROM cmpn WHERE slice_type = 'segment at pay date' AND mi BETWEEN 17 AND 28 GROUP BY 1)
 SELECT slice_key, c AS current, r AS at_pay_date, c - r AS difference, round(t, 4) + 0.0 AS transfers FROM p LEFT JOIN m USING (slice_key) WHERE coalesce(c, 0) <> 0 OR coalesce(r, 0) <> 0""", ("sl", "cmpn"))
def _(i):
    return fd.resegmentation(series(i), comps(i), 28)


# ---------------------------------------------------------------- calendar

def pay_days(i):
    return i.payroll.select("mi", "day", "person", "org", "unit", (F.col("org") % 2).alias("region"), "amt", F.col("code").isin("R", "N").alias("is_pf"), (F.col("unit") < 0).alias("is_fixed"))


TH = 30000
cte("wind", f"""WITH w AS (SELECT 'cal' AS kind, mi AS m, * FROM payroll UNION ALL SELECT 'sh', CASE WHEN day(day) <= 15 THEN mi ELSE mi + 1 END, * FROM payroll)
 SELECT kind, m AS mi, person, org, unit, org % 2 AS region, sum(amt) AS sum_pf FROM w WHERE code IN ('R', 'N') GROUP BY 1, 2, 3, 4, 5 HAVING sum(amt) > {TH} OR (org = 3 AND bool_or(amt > 0))""", "payroll")
cte("cald", """SELECT mi, org, unit, min(region) AS region, count(*) FILTER (WHERE c) AS n_cal, count(*) FILTER (WHERE s) AS n_sh, count(*) FILTER (WHERE c AND s) AS n_both FROM (
  SELECT mi, person, org, unit, min(region) AS region, bool_or(kind = 'cal') AS c, bool_or(kind = 'sh') AS s FROM wind GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", "wind")


def windows(i):
    ex = i.table("region").where("r_regionkey = 3").select(F.col("r_regionkey").alias("org"))
    return ca.windows_from_halves(ca.half_months(pay_days(i)), TH, ex)


@query("daily_halves", """SELECT mi, person, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, CAST(CASE WHEN day(day) <= 15 THEN 1 ELSE 2 END AS BIGINT) AS half, CAST(org % 2 AS BIGINT) AS region,
 CAST(sum(amt) FILTER (WHERE code IN ('R','N')) AS DOUBLE) AS sum_pf, bool_or(code IN ('R','N') AND amt > 0) AS pos_pf, false AS pos_fixed FROM payroll GROUP BY 1, 2, 3, 4, 5, 6""", "payroll")
def _(i):
    return ca.half_months(pay_days(i))


@query("windows_from_halves", "SELECT kind, CAST(mi AS BIGINT) AS mi, person, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, CAST(region AS BIGINT) AS region, CAST(sum_pf AS DOUBLE) AS sum_pf FROM wind", "wind")
def _(i):
    return windows(i)


@query("calendar_triples", "SELECT CAST(mi AS BIGINT) AS mi, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, CAST(region AS BIGINT) AS region, n_cal, n_sh, n_both FROM cald", "cald")
def _(i):
    return ca.calendar_triples(windows(i))


cte("cmon", f"""SELECT mi, count(*) + CASE WHEN mi % 10 = 0 THEN 5 ELSE 0 END AS pf FROM (SELECT mi, person, org, unit FROM payroll WHERE code IN ('R', 'N') GROUP BY 1, 2, 3, 4 HAVING sum(amt) > {TH} OR (org = 3 AND bool_or(amt > 0))) GROUP BY 1""", "payroll")


def monthly(i):
    w = windows(i).where("kind = 'cal'").groupBy("mi").agg(F.count(F.lit(1)).alias("pf"))
    return w.withColumn("pf", F.col("pf") + F.when(F.col("mi") % 10 == 0, 5).otherwise(0))


_YX = "(a.{c} - b.{c}) - (y.{c} - z.{c})"
cte("cex", f"""WITH t AS (SELECT c.mi, c.cal, c.sh, m.pf, abs(c.cal - m.pf) / m.pf AS off FROM (SELECT mi, CAST(sum(n_cal) AS BIGINT) AS cal, CAST(sum(n_sh) AS BIGINT) AS sh FROM cald GROUP BY 1) c LEFT JOIN cmon m USING (mi))
 SELECT a.mi, {', '.join(f'{_YX.format(c=c)} AS {c}_x' for c in ('cal', 'sh', 'pf'))}, CASE WHEN a.off + b.off + y.off + z.off IS NOT NULL THEN greatest(a.off, b.off, y.off, z.off) END AS sync
 FROM t a LEFT JOIN t b ON b.mi = a.mi - 1 LEFT JOIN t y ON y.mi = a.mi - 12 LEFT JOIN t z ON z.mi = a.mi - 13""", "cald", "cmon")


@query("calendar_boundary", """SELECT CAST(mi AS BIGINT) AS mi, pf_x AS monthly_excess, cal_x - sh_x AS border_shift, sh_x AS remainder, pf_x - cal_x AS source_gap, CASE WHEN pf_x <> 0 THEN round((cal_x - sh_x) / pf_x, 4) + 0.0 END AS border_share, round(sync, 4) AS sync_gap,
 CASE WHEN sync IS NULL THEN 'cannot compare' WHEN sync > 0.005 THEN 'sources differ' WHEN cal_x IS NULL OR sh_x IS NULL THEN 'unknown' WHEN abs(sh_x) < 0.2 * abs(cal_x) THEN 'calendar' ELSE 'other reasons' END AS verdict FROM cex""", "cex")
def _(i):
    return ca.calendar_boundary(ca.calendar_triples(windows(i)), monthly(i))


@query("calendar_boundary_by_slice", """WITH t AS (SELECT region, mi, CAST(sum(n_cal) AS BIGINT) AS cal, CAST(sum(n_sh) AS BIGINT) AS sh FROM cald GROUP BY 1, 2)
 SELECT CAST(a.region AS BIGINT) AS region, (a.cal - b.cal) - (y.cal - z.cal) AS cal_excess, (a.sh - b.sh) - (y.sh - z.sh) AS sh_excess, ((a.cal - b.cal) - (y.cal - z.cal)) - ((a.sh - b.sh) - (y.sh - z.sh)) AS border_shift
 FROM t a JOIN t b ON b.region = a.region AND b.mi = a.mi - 1 JOIN t y ON y.region = a.region AND y.mi = a.mi - 12 JOIN t z ON z.region = a.region AND z.mi = a.mi - 13 WHERE a.mi = 45""", "cald")
def _(i):
    return ca.boundary_by_slice(ca.calendar_triples(windows(i)), "region", 45)


@query("largest_months", """SELECT CAST(a.mi AS BIGINT) AS mi, (a.pf - b.pf) - (y.pf - z.pf) AS pf_excess FROM cmon a JOIN cmon b ON b.mi = a.mi - 1 JOIN cmon y ON y.mi = a.mi - 12 JOIN cmon z ON z.mi = a.mi - 13 ORDER BY abs((a.pf - b.pf) - (y.pf - z.pf)) DESC, a.mi LIMIT 4""", "cmon")
def _(i):
    return ca.largest_months(monthly(i), 4)


# ---------------------------------------------------------------- business

_BM = [*dict.fromkeys([m for m, _ in (*bu.FLOWS, *bu.REASONS)] + list(bu.STOCK_MARKS) + ["pf_recip", "pf_fl", "m_base_pf"])]
cte("atom", "SELECT mi, seg_rep, region, unit, " + ", ".join(f"sum({' + '.join(sm.GENERATION[m])}) AS {m}" for m in _BM) + " FROM summ GROUP BY 1, 2, 3, 4", "summ")
cte("bt", "SELECT mi, " + ", ".join(f"CASE WHEN count(*) = count({m}) THEN " + (f"sum({m})" if m == "pf_fl" else f"CAST(sum({m}) AS BIGINT)") + f" END AS {m}" for m in _BM) + " FROM atom GROUP BY 1", "atom")
_NET = " + ".join(f"({s} * t.{f})" for f, s in bu.FLOWS)
cte("bh", f"""WITH a AS (SELECT x.mi, 0.5 * sum(abs(x.pf_recip - y.pf_recip)) AS opp FROM atom x JOIN atom y ON y.mi = x.mi - 1 AND y.seg_rep = x.seg_rep AND y.region = x.region AND y.unit = x.unit GROUP BY 1)
 SELECT t.mi, p.pf_recip AS was, t.pf_recip AS now, t.pf_recip - p.pf_recip AS change, {_NET} AS net_flow, t.pf_recip - p.pf_recip - ({_NET}) AS residual, coalesce(abs(t.pf_recip - p.pf_recip - ({_NET})), 1) <= 0.5 AS verified,
  CAST(greatest(abs(t.pf_recip - p.pf_recip), opp) AS DOUBLE) AS volume FROM bt t JOIN bt p ON p.mi = t.mi - 1 LEFT JOIN a ON a.mi = t.mi""", "bt", "atom")


@query("sum_known", "SELECT mi, " + ", ".join((f"round({m}, 4) + 0.0 AS {m}" if m == "pf_fl" else m) for m in _BM) + " FROM bt", "bt")
def _(i):
    return bu.bank_totals(i.atoms, _BM)


@query("business_history", "SELECT * FROM bh", "bh")
def _(i):
    return bu.business_history(i.atoms)


@query("business_month", "WITH p AS (SELECT arg_max(mi, (volume, -mi)) AS m FROM bh) " + " UNION ALL ".join(f"SELECT mi, '{f}' AS movement, CAST({s} * {f} AS DOUBLE) AS contribution FROM bt WHERE mi = (SELECT m FROM p)" for f, s in bu.FLOWS)
       + " UNION ALL SELECT mi, 'residual', CAST(residual AS DOUBLE) FROM bh WHERE mi = (SELECT m FROM p)", ("bh", "bt"))
def _(i):
    return bu.business_month(i.atoms)


@query("business_slices", """WITH t AS (SELECT seg_rep, mi, CAST(sum(pf_recip) AS BIGINT) AS v FROM atom GROUP BY 1, 2) SELECT a.seg_rep, b.v AS was, a.v AS now, a.v - b.v AS change FROM t a LEFT JOIN t b ON b.mi = a.mi - 1 AND b.seg_rep = a.seg_rep WHERE a.mi = 25""", "atom")
def _(i):
    return bu.business_slices(i.atoms, "seg_rep", 25)


cte("byr", """SELECT a.mi, a.pf_recip - b.pf_recip AS this_year, y.pf_recip - z.pf_recip AS last_year, (a.pf_recip - b.pf_recip) - (y.pf_recip - z.pf_recip) AS excess, round((a.pf_fl - b.pf_fl) - (y.pf_fl - z.pf_fl), 4) + 0.0 AS excess_persons
 FROM bt a JOIN bt b ON b.mi = a.mi - 1 JOIN bt y ON y.mi = a.mi - 12 JOIN bt z ON z.mi = a.mi - 13""", "bt")


@query("business_yoy", "SELECT * FROM byr", "byr")
def _(i):
    return bu.business_yoy(i.atoms)


_YF = " UNION ALL ".join([f"SELECT '{m}' AS mark, CAST({s} * a.{m} AS DOUBLE) AS this_year, CAST({s} * y.{m} AS DOUBLE) AS last_year FROM bt a, bt y WHERE a.mi = 28 AND y.mi = 16" for m, s in (*bu.FLOWS, *bu.REASONS)]
                         + [f"SELECT 'stock {m}', CAST(a.{m} - b.{m} AS DOUBLE), CAST(y.{m} - z.{m} AS DOUBLE) FROM bt a, bt b, bt y, bt z WHERE a.mi = 28 AND b.mi = 27 AND y.mi = 16 AND z.mi = 15" for m in bu.STOCK_MARKS])
cte("yf", f"SELECT *, this_year - last_year + 0.0 AS excess FROM ({_YF})", "bt")


@query("yoy_flows", "SELECT mark, this_year + 0.0 AS this_year, last_year + 0.0 AS last_year, excess FROM yf", "yf")
def _(i):
    return bu.yoy_flows(i.atoms, 28)


_E = lambda m: f"(SELECT excess FROM yf WHERE mark = '{m}')"
_PARTS = {"temporary leave": _E("m_out_temp_left"), "return after temporary leave": _E("m_in_temp_outside"), "permanent leave": f"{_E('m_out_left_bank')} - {_E('m_out_temp_left')}",
          "arrivals without returns": f"{_E('m_in_from_outside')} - {_E('m_in_temp_outside')}", "between organisations": f"{_E('m_in_from_other_org')} + {_E('m_out_to_other_org')}", "codes": f"{_E('m_in_codes')} + {_E('m_out_codes')}"}


@query("yoy_explanation", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{k}' AS part, {v} AS excess" for k, v in _PARTS.items()) + """), t AS (SELECT CAST(excess AS DOUBLE) AS total FROM byr WHERE mi = 28),
 u AS (SELECT * FROM p UNION ALL SELECT 'residual', (SELECT total FROM t) - (SELECT sum(excess) FROM p)) SELECT part, excess + 0.0 AS excess, CASE WHEN total <> 0 THEN round(excess / total, 4) + 0.0 END AS share FROM u, t""", ("yf", "byr"))
def _(i):
    return bu.yoy_explanation(i.atoms, 28)


_NB = ("pf_recip", "m_in_from_outside", "m_out_left_bank", "m_out_temp_left", "m_in_temp_outside", "single_pay_recip")


@query("neighbour_case", " UNION ALL ".join(f"SELECT '{m}' AS measure, " + ", ".join(f"CAST(max({m}) FILTER (WHERE mi = {27 + d - k}) AS DOUBLE) AS {y}_{n}" for y, k in (("now", 0), ("ago", 12)) for n, d in (("prev", -1), ("cur", 0), ("next", 1))) + " FROM bt" for m in _NB), "bt")
def _(i):
    return bu.neighbour_case(i.atoms, 27)
