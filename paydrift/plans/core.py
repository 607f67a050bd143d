"""Queries over triples, persons, series and payment codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import triples as tr
from ..functions import columns as fc
from ..sources import scans as sc
from .inputs import THRESHOLD
from .registry import query


@query("triples", """
 SELECT mi, person, org, unit, CAST(sum_pf AS DOUBLE) AS sum_pf, CAST(sum_fot AS DOUBLE) AS sum_fot, pos_pf, pos_fixed,
   pos_any, n_rows, n_pay FROM tri""", "tri")
def _(i):
    return i.triples.select("mi", "person", "org", "unit", "sum_pf", "sum_fot", "pos_pf", "pos_fixed", "pos_any", "n_rows", "n_pay")


@query("triple_state", """
 SELECT mi, person, org, unit, st, CAST(pf_amt AS DOUBLE) AS pf_amt, CAST(fot_amt AS DOUBLE) AS fot_amt FROM tri""", "tri")
def _(i):
    return i.triples.select("mi", "person", "org", "unit", "st", "pf_amt", "fot_amt")


@query("threshold_scope_org", """
 SELECT mi, person, org, unit, CAST(amt AS DOUBLE) AS amt, CAST(scope_amt AS DOUBLE) AS scope_amt FROM (
  SELECT mi, person, org, unit, sum(amt) AS amt, sum(sum(amt)) OVER (PARTITION BY mi, person, org) AS scope_amt
  FROM lines WHERE code <= 2 GROUP BY 1, 2, 3, 4) WHERE scope_amt > 20""", "lines")
def _(i):
    return tr.threshold_scope(i.lines, THRESHOLD, "org")


@query("threshold_scope_triple", """
 SELECT mi, person, org, unit, CAST(sum(amt) AS DOUBLE) AS amt, CAST(sum(amt) AS DOUBLE) AS scope_amt
 FROM lines WHERE code <= 2 GROUP BY 1, 2, 3, 4 HAVING sum(amt) > 20""", "lines")
def _(i):
    return tr.threshold_scope(i.lines, THRESHOLD, "triple")


@query("scope_probe", """
 WITH t AS (SELECT mi, person, org, unit, sum(amt) AS amt, sum(sum(amt)) OVER (PARTITION BY mi, person, org) AS w
            FROM lines WHERE code <= 2 GROUP BY 1, 2, 3, 4)
 SELECT mi, count(*) FILTER (WHERE amt > 20) AS by_triple, count(*) FILTER (WHERE w > 20) AS by_org,
   count(DISTINCT CASE WHEN w > 20 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.mi = t.mi AND u.person = t.person
      AND u.org = t.org AND u.amt > 20) THEN person || '/' || org END) AS only_by_org FROM t GROUP BY 1""", "lines")
def _(i):
    return tr.scope_probe(i.lines, THRESHOLD)


@query("month_totals", """
 SELECT mi, count(*) AS n_triples, count(DISTINCT person) AS n_persons, count(DISTINCT org) AS n_orgs,
   CAST(sum(pf_amt) AS DOUBLE) AS amt FROM rec GROUP BY 1""", "rec")
def _(i):
    return tr.month_totals(i.recipients)


@query("segment_series", """
 WITH t AS (SELECT tri.*, o.seg FROM tri LEFT JOIN orgs o USING (org)),
 g AS (SELECT mi, seg, person, st, pos_fixed OR (pos_pf AND (org='signup' OR sum_pf > 0)) AS h0,
    pos_fixed OR (pos_pf AND (org='signup' OR sum_pf > 10)) AS h10, pos_fixed OR (pos_pf AND (org='signup' OR sum_pf > 50)) AS h50,
    pos_fixed OR (pos_pf AND (org='signup' OR sum_pf > 100)) AS h100 FROM t)
 SELECT mi, seg, count(*) FILTER (WHERE st='P') AS n_triples, count(DISTINCT person) FILTER (WHERE st='P') AS n_persons,
   count(*) FILTER (WHERE h0) AS t0, count(*) FILTER (WHERE h10) AS t10, count(*) FILTER (WHERE h50) AS t50,
   count(*) FILTER (WHERE h100) AS t100 FROM g GROUP BY 1, 2
 UNION ALL SELECT mi, '__ALL__', count(*) FILTER (WHERE st='P'), count(DISTINCT person) FILTER (WHERE st='P'),
   count(*) FILTER (WHERE h0), count(*) FILTER (WHERE h10), count(*) FILTER (WHERE h50), count(*) FILTER (WHERE h100)
 FROM g GROUP BY 1""", ("tri", "orgs"))
def _(i):
    return tr.series(i.triples, i.orgs, (0, 10, 50, 100))


@query("threshold_sensitivity", """
 SELECT t AS threshold, count(*) FILTER (WHERE mi=20 AND ok) AS n_base, count(*) FILTER (WHERE mi=21 AND ok) AS n_current,
   count(*) FILTER (WHERE mi=21 AND ok) - count(*) FILTER (WHERE mi=20 AND ok) AS change
 FROM (SELECT mi, t, pos_fixed OR (pos_pf AND (org='signup' OR sum_pf > t)) AS ok FROM tri,
       (VALUES (0), (10), (25), (50), (100)) v(t)) GROUP BY 1""", "tri")
def _(i):
    return tr.threshold_sensitivity(i.triples, 20, 21, (0, 10, 25, 50, 100))


@query("load_health", """
 WITH p AS (SELECT mi, count(*) AS n_rows, CAST(sum(amt) AS DOUBLE) AS amt, count(*) FILTER (WHERE org='error') AS n_bad_org,
   count(*) FILTER (WHERE person IS NULL) AS n_no_person FROM lines GROUP BY 1)
 SELECT *, round(n_rows / (SELECT median(n_rows) FROM p), 4) AS to_median, n_rows / (SELECT median(n_rows) FROM p) < 0.95 AS is_thin,
   round(n_bad_org / n_rows, 4) AS bad_share FROM p""", "lines")
def _(i):
    return tr.load_health(i.lines, F.col("org") != "error", 0.95)


@query("distinct_persons", "SELECT org, count(DISTINCT person) AS n_persons FROM lines GROUP BY 1", "lines")
def _(i):
    return tr.distinct_count(i.lines, ["org"], "person", "n_persons")


_MULTI = """count(*) AS n_persons, CAST(sum(n) AS BIGINT) AS n_triples, CAST(sum(k) AS BIGINT) AS n_pairs,
 CAST(sum(k-1) AS BIGINT) AS extra_orgs, CAST(sum(n-k) AS BIGINT) AS extra_units, count(*) FILTER (WHERE k=1) AS one_org,
 count(*) FILTER (WHERE k=2) AS two_orgs, count(*) FILTER (WHERE k>=3) AS many_orgs, count(*) FILTER (WHERE n>k) AS multi_unit"""


@query("multi_structure", f"""
 SELECT mi, {_MULTI} FROM (SELECT mi, person, count(DISTINCT org) AS k, count(*) AS n FROM rec GROUP BY 1, 2) GROUP BY 1""", "rec")
def _(i):
    return tr.multi_structure(i.recipients)


@query("multi_structure_by_segment", f"""
 SELECT mi, seg, {_MULTI} FROM (SELECT mi, seg, person, count(DISTINCT org) AS k, count(*) AS n FROM rec GROUP BY 1, 2, 3)
 GROUP BY 1, 2""", "rec")
def _(i):
    return tr.multi_structure(i.recipients, ["seg"])


@query("person_month", "SELECT mi, person, n_org, n_triples, main_seg, CAST(main_region AS BIGINT) AS main_region, main_org FROM pm", "pm")
def _(i):
    return i.person_month


@query("person_presence", """
 SELECT mi, person, CAST(amt_all AS DOUBLE) AS amt_all, CAST(amt_codes AS DOUBLE) AS amt_codes FROM presence""", "presence")
def _(i):
    return i.presence


@query("code_months", """
 WITH p AS (SELECT mi, code, person, sum(amt) AS amt FROM lines WHERE code <= 2 AND mi IN (9, 20, 21) GROUP BY 1, 2, 3),
 q AS (SELECT code, count(*) FILTER (WHERE mi=9) AS n_base, count(*) FILTER (WHERE mi=20) AS n_prev, count(*) FILTER (WHERE mi=21) AS n_cur,
   CAST(coalesce(sum(amt) FILTER (WHERE mi=9),0) AS DOUBLE) AS amt_base, CAST(coalesce(sum(amt) FILTER (WHERE mi=20),0) AS DOUBLE) AS amt_prev,
   CAST(coalesce(sum(amt) FILTER (WHERE mi=21),0) AS DOUBLE) AS amt_cur FROM p GROUP BY 1)
 SELECT *, n_cur-n_prev AS n_month, n_cur-n_base AS n_year, round(amt_cur-amt_prev,2) AS amt_month, round(amt_cur-amt_base,2) AS amt_year
 FROM q""", "lines")
def _(i):
    return tr.code_months(i.lines, 9, 20, 21)


@query("paytype_transition", """
 WITH p AS (SELECT mi, person, org, bool_or(has_adv) AS a, bool_or(has_sal) AS s, bool_or(st='P') AS rec FROM tri
            WHERE pos_pf OR pos_fixed GROUP BY 1, 2, 3),
 k AS (SELECT *, CASE WHEN a AND s THEN 'both' WHEN s THEN 'sal' WHEN a THEN 'adv' ELSE 'other' END AS kind FROM p)
 SELECT b.mi, b.kind, coalesce(c.kind, 'none') AS kind_next, CASE WHEN c.rec THEN 1 ELSE 0 END AS rec_next, count(*) AS n_pairs
 FROM k b LEFT JOIN k c ON c.mi = b.mi + 1 AND c.person = b.person AND c.org = b.org
 WHERE b.rec AND b.mi IN (8, 20) GROUP BY 1, 2, 3, 4""", "tri")
def _(i):
    return tr.paytype_transition(i.triples, (8, 20))


@query("pay_schedule_counts", """
 SELECT mi, org, count(*) FILTER (WHERE a=1 AND s=0) AS one_advance, count(*) FILTER (WHERE a=0 AND s=1) AS one_salary,
   count(*) FILTER (WHERE a+s=2) AS two_payments, count(*) AS n_persons
 FROM (SELECT mi, org, person, count(*) FILTER (WHERE code=0) AS a, count(*) FILTER (WHERE code=1) AS s
       FROM lines WHERE code IN (0,1) GROUP BY 1, 2, 3) GROUP BY 1, 2""", "lines")
def _(i):
    return tr.pay_schedule_counts(i.lines, 0, 1)


@query("threshold_cutoff_detail", """
 SELECT mi, org, code, count(*) FILTER (WHERE t>20) AS n_counted, count(*) FILTER (WHERE t<20) AS n_below, count(*) FILTER (WHERE t=20) AS n_at,
   CAST(coalesce(sum(amt) FILTER (WHERE t>20),0) AS DOUBLE) AS amt_counted, CAST(coalesce(sum(amt) FILTER (WHERE t<=20),0) AS DOUBLE) AS amt_cut
 FROM (SELECT mi, org, person, code, sum(amt) AS amt, sum(sum(amt)) OVER (PARTITION BY mi, org, person) AS t
       FROM lines WHERE code <= 2 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", "lines")
def _(i):
    return tr.threshold_cutoff_detail(i.lines, THRESHOLD)


# ------------------------------------------------------------------- scans

@query("scan_period", "SELECT mi, person, org, code, CAST(amt AS DOUBLE) AS amt FROM lines WHERE mi = 12", "lines")
def _(i):
    return sc.scan_period(i.lines, "mi", 12, ["mi", "person", "org", "code", "amt"])


@query("scan_periods", "SELECT mi, org, CAST(sum(amt) AS DOUBLE) AS amt FROM lines WHERE mi IN (0,12,24) GROUP BY 1, 2", "lines")
def _(i):
    return sc.scan_periods(i.lines, "mi", [0, 12, 24]).groupBy("mi", "org").agg(F.sum("amt").alias("amt"))


@query("scan_range", """SELECT strftime(period, '%Y-%m-%d') AS period, count(*) AS n FROM lines
 WHERE period BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1""", "lines")
def _(i):
    lo, hi = F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")
    return sc.scan_range(i.lines, "period", lo, hi).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("scan_archive_union", """
 SELECT source, count(*) AS n FROM (SELECT DISTINCT mi, person, org, 'archive' AS source FROM lines WHERE mi <= 14
  UNION SELECT DISTINCT mi, person, org, 'current' FROM lines WHERE mi > 14) GROUP BY 1""", "lines")
def _(i):
    return sc.scan_archive_union(i.lines, i.lines, "mi", 14, ["mi", "person", "org"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("narrow_copy", """
 SELECT mi, count(*) AS n, CAST(sum(amt) AS DOUBLE) AS amt FROM lines
 WHERE mi IN (8, 9) OR (mi IN (1,2,3) AND code <= 2) GROUP BY 1""", "lines")
def _(i):
    return sc.narrow_copy(i.lines, "mi", ["mi", "amt"], [8, 9], [1, 2, 3, 9], F.col("is_pf")).groupBy("mi").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amt").alias("amt"))


@query("source_probe", """
 SELECT count(*) AS n_rows, CAST(min(mi) AS BIGINT) AS first_period, CAST(max(mi) AS BIGINT) AS last_period,
   count(DISTINCT person) AS n_person, count(DISTINCT org) AS n_org, round(count(hold)/count(*), 4) AS fill_hold
 FROM lines LEFT JOIN orgs USING (org)""", ("lines", "orgs"))
def _(i):
    return sc.source_probe(i.lines.join(i.orgs, "org", "left"), "mi", ["person", "org"], ["hold"])


_RATE = """
 WITH k AS (SELECT 'unit' AS candidate, CAST(unit AS VARCHAR) AS key, count(*) AS n FROM lines GROUP BY 2
   UNION ALL SELECT 'code', CAST(code AS VARCHAR), count(*) FROM lines GROUP BY 2
   UNION ALL SELECT 'region', CAST(region AS VARCHAR), count(*) FROM lines GROUP BY 2),
 d AS (SELECT CAST(r_regionkey AS VARCHAR) AS key FROM region),
 r AS (SELECT candidate, count(*) AS n_keys, count(*) FILTER (WHERE key IN (SELECT key FROM d)) AS n_known,
   CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE key IN (SELECT key FROM d)), 0) AS BIGINT) AS n_known_rows
   FROM k GROUP BY 1)"""


@query("key_match_rate", _RATE + " SELECT *, round(n_known_rows / n_rows, 4) AS row_share FROM r", "lines")
def _(i):
    return sc.key_match_rate(i.lines, ["unit", "code", "region"], i.table("region"), "r_regionkey")


@query("choose_key", _RATE + """ SELECT candidate, round(n_known_rows / n_rows, 4) AS row_share FROM r
 WHERE n_known_rows / n_rows >= 0.9 ORDER BY n_known_rows / n_rows DESC, n_known DESC, candidate DESC LIMIT 1""", "lines")
def _(i):
    return sc.choose_key(sc.key_match_rate(i.lines, ["unit", "code", "region"], i.table("region"), "r_regionkey"), 0.9)


@query("level_filter", """SELECT c_nationkey AS level_id, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def _(i):
    nat = i.table("customer").select(F.lit("nation").alias("level_name"), F.col("c_mktsegment").alias("org_type"), F.col("c_nationkey").alias("level_id"))
    seg = nat.withColumn("level_name", F.lit("segment"))
    return sc.level_filter(nat.unionByName(seg), "nation", "BUILDING").groupBy("level_id").agg(F.count(F.lit(1)).alias("n"))
