"""Queries over the bitmap histories and the monthly summary."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import masks as mk
from ..operators import summary as sm
from .inputs import CMP0, CURRENT_MI, LAST
from .registry import cte, query

CUR = CURRENT_MI

# --- SQL twins: plain joins over triples, no bitmaps.
cte("kpf", "SELECT mi, person, count(*) AS k FROM tri WHERE st = 'P' GROUP BY 1, 2", "tri")
cte("po", "SELECT mi, person, org, count(*) AS n FROM tri WHERE st = 'P' GROUP BY 1, 2, 3", "tri")
cte("ph", "SELECT mi, person, hold, count(*) AS n FROM tri JOIN orgs USING (org) WHERE st = 'P' AND hold IS NOT NULL GROUP BY 1, 2, 3", "tri", "orgs")


def _has(alias: str, at: str, cond: str = "TRUE") -> str:
    return (f"EXISTS (SELECT 1 FROM tri h WHERE h.person = {alias}.person AND h.org = {alias}.org AND h.unit = {alias}.unit "
            f"AND h.mi = {at} AND {cond})")


def _between(alias: str, lo: str, hi: str, cond: str = "TRUE", person_only: bool = False) -> str:
    key = "" if person_only else f" AND h.org = {alias}.org AND h.unit = {alias}.unit"
    return f"EXISTS (SELECT 1 FROM tri h WHERE h.person = {alias}.person{key} AND h.mi BETWEEN {lo} AND {hi} AND {cond})"


def _ten(a: str, at: str) -> str:
    p = "h.st = 'P'"
    return (f"CASE WHEN NOT {_between(a, f'{at} - 12', f'{at} - 3', p)} THEN 'lt3' WHEN {_has(a, f'{at} - 12', p)} THEN '12p' ELSE '3_12' END")


def _once(a: str, at: str, person_only: bool = False) -> str:
    return (f"(NOT {_between(a, f'{at} - 12', f'{at} - 1', person_only=person_only)} "
            f"AND NOT {_between(a, f'{at} + 1', f'{at} + 2', person_only=person_only)})")


for tag, k in (("m", 1), ("y", 12)):
    temp = _has("c", "c.mi - 2", "h.st = 'P'") if k == 1 else "FALSE"
    cte(f"min_{tag}", f"""
     SELECT *, CASE WHEN kb IS NULL THEN 1.0 / kc ELSE 0 END AS fl, CASE WHEN kb IS NULL THEN 1 ELSE 0 END AS in_new,
       CASE WHEN kb IS NOT NULL AND kc > kb THEN (kc - kb) / count(*) OVER (PARTITION BY mi, person) ELSE 0 END AS in_conc
     FROM (SELECT c.mi, c.person, c.org, c.unit, pc.k AS kc, pb.k AS kb, CASE WHEN {temp} THEN 1 ELSE 0 END AS in_temp,
       CASE WHEN b.st = 'N' THEN 'in_from_nonzp' WHEN b.st IS NOT NULL THEN 'in_from_zp_out'
            WHEN pb.k IS NOT NULL THEN CASE WHEN so.n IS NOT NULL THEN 'in_oth_same_org' WHEN sh.n IS NOT NULL THEN 'in_oth_same_hold' ELSE 'in_oth_other' END
            WHEN {_between('c', f'c.mi - {k} - 12', f'c.mi - {k} - 1', "h.st = 'P'", True)} THEN 'in_returned' ELSE 'in_new_bank' END AS lab
      FROM tri c LEFT JOIN tri b ON b.person = c.person AND b.org = c.org AND b.unit = c.unit AND b.mi = c.mi - {k}
      JOIN kpf pc ON pc.mi = c.mi AND pc.person = c.person LEFT JOIN kpf pb ON pb.mi = c.mi - {k} AND pb.person = c.person
      LEFT JOIN orgs o ON o.org = c.org LEFT JOIN po so ON so.mi = c.mi - {k} AND so.person = c.person AND so.org = c.org
      LEFT JOIN ph sh ON sh.mi = c.mi - {k} AND sh.person = c.person AND sh.hold = o.hold
      WHERE c.st = 'P' AND c.mi >= {k} AND coalesce(b.st, '') <> 'P')""", "tri", "kpf", "po", "ph", "orgs")
    cte(f"mout_{tag}", f"""
     SELECT *, CASE WHEN kc IS NULL THEN 1.0 / kb ELSE 0 END AS fl, CASE WHEN kc IS NULL THEN 1 ELSE 0 END AS out_gone,
       CASE WHEN kc IS NOT NULL AND kb > kc THEN (kb - kc) / count(*) OVER (PARTITION BY mi, person) ELSE 0 END AS out_conc
     FROM (SELECT b.mi + {k} AS mi, b.person, b.org, b.unit, pc.k AS kc, pb.k AS kb,
       CASE WHEN {_has('b', f'b.mi + {k} + 1', "h.st = 'P'")} THEN 1 ELSE 0 END AS out_temp, {_ten('b', 'b.mi')} AS ten,
       CASE WHEN c.st = 'N' THEN 'out_to_nonzp' WHEN c.st IS NOT NULL THEN 'out_zp_out'
            WHEN pc.k IS NOT NULL THEN CASE WHEN so.n IS NOT NULL THEN 'out_oth_same_org' WHEN sh.n IS NOT NULL THEN 'out_oth_same_hold' ELSE 'out_oth_other' END
            WHEN {_has('b', f'b.mi + {k} - 13', "h.st = 'P'")} AND NOT {_has('b', f'b.mi + {k} - 12', "h.st = 'P'")}
              AND {_between('b', f'b.mi + {k} - 11', f'b.mi + {k} - 9', "h.st = 'P'")} THEN 'lb_seasonal'
            WHEN NOT EXISTS (SELECT 1 FROM tri h WHERE h.org = b.org AND h.mi = b.mi + {k} AND h.st = 'P') THEN 'lb_org_stopped'
            WHEN {_once('b', 'b.mi')} THEN 'lb_one_time' ELSE 'lb_unknown' END AS lab
      FROM tri b LEFT JOIN tri c ON c.person = b.person AND c.org = b.org AND c.unit = b.unit AND c.mi = b.mi + {k}
      JOIN kpf pb ON pb.mi = b.mi AND pb.person = b.person LEFT JOIN kpf pc ON pc.mi = b.mi + {k} AND pc.person = b.person
      LEFT JOIN orgs o ON o.org = b.org LEFT JOIN po so ON so.mi = b.mi + {k} AND so.person = b.person AND so.org = b.org
      LEFT JOIN ph sh ON sh.mi = b.mi + {k} AND sh.person = b.person AND sh.hold = o.hold
      WHERE b.st = 'P' AND b.mi + {k} <= 29 AND coalesce(c.st, '') <> 'P')""", "tri", "kpf", "po", "ph", "orgs")
    cte(f"lin_{tag}", "SELECT mi, org, unit, " + ", ".join(f"count(*) FILTER (WHERE lab = '{x}') AS {x}" for x in sm.IN_LABELS)
        + """, sum(fl) AS fl_in, CAST(sum(in_new) AS BIGINT) AS in_person_new, sum(in_conc) AS in_conc,
        CAST(coalesce(sum(in_temp) FILTER (WHERE lab IN ('in_new_bank', 'in_returned')), 0) AS BIGINT) AS in_temp_outside FROM min_""" + tag + " GROUP BY 1, 2, 3", f"min_{tag}")
    cte(f"lout_{tag}", "SELECT mi, org, unit, " + ", ".join(f"count(*) FILTER (WHERE lab = '{x}') AS {x}" for x in sm.OUT_LABELS) + ", "
        + ", ".join(f"count(*) FILTER (WHERE ten = '{x}') AS out_ten_{x}" for x in sm.TENURES)
        + """, sum(fl) AS fl_out, CAST(sum(out_gone) AS BIGINT) AS out_person_gone, sum(out_conc) AS out_conc, CAST(sum(out_temp) AS BIGINT) AS out_temp,
        CAST(coalesce(sum(out_temp) FILTER (WHERE lab LIKE 'lb_%'), 0) AS BIGINT) AS out_temp_left FROM mout_""" + tag + " GROUP BY 1, 2, 3", f"mout_{tag}")

_FLIP = ("(SELECT count(*) FROM tri a JOIN tri b ON b.person = a.person AND b.org = a.org AND b.unit = a.unit AND b.mi = a.mi - 1 "
         "WHERE a.person = c.person AND a.org = c.org AND a.unit = c.unit AND a.mi BETWEEN c.mi - 11 AND c.mi AND (a.st = 'N') <> (b.st = 'N'))")
cte("stk", f"""
 SELECT mi, org, unit, min(region) AS region, count(*) FILTER (WHERE p) AS pf_recip, coalesce(sum(1.0 / k) FILTER (WHERE p), 0) AS pf_fl,
   sum(pf_amt) AS pf_amt, sum(fot_amt) AS fot_amt, count(*) FILTER (WHERE st = 'Z') AS zp_out_recip, count(*) FILTER (WHERE st = 'N') AS nonzp_recip,
   count(*) AS any_recip, CAST(sum(n_rows) AS BIGINT) AS raw_rows, count(*) FILTER (WHERE p AND n_pay = 1) AS single_pay_recip,
   count(*) FILTER (WHERE p AND k > 1) AS multi_recip, count(*) FILTER (WHERE p AND k > 1 AND npo > 1) AS multi_same_org,
   count(*) FILTER (WHERE p AND k > 1 AND npo = 1 AND nph > npo) AS multi_same_hold,
   count(*) FILTER (WHERE p AND k > 1 AND npo = 1 AND (nph IS NULL OR nph = npo)) AS multi_other,
   count(*) FILTER (WHERE mi >= 11 AND flips >= 3) AS flapping_recip, count(*) FILTER (WHERE p AND once_t) AS one_time_pf,
   count(*) FILTER (WHERE p AND once_p) AS one_time_person, count(*) FILTER (WHERE p AND ten = 'lt3') AS ten_lt3,
   count(*) FILTER (WHERE p AND ten = '3_12') AS ten_3_12, count(*) FILTER (WHERE p AND ten = '12p') AS ten_12p
 FROM (SELECT c.*, c.st = 'P' AS p, pc.k, po.n AS npo, ph.n AS nph, {_FLIP} AS flips, {_once('c', 'c.mi')} AS once_t,
    {_once('c', 'c.mi', True)} AS once_p, {_ten('c', 'c.mi')} AS ten
  FROM tri c LEFT JOIN kpf pc ON pc.mi = c.mi AND pc.person = c.person LEFT JOIN po ON po.mi = c.mi AND po.person = c.person AND po.org = c.org
  LEFT JOIN orgs o ON o.org = c.org LEFT JOIN ph ON ph.mi = c.mi AND ph.person = c.person AND ph.hold = o.hold) GROUP BY 1, 2, 3""",
    "tri", "kpf", "po", "ph", "orgs")
cte("skeys", """SELECT mi, org, unit FROM stk UNION SELECT mi + 1, org, unit FROM stk WHERE pf_recip > 0 AND mi + 1 <= 29
 UNION SELECT mi + 12, org, unit FROM stk WHERE pf_recip > 0 AND mi + 12 <= 29""", "stk")
cte("kseg", f"""
 SELECT k.*, coalesce(h.seg, ho.seg, o.seg, 'not found') AS seg_rep, coalesce(cp.seg, co.seg, o.seg, 'not found') AS seg_cur,
  CASE WHEN h.seg IS NOT NULL THEN 'history' WHEN ho.seg IS NOT NULL THEN 'org history' WHEN o.seg IS NOT NULL THEN 'dimension' ELSE 'none' END AS seg_src
 FROM skeys k LEFT JOIN seghist h USING (mi, org, unit) LEFT JOIN (SELECT mi, org, min(seg) AS seg FROM seghist GROUP BY 1, 2) ho ON ho.mi = k.mi AND ho.org = k.org
 LEFT JOIN seghist cp ON cp.mi = {CUR} AND cp.org = k.org AND cp.unit = k.unit
 LEFT JOIN (SELECT org, min(seg) AS seg FROM seghist WHERE mi = {CUR} GROUP BY 1) co ON co.org = k.org LEFT JOIN orgs o ON o.org = k.org""", "skeys", "seghist", "orgs")


def _summary_sql() -> str:
    sel = ["k.mi", "k.org", "k.unit", "k.seg_rep", "k.seg_cur", "k.seg_src", "coalesce(s.region, sm.region, sy.region) AS region"]
    for c in sm.STOCKS:
        e = f"coalesce(s.{c}, 0)"
        if c.startswith(("ten_", "one_time")):
            e = f"CASE WHEN k.mi >= 12 THEN {e} END"
        elif c == "flapping_recip":
            e = f"CASE WHEN k.mi >= {CMP0 + 12} THEN {e} END"
        sel.append(f"{e} AS {c}")
    sel.append("k.mi + 2 > 29 AS prelim")
    for t, n in (("m", 1), ("y", 12)):
        on, mem = f"k.mi - {n} >= {CMP0}", f"k.mi - {n} >= {CMP0} AND k.mi - {n} - 12 >= 0"
        i, o = (lambda x: f"coalesce(i{t}.{x}, 0)"), (lambda x: f"coalesce(o{t}.{x}, 0)")
        sp = {"base_pf": f"coalesce(s{t}.pf_recip, 0)", "base_seg": f"k{t}.seg_rep", "in_from_outside": f"{i('in_new_bank')} + {i('in_returned')}",
              "in_from_other_org": f"{i('in_oth_same_org')} + {i('in_oth_same_hold')} + {i('in_oth_other')}",
              "out_left_bank": " + ".join(o(x) for x in sm.OUT_LABELS if x.startswith("lb_")),
              "out_to_other_org": f"{o('out_oth_same_org')} + {o('out_oth_same_hold')} + {o('out_oth_other')}",
              "fl_conc": f"(coalesce(s.pf_fl, 0) - coalesce(s{t}.pf_fl, 0)) - {i('fl_in')} + {o('fl_out')}"}
        for c in sm.base_columns(t):
            side = i if c.startswith("in_") or c == "fl_in" else o
            needs = c in ("in_new_bank", "in_returned") or c.startswith("lb_")
            sel.append(f"CASE WHEN {mem if needs else on} THEN {sp.get(c) or side(c)} END AS {t}_{c}")
    sel += [f"CASE WHEN k.mi - 1 >= {CMP0} AND k.mi + 1 <= 29 THEN coalesce(om.{x}, 0) END AS m_{x}" for x in ("out_temp", "out_temp_left")]
    sel.append(f"CASE WHEN k.mi - 2 >= {CMP0} THEN coalesce(im.in_temp_outside, 0) END AS m_in_temp_outside")
    sel += [f"CASE WHEN k.mi - 1 >= {CMP0} AND k.mi - 13 >= 0 THEN coalesce(om.out_ten_{t}, 0) END AS m_out_ten_{t}" for t in sm.TENURES]
    j = " LEFT JOIN stk s ON s.mi = k.mi AND s.org = k.org AND s.unit = k.unit"
    for t, n in (("m", 1), ("y", 12)):
        for a, src, mi in ((f"s{t}", "stk", f"k.mi - {n}"), (f"k{t}", "kseg", f"k.mi - {n}"), (f"i{t}", f"lin_{t}", "k.mi"), (f"o{t}", f"lout_{t}", "k.mi")):
            j += f" LEFT JOIN {src} {a} ON {a}.mi = {mi} AND {a}.org = k.org AND {a}.unit = k.unit"
    return "SELECT " + ", ".join(sel) + " FROM kseg k" + j


cte("summ", _summary_sql(), "stk", "kseg", "lin_m", "lin_y", "lout_m", "lout_y")
FLOATS = ("pf_fl", "pf_amt", "fot_amt", "m_fl_in", "m_fl_out", "m_fl_conc", "m_in_conc", "m_out_conc", "y_fl_in", "y_fl_out", "y_fl_conc", "y_in_conc", "y_out_conc")


def _round(cols) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 4) + 0.0 AS {c}" for c in cols)


class Monthly:
    def __init__(self, i):
        self.i, self.masks = i, sm.triple_masks(i.triples)
        self.stocks = sm.stock(i.triples, self.masks, i.orgs)

    def ins(self, k):
        return sm.movement_in(self.masks, self.i.triples, self.i.orgs, k, LAST)

    def outs(self, k):
        return sm.movement_out(self.masks, self.i.triples, self.i.orgs, k, LAST)


def summary_frame(i):
    return sm.build_summary(i.triples, i.orgs, i.seg_history, LAST, CMP0, CUR, stage=f"summary-{uuid4().hex}")


@query("history_masks", """
 SELECT person, org, unit, CAST(sum(1 << mi) AS BIGINT) AS b_any, CAST(coalesce(sum(1 << mi) FILTER (WHERE st = 'P'), 0) AS BIGINT) AS b_p,
   CAST(coalesce(sum(1 << mi) FILTER (WHERE st = 'N'), 0) AS BIGINT) AS b_n FROM (SELECT * REPLACE (CAST(mi AS BIGINT) AS mi) FROM tri) GROUP BY 1, 2, 3""", "tri")
def _(i):
    return sm.triple_masks(i.triples)


@query("mask_probes", f"""
 SELECT person, org, unit, CASE WHEN {_has('c', '15')} THEN 1 ELSE 0 END AS bit15, {_between('c', '5', '9', "h.st = 'P'")} AS any_5_9,
   {_ten('c', '20')} AS tenure20, {_once('c', '14')} AS once14, {_FLIP.replace('c.mi', '28')} >= 3 AS flapping28
 FROM (SELECT DISTINCT person, org, unit FROM tri) c""", "tri")
def _(i):
    a, p, n = F.col("b_any"), F.col("b_p"), F.col("b_n")
    at = F.lit
    return sm.triple_masks(i.triples).select("person", "org", "unit", mk.mask_bit(a, 15).alias("bit15"), mk.any_in(p, at(5), at(9)).alias("any_5_9"),
                                             mk.tenure_band(p, at(20)).alias("tenure20"), mk.one_time(a, at(14)).alias("once14"),
                                             mk.flapping(a, n, at(28)).alias("flapping28"))


@query("stock", f"SELECT * EXCLUDE (pf_fl, pf_amt, fot_amt), {_round(('pf_fl', 'pf_amt', 'fot_amt'))} FROM stk", "stk")
def _(i):
    return Monthly(i).stocks


for _t, _k in (("m", 1), ("y", 12)):
    _name = {"m": "month", "y": "year"}[_t]

    @query(f"movement_in_{_name}", f"""SELECT mi, person, org, unit, lab, round(fl, 4) AS fl, CAST(in_new AS BIGINT) AS in_new, round(in_conc, 4) AS in_conc,
      CAST(in_temp AS BIGINT) AS in_temp FROM min_{_t}""", f"min_{_t}")
    def _(i, k=_k):
        return Monthly(i).ins(k)

    @query(f"movement_out_{_name}", f"""SELECT mi, person, org, unit, lab, round(fl, 4) AS fl, CAST(out_gone AS BIGINT) AS out_gone,
      round(out_conc, 4) AS out_conc, CAST(out_temp AS BIGINT) AS out_temp, ten FROM mout_{_t}""", f"mout_{_t}")
    def _(i, k=_k):
        return Monthly(i).outs(k)

    @query(f"label_counts_in_{_name}", f"SELECT * REPLACE (round(fl_in, 4) AS fl_in, round(in_conc, 4) AS in_conc) FROM lin_{_t}", f"lin_{_t}")
    def _(i, k=_k):
        return sm.label_counts_in(Monthly(i).ins(k))

    @query(f"label_counts_out_{_name}", f"SELECT * REPLACE (round(fl_out, 4) AS fl_out, round(out_conc, 4) AS out_conc) FROM lout_{_t}", f"lout_{_t}")
    def _(i, k=_k):
        return sm.label_counts_out(Monthly(i).outs(k))


@query("summary_keys", "SELECT * FROM skeys", "skeys")
def _(i):
    return sm.summary_keys(Monthly(i).stocks, LAST)


@query("segment_asof", "SELECT * FROM kseg", "kseg")
def _(i):
    return sm.segment_asof(sm.summary_keys(Monthly(i).stocks, LAST), i.seg_history, i.orgs, CUR)


cte("segcov", """SELECT mi, CAST(sum(pf_recip) AS BIGINT) AS pf, CAST(coalesce(sum(pf_recip) FILTER (WHERE h.seg IS NOT NULL), 0) AS BIGINT) AS pf_hist
 FROM stk LEFT JOIN seghist h USING (mi, org, unit) GROUP BY 1""", "stk", "seghist")


@query("segment_coverage", "SELECT * FROM segcov", "segcov")
def _(i):
    return sm.segment_coverage(Monthly(i).stocks, i.seg_history)


@query("current_segment_period", """SELECT max(mi) AS mi FROM segcov WHERE pf > 0 AND pf_hist / pf >= 0.9 * (SELECT median(pf_hist / pf) FROM segcov WHERE pf > 0)""", "segcov")
def _(i):
    return sm.current_segment_period(sm.segment_coverage(Monthly(i).stocks, i.seg_history))


@query("month_summary", f"SELECT * EXCLUDE ({', '.join(FLOATS)}), {_round(FLOATS)} FROM summ", "summ")
def _(i):
    return summary_frame(i)


@query("flow_pairs", f"""
 SELECT d.mi, d.org AS from_org, d.unit AS from_unit, a.org AS to_org, a.unit AS to_unit, count(*) AS n_recip FROM mout_m d JOIN min_m a USING (mi, person)
 WHERE d.lab LIKE 'out_oth%' AND a.lab LIKE 'in_oth%' AND d.mi - 1 >= {CMP0} GROUP BY ALL HAVING count(*) >= 2""", ("mout_m", "min_m"))
def _(i):
    m = Monthly(i)
    return sm.flow_pairs(m.outs(1), m.ins(1), CMP0, 2)


@query("identity_checks", """SELECT unnest(['any_is_sum_of_states','multi_parts','tenure_parts','multi_within_stock','persons_within_stock',
 'm_stock','m_outside_parts','m_other_in_parts','m_other_out_parts','m_left_parts','m_left_within_base',
 'y_stock','y_outside_parts','y_other_in_parts','y_other_out_parts','y_left_parts','y_left_within_base','m_tenure_of_leavers','m_temp_within_out']) AS "check",
 CAST(0 AS BIGINT) AS n_bad""")
def _(i):
    return sm.identity_checks(i.summary)


def _gen_sql(keys: str, lvl: str, org: str, where: str = "") -> str:
    floats = ("pf_fl", "fot_amt", "m_fl_in", "m_fl_out", "m_fl_conc", "y_fl_conc")
    meas = ", ".join((f"round(CAST(sum({' + '.join(c)}) AS DOUBLE), 4) + 0.0 AS {m}" if m in floats else f"CAST(sum({' + '.join(c)}) AS BIGINT) AS {m}")
                     for m, c in sm.GENERATION.items())
    return f"SELECT mi, seg_rep, region, unit, {meas}, '{lvl}' AS lvl, {org} AS org, CAST(7 AS BIGINT) AS run_id FROM summ {where} GROUP BY {keys}"


@query("generation", _gen_sql("mi, seg_rep, region, unit", "atom", "CAST(NULL AS VARCHAR)") + " UNION ALL "
       + _gen_sql("mi, seg_rep, region, unit, org", "org", "org", "WHERE org IN ('view', 'purchase')"), "summ")
def _(i):
    return sm.generation(i.summary, 7, i.orgs.where(F.col("org").isin("view", "purchase")))


cte("placed", "SELECT t.mi, t.person, t.region, k.seg_rep, k.seg_cur FROM tri t JOIN kseg k USING (mi, org, unit) WHERE st = 'P'", "tri", "kseg")
_J = """
 SELECT {mi} AS mi, '{t}' AS slice_type, {v} AS slice_value, CAST(sum(pf_recip) AS BIGINT) AS pf_recip, CAST(sum(any_recip) AS BIGINT) AS any_recip,
   CAST(sum(raw_rows) AS BIGINT) AS raw_rows, CAST(sum(fot_amt) AS DOUBLE) AS fot_amt FROM summ GROUP BY 1, 2, 3"""
_JS = {"bank": "'bank'", "region": "CAST(region AS VARCHAR)", "seg_rep": "seg_rep", "seg_cur": "seg_cur"}


@query("journal", "WITH r AS (" + " UNION ALL ".join(_J.format(mi="mi", t=t, v=v) for t, v in _JS.items()) + "), p AS ("
       + " UNION ALL ".join(f"SELECT mi, '{t}' AS slice_type, {v.replace('region', 'c.region') if t == 'region' else v} AS slice_value, count(DISTINCT person) AS persons FROM placed c GROUP BY 1, 2, 3" for t, v in _JS.items())
       + """) SELECT CAST(7 AS BIGINT) AS run_id, r.mi, r.slice_type, r.slice_value, pf_recip, persons, any_recip, raw_rows, fot_amt, true AS checks_ok
       FROM r LEFT JOIN p ON p.mi = r.mi AND p.slice_type = r.slice_type AND p.slice_value = r.slice_value""", ("summ", "placed"))
def _(i):
    return sm.journal(i.summary, i.triples, 7, True)




@query("revisions", """WITH n AS (SELECT mi, CAST(sum(pf_recip) AS BIGINT) AS pf_now FROM stk GROUP BY 1)
 SELECT mi, pf_now, pf_now - mi % 3 AS pf_before, mi % 3 AS change FROM n WHERE mi % 3 <> 0""", "stk")
def _(i):
    s = Monthly(i).stocks
    old = s.groupBy("mi").agg((F.sum("pf_recip") - F.col("mi") % 3).alias("pf_recip")).select(
        "mi", "pf_recip", F.lit("bank").alias("slice_type"), F.lit(True).alias("checks_ok"), F.lit(4).alias("run_id"))
    return sm.revisions(s, old.unionByName(old.withColumn("run_id", F.lit(9)).withColumn("checks_ok", F.lit(False))))


_UL = """WITH r AS (SELECT mi, region, sum(raw_rows) AS v FROM stk GROUP BY 1, 2), a AS (SELECT mi, sum(v) AS a FROM r GROUP BY 1),
 x AS (SELECT r.mi, r.region, r.v / p.v AS ratio, a.a / b.a AS bank_ratio FROM r JOIN r p ON p.mi = r.mi - 1 AND p.region = r.region
  JOIN a ON a.mi = r.mi JOIN a b ON b.mi = r.mi - 1)"""


@query("underload_regions", _UL + " SELECT mi, region, round(ratio, 4) AS ratio, round(bank_ratio, 4) AS bank_ratio FROM x WHERE ratio < 0.97 * bank_ratio", "stk")
def _(i):
    return sm.underload_regions(Monthly(i).stocks, 0.97)


@query("underload_regions_year", _UL + """ SELECT x.mi, x.region, round(x.ratio, 4) AS ratio, round(x.bank_ratio, 4) AS bank_ratio, round(y.ratio, 4) AS ratio_year
 FROM x JOIN x y ON y.mi = x.mi - 12 AND y.region = x.region WHERE x.ratio < 0.97 * x.bank_ratio AND x.ratio < 0.97 * y.ratio""", "stk")
def _(i):
    return sm.underload_regions(Monthly(i).stocks, 0.97, lag_year=12)


@query("tie_out", """WITH a AS (SELECT mi, CAST(sum(pf_recip) AS BIGINT) AS v FROM stk GROUP BY 1), b AS (SELECT mi, count(*) AS v FROM rec GROUP BY 1)
 SELECT mi, a.v AS a, b.v AS b, a.v - b.v AS diff, a.v = b.v AS ok FROM a JOIN b USING (mi)""", ("stk", "rec"))
def _(i):
    return sm.tie_out(Monthly(i).stocks.groupBy("mi").agg(F.sum("pf_recip").alias("v")), i.recipients.groupBy("mi").agg(F.count(F.lit(1)).alias("v")), "v", 0.0)
