"""Queries over the movement between two periods (base 20 → current 21, a year ago 8 → 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moves as mv
from .inputs import THRESHOLD
from .registry import cte, query

B, C, YB, YC = 20, 21, 8, 9
LOADED = frozenset(range(30))
SEG = "retail"


def _gone(p: str) -> str:
    return (f"CASE WHEN coalesce({p}.amt_all, 0) <= 0 THEN 'left_bank' WHEN {p}.amt_codes > 0 THEN 'below_threshold' "
            f"ELSE 'other_codes' END")


def _come(p: str) -> str:
    return (f"CASE WHEN coalesce({p}.amt_all, 0) <= 0 THEN 'new_to_bank' WHEN {p}.amt_codes > 0 THEN 'above_threshold' "
            f"ELSE 'back_to_codes' END")


def flow_stages(tag: str, b: int, c: int, w: str = "") -> None:
    """SQL stages of one transition, as plain anti and outer joins."""
    rec, pm, pres, lines, orgs = (x + w for x in ("rec", "pm", "presence", "lines", "orgs"))
    cte(f"lg{tag}", f"""
     SELECT 'lost' AS side, * FROM {rec} x WHERE mi = {b} AND NOT EXISTS (SELECT 1 FROM {rec} y WHERE y.mi = {c}
       AND y.person = x.person AND y.org = x.org AND y.unit = x.unit)
     UNION ALL SELECT 'gained', * FROM {rec} x WHERE mi = {c} AND NOT EXISTS (SELECT 1 FROM {rec} y WHERE y.mi = {b}
       AND y.person = x.person AND y.org = x.org AND y.unit = x.unit)""", rec)
    ten = "CASE WHEN e1.person IS NULL THEN 'new1' WHEN e2.person IS NULL THEN 'new2' ELSE 'old' END"
    cte(f"fl{tag}", f"""
     SELECT coalesce(b.main_seg, 'outside') AS seg_from, coalesce(c.main_seg, 'outside') AS seg_to,
       CASE WHEN b.person IS NULL THEN {_come('pb')} WHEN c.person IS NULL THEN {_gone('pc')} ELSE 'stay' END AS cause,
       CASE WHEN b.person IS NOT NULL THEN {ten} END AS tenure,
       CASE WHEN b.person IS NULL THEN CASE WHEN e1.person IS NULL THEN 0 ELSE 1 END END AS was_before,
       CASE WHEN n1.person IS NULL THEN 0 ELSE 1 END AS in_next, b.n_triples AS tr_b, c.n_triples AS tr_c, b.n_org AS org_b, c.n_org AS org_c
     FROM (SELECT * FROM {pm} WHERE mi = {b}) b FULL JOIN (SELECT * FROM {pm} WHERE mi = {c}) c ON b.person = c.person
     LEFT JOIN {pres} pb ON pb.mi = {b} AND pb.person = coalesce(b.person, c.person)
     LEFT JOIN {pres} pc ON pc.mi = {c} AND pc.person = coalesce(b.person, c.person)
     LEFT JOIN {pm} e1 ON e1.mi = {b - 1} AND e1.person = coalesce(b.person, c.person)
     LEFT JOIN {pm} e2 ON e2.mi = {b - 2} AND e2.person = coalesce(b.person, c.person)
     LEFT JOIN {pm} n1 ON n1.mi = {c + 1} AND n1.person = coalesce(b.person, c.person)""", pm, pres)
    for kind, same, label in (("tf", "s.seg = f.seg", "other_seg"), ("ff", "s.focus", "other_org")):
        cte(f"{kind}{tag}", f"""
         SELECT f.side, f.seg, f.person, f.focus,
           CASE WHEN EXISTS (SELECT 1 FROM {rec} s WHERE s.person = f.person AND {same} AND s.mi = CASE WHEN f.side = 'lost' THEN {c} ELSE {b} END)
                THEN 'inside'
                WHEN EXISTS (SELECT 1 FROM {pm} s WHERE s.person = f.person AND s.mi = CASE WHEN f.side = 'lost' THEN {c} ELSE {b} END)
                THEN '{label}' WHEN f.side = 'lost' THEN {_gone('ps')} ELSE {_come('ps')} END AS cause,
           CASE WHEN f.side = 'lost' THEN {ten} END AS tenure, CASE WHEN n1.person IS NULL THEN 0 ELSE 1 END AS in_next
         FROM lg{tag} f LEFT JOIN {pres} ps ON ps.person = f.person AND ps.mi = CASE WHEN f.side = 'lost' THEN {c} ELSE {b} END
         LEFT JOIN {pm} e1 ON e1.mi = {b - 1} AND e1.person = f.person LEFT JOIN {pm} e2 ON e2.mi = {b - 2} AND e2.person = f.person
         LEFT JOIN {pm} n1 ON n1.mi = {c + 1} AND n1.person = f.person""", f"lg{tag}", rec, pm, pres)
    cte(f"sg{tag}", f"""
     WITH seen AS (SELECT l.mi, l.person, bool_or(amt > 0) AS seen, sum(amt) FILTER (WHERE o.seg = '{SEG}') AS all_s,
            sum(amt) FILTER (WHERE o.seg = '{SEG}' AND code <= 2) AS codes_s
          FROM {lines} l LEFT JOIN {orgs} o USING (org) WHERE mi IN ({b}, {c}) GROUP BY 1, 2)
     SELECT f.*, CASE WHEN f.side = 'lost' THEN
         CASE WHEN EXISTS (SELECT 1 FROM {rec} r WHERE r.mi = {c} AND r.person = f.person AND r.seg = '{SEG}') THEN 'stayed_in_segment'
              WHEN NOT coalesce(s.seen, false) THEN 'left_bank' WHEN s.codes_s > 0 THEN 'below_threshold'
              WHEN s.all_s > 0 THEN 'other_codes' ELSE 'left_segment' END
       ELSE CASE WHEN EXISTS (SELECT 1 FROM {rec} r WHERE r.mi = {b} AND r.person = f.person AND r.seg = '{SEG}') THEN 'stayed_in_segment'
              WHEN NOT coalesce(s.seen, false) THEN 'new_to_bank' WHEN s.codes_s > 0 THEN 'above_threshold'
              WHEN s.all_s > 0 THEN 'back_to_codes' ELSE 'from_segment' END END AS cause
     FROM lg{tag} f LEFT JOIN seen s ON s.person = f.person AND s.mi = CASE WHEN f.side = 'lost' THEN {c} ELSE {b} END
     WHERE f.seg = '{SEG}'""", f"lg{tag}", rec, lines, orgs)
    cte(f"sp{tag}", f"SELECT DISTINCT side, person, cause FROM sg{tag} WHERE cause <> 'stayed_in_segment'", f"sg{tag}")


flow_stages("", B, C)
flow_stages("_y", YB, YC)
flow_stages("_w", B, C, "_w")


class Flow:
    """The Spark side of one transition."""

    def __init__(self, ledger, b: int = B, c: int = C):
        self.l, self.b, self.c = ledger, b, c
        self.panel = mv.person_panel(ledger.recipients, ledger.person_month, ledger.presence, b, c)
        self.status = mv.segment_status(ledger.lines, ledger.orgs, ledger.recipients, SEG, b, c)
        self.moves = mv.segment_moves(ledger.recipients, self.status, SEG, b, c)
        self.persons = mv.segment_person_moves(self.status)


def flow(i, tag: str = "") -> Flow:
    return Flow(i.wide if tag == "_w" else i.main, *((YB, YC) if tag == "_y" else (B, C)))


@query("lost_gained", "SELECT side, person, org, unit, seg FROM lg", "lg")
def _(i):
    return mv.lost_gained(i.recipients, B, C, mv.TRIPLE, ("seg",))


@query("lost_gained_pairs", f"""
 WITH p AS (SELECT DISTINCT mi, person, org FROM rec WHERE mi IN ({B}, {C}))
 SELECT CASE WHEN min(mi) = {B} THEN 'lost' ELSE 'gained' END AS side, person, org FROM p GROUP BY person, org HAVING count(*) = 1""", "rec")
def _(i):
    return mv.lost_gained(i.recipients, B, C, ("person", "org"))


@query("lost_gained_persons", f"""
 WITH p AS (SELECT DISTINCT mi, person FROM rec WHERE mi IN ({B}, {C}))
 SELECT CASE WHEN min(mi) = {B} THEN 'lost' ELSE 'gained' END AS side, person FROM p GROUP BY person HAVING count(*) = 1""", "rec")
def _(i):
    return mv.lost_gained(i.recipients, B, C, ("person",))


_CAUSES = """
 SELECT side, cause, count(*) AS n_triples, count(DISTINCT person) AS n_persons, CAST(sum(pf_amt) AS DOUBLE) AS amt FROM sg
 WHERE side = '{s}' GROUP BY 1, 2"""


@query("loss_causes", _CAUSES.format(s="lost"), "sg")
def _(i):
    return mv.cause_totals(flow(i).moves, amount="pf_amt").where("side = 'lost'")


@query("gain_causes", _CAUSES.format(s="gained"), "sg")
def _(i):
    return mv.cause_totals(flow(i).moves, amount="pf_amt").where("side = 'gained'")


@query("loss_causes_by_org", """
 SELECT org, side, cause, count(*) AS n_triples, count(DISTINCT person) AS n_persons FROM sg_w GROUP BY 1, 2, 3""", "sg_w")
def _(i):
    return mv.cause_totals(flow(i, "_w").moves, ("org", "side", "cause"))


@query("person_causes", "SELECT side, cause, count(*) AS n_persons FROM sp GROUP BY 1, 2", "sp")
def _(i):
    return flow(i).persons.groupBy("side", "cause").agg(F.count(F.lit(1)).alias("n_persons"))


_FL = """
 SELECT seg_from, seg_to, cause, tenure, was_before, in_next, count(*) AS n_persons, CAST(coalesce(sum(tr_b),0) AS BIGINT) AS tr_b,
   CAST(coalesce(sum(tr_c),0) AS BIGINT) AS tr_c, CAST(coalesce(sum(org_b),0) AS BIGINT) AS org_b, CAST(coalesce(sum(org_c),0) AS BIGINT) AS org_c
 FROM {} GROUP BY ALL"""


@query("person_flow", _FL.format("fl"), "fl")
def _(i):
    return mv.person_flow(flow(i).panel, B, C, LOADED)


@query("person_flow_year_ago", _FL.format("fl_y"), "fl_y")
def _(i):
    return mv.person_flow(flow(i, "_y").panel, YB, YC, LOADED)


@query("triple_flow", """
 SELECT side, seg, cause, tenure, in_next, count(*) AS n_triples, count(DISTINCT person) AS n_persons FROM tf GROUP BY ALL""", "tf")
def _(i):
    return mv.triple_flow(i.recipients, flow(i).panel, B, C, LOADED)


@query("focus_flow", """
 SELECT side, cause, tenure, in_next, count(*) AS n_triples, count(DISTINCT person) AS n_persons FROM ff WHERE focus GROUP BY ALL""", "ff")
def _(i):
    return mv.triple_flow(i.recipients, flow(i).panel, B, C, LOADED, focus_only=True)


@query("focus_totals", """
 SELECT mi, count(*) AS n_triples, count(DISTINCT person || '/' || org) AS n_pairs, count(DISTINCT person) AS n_persons,
   count(DISTINCT org) AS n_orgs FROM rec WHERE focus GROUP BY 1""", "rec")
def _(i):
    return mv.focus_totals(i.recipients)


@query("stop_size", f"""
 WITH s AS (SELECT org, person, min(seg) AS seg, bool_or(focus) AS focus, count(*) AS n_tr FROM lg_w WHERE side = 'lost'
   AND person NOT IN (SELECT person FROM pm_w WHERE mi = {C}) GROUP BY 1, 2),
 o AS (SELECT org, min(seg) AS seg, bool_or(focus) AS focus, count(*) AS n, sum(n_tr) AS n_tr FROM s GROUP BY 1)
 SELECT seg, focus, CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n < 10 THEN '3-9' WHEN n < 50 THEN '10-49' ELSE '50+' END AS bucket,
   count(*) AS n_orgs, CAST(sum(n) AS BIGINT) AS n_persons, CAST(sum(n_tr) AS BIGINT) AS n_triples,
   CASE WHEN min(n) <= 2 THEN 'individual' ELSE 'corporate' END AS kind FROM o GROUP BY 1, 2, 3""", ("lg_w", "pm_w"))
def _(i):
    return mv.stop_size(i.wide.recipients, flow(i, "_w").panel, B, C)


@query("org_migration", f"""
 WITH h AS (SELECT DISTINCT mi, person, org FROM rec_w WHERE mi IN ({B}, {C})),
 lost AS (SELECT person, org FROM h WHERE mi = {B} EXCEPT SELECT person, org FROM h WHERE mi = {C}),
 seen AS (SELECT DISTINCT person, org FROM lines_w WHERE mi = {C} AND amt > 0 EXCEPT SELECT person, org FROM h WHERE mi = {B}),
 m AS (SELECT l.org AS org_from, s.org AS org_to, count(*) AS n_persons FROM lost l JOIN seen s USING (person) GROUP BY 1, 2 HAVING count(*) >= 2),
 n AS (SELECT org AS org_from, count(*) AS n_lost FROM lost GROUP BY 1)
 SELECT *, round(n_persons / n_lost, 4) AS share, n_persons / n_lost >= 0.3 AS is_reorg FROM m JOIN n USING (org_from)""", ("rec_w", "lines_w"))
def _(i):
    return mv.org_migration(i.wide.recipients, i.wide.lines, B, C, 2)


@query("successor_orgs", f"""
 WITH h AS (SELECT DISTINCT mi, person, org FROM rec_w WHERE mi IN ({B}, {C})),
 lost AS (SELECT person, org FROM h WHERE mi = {B} EXCEPT SELECT person, org FROM h WHERE mi = {C}),
 m AS (SELECT l.org AS org_from, s.org AS org_to, count(*) AS n_moved FROM lost l JOIN h s ON s.person = l.person AND s.mi = {C} GROUP BY 1, 2),
 n AS (SELECT org AS org_from, count(*) AS n_left FROM lost GROUP BY 1)
 SELECT m.*, n_left FROM m JOIN n USING (org_from) WHERE n_moved >= 2 AND n_moved >= 0.3 * n_left""", "rec_w")
def _(i):
    return mv.successor_orgs(i.wide.recipients, B, C, 2, 0.3)


@query("leaver_segments", f"""
 SELECT coalesce(o.seg, 'not in dimension') AS seg, count(DISTINCT person) AS n_persons FROM lines l LEFT JOIN orgs o USING (org)
 WHERE mi = {C} AND amt > 0 AND person IN (SELECT person FROM sp WHERE side = 'lost' AND cause = 'left_segment') GROUP BY 1""", ("lines", "orgs", "sp"))
def _(i):
    return mv.leaver_segments(i.lines, i.orgs, flow(i).persons, C)


@query("leaver_orgs", f"""
 WITH d AS (SELECT person, org, unit, row_number() OVER (PARTITION BY person ORDER BY sum(amt) DESC, org, unit) AS rn
   FROM lines_w JOIN orgs_w o USING (org) WHERE mi = {C} AND o.seg <> '{SEG}'
     AND person IN (SELECT person FROM sp_w WHERE side = 'lost' AND cause = 'left_segment') GROUP BY person, org, unit),
 g AS (SELECT org, count(*) AS n_persons, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM rec_w r WHERE r.mi = {B} AND r.seg = '{SEG}'
    AND r.person = d.person AND r.unit = d.unit)) AS n_same_unit FROM d WHERE rn = 1 GROUP BY 1)
 SELECT *, CAST((SELECT sum(n_persons) FROM g) AS BIGINT) AS total,
   round((SELECT sum(n_persons) FROM (SELECT * FROM g ORDER BY n_persons DESC, org LIMIT 10)) / (SELECT sum(n_persons) FROM g), 4) AS top10_share
 FROM g ORDER BY n_persons DESC, org LIMIT 10""", ("lines_w", "orgs_w", "sp_w", "rec_w"))
def _(i):
    f = flow(i, "_w")
    return mv.leaver_orgs(i.wide.lines, i.wide.orgs, i.wide.recipients, f.persons, SEG, B, C)


_REPL = f"""
 WITH g AS (SELECT code, org, count(DISTINCT person) AS n_persons, sum(amt) AS amt FROM lines_w JOIN orgs_w o USING (org)
   WHERE mi = {C} AND code > 2 AND o.seg = '{SEG}' AND person IN (SELECT person FROM sp_w WHERE side = 'lost' AND cause = 'other_codes') GROUP BY 1, 2)"""


@query("replacement_codes", _REPL + " SELECT code, org, n_persons, CAST(amt AS DOUBLE) AS amt FROM g", ("lines_w", "orgs_w", "sp_w"))
def _(i):
    return mv.replacement_codes(i.wide.lines, i.wide.orgs, flow(i, "_w").persons, SEG, C)


@query("replacement_codes_top_orgs", _REPL + """
 SELECT code, org, n_persons, CAST(amt AS DOUBLE) AS amt, row_number() OVER (PARTITION BY code ORDER BY n_persons DESC, org) AS rn FROM g
 QUALIFY rn <= 3""", ("lines_w", "orgs_w", "sp_w"))
def _(i):
    from ..operators.ranking import top_n_per_group
    g = mv.replacement_codes(i.wide.lines, i.wide.orgs, flow(i, "_w").persons, SEG, C)
    return top_n_per_group(g, ["code"], [F.desc("n_persons"), F.asc("org")], 3)


@query("stayed_split", f"""
 WITH d AS (SELECT *, count(*) OVER (PARTITION BY person) AS k FROM rec WHERE mi = {C} AND seg = '{SEG}')
 SELECT s.org, round(sum(1.0 / k), 4) AS n_triples, round(sum(CASE WHEN s.region = d.region THEN 1.0 / k ELSE 0 END), 4) AS same_region,
   round(sum(CASE WHEN s.hold IS NULL THEN CASE WHEN s.org = d.org THEN 1.0 / k ELSE 0 END WHEN s.hold = d.hold THEN 1.0 / k ELSE 0 END), 4) AS same_holding,
   round(sum(CASE WHEN s.unit = d.unit THEN 1.0 / k ELSE 0 END), 4) AS same_unit
 FROM sg s JOIN d USING (person) WHERE s.side = 'lost' AND s.cause = 'stayed_in_segment' GROUP BY 1""", ("rec", "sg"))
def _(i):
    return mv.stayed_split(flow(i).moves, i.recipients, i.orgs, SEG, C)


cte("situ", f"""
 SELECT s.side, s.person, s.org, s.unit, CASE
   WHEN EXISTS (SELECT 1 FROM rec_w r WHERE r.mi = o AND r.person = s.person AND r.org = s.org) THEN 'same_org'
   WHEN NOT EXISTS (SELECT 1 FROM rec_w r WHERE r.mi = o AND r.org = s.org) THEN 'org_stopped'
   WHEN coalesce((SELECT sum(amt) FROM lines_w l WHERE l.mi = o AND l.person = s.person AND l.org = s.org AND code <= 2), 0) > 0 THEN 'below'
   WHEN coalesce((SELECT sum(amt) FROM lines_w l WHERE l.mi = o AND l.person = s.person AND l.org = s.org), 0) > 0 THEN 'other_codes'
   ELSE 'no_pay' END AS situation
 FROM (SELECT *, CASE WHEN side = 'lost' THEN {C} ELSE {B} END AS o FROM sg_w WHERE cause = 'stayed_in_segment') s""", "sg_w", "rec_w", "lines_w")


@query("multi_job_situations", "SELECT side, situation, count(*) AS n_triples, count(DISTINCT person) AS n_persons FROM situ GROUP BY 1, 2", "situ")
def _(i):
    f = flow(i, "_w")
    s = mv.multi_job_situations(f.moves, i.wide.recipients, i.wide.lines, SEG, B, C)
    return mv.cause_totals(s, ("side", "situation"))


@query("stopped_org_targets", f"""
 WITH src AS (SELECT situation, org, count(*) AS n_triples FROM situ WHERE side = 'lost' AND situation IN ('org_stopped', 'no_pay') GROUP BY 1, 2),
 d AS (SELECT s.situation, s.org, r.org AS org_to, count(DISTINCT s.person) AS n_to,
    row_number() OVER (PARTITION BY s.situation, s.org ORDER BY count(DISTINCT s.person) DESC, r.org) AS rn
    FROM situ s JOIN rec_w r ON r.mi = {C} AND r.seg = '{SEG}' AND r.person = s.person WHERE s.side = 'lost' AND s.situation = 'org_stopped' GROUP BY 1, 2, 3)
 SELECT src.situation, src.org, n_triples, row_number() OVER (PARTITION BY src.situation ORDER BY n_triples DESC, src.org) AS pos, org_to, n_to
 FROM src LEFT JOIN d ON d.situation = src.situation AND d.org = src.org AND rn = 1 QUALIFY pos <= 5""", ("situ", "rec_w"))
def _(i):
    f = flow(i, "_w")
    s = mv.multi_job_situations(f.moves, i.wide.recipients, i.wide.lines, SEG, B, C)
    return mv.stopped_org_targets(s, i.wide.recipients, SEG, C, 5)


@query("season_confirmed", f"""
 SELECT p.main_seg AS seg, count(*) AS n_prev_both, count(*) FILTER (WHERE b.person IS NULL) AS n_gone_base,
   count(*) FILTER (WHERE c.person IS NULL) AS n_gone_cur, count(*) FILTER (WHERE b.person IS NULL AND c.person IS NULL) AS n_seasonal,
   count(*) FILTER (WHERE b.person IS NULL AND bn.person IS NOT NULL) AS n_back_base,
   count(*) FILTER (WHERE c.person IS NULL AND cn.person IS NOT NULL) AS n_back_cur
 FROM pm p JOIN pm q ON q.mi = {C - 1} AND q.person = p.person LEFT JOIN pm b ON b.mi = {YC} AND b.person = p.person
 LEFT JOIN pm c ON c.mi = {C} AND c.person = p.person LEFT JOIN pm bn ON bn.mi = {YC + 1} AND bn.person = p.person
 LEFT JOIN pm cn ON cn.mi = {C + 1} AND cn.person = p.person WHERE p.mi = {YC - 1} GROUP BY 1""", "pm")
def _(i):
    return mv.season_confirmed(i.person_month, YC, C)


@query("tenure_of_leavers", f"""
 WITH t AS (SELECT person, count(DISTINCT mi) AS k FROM rec WHERE mi <= {B} AND seg = '{SEG}' GROUP BY 1)
 SELECT cause, CASE WHEN k IS NULL THEN '0' WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 6 THEN '4-6' WHEN k <= 12 THEN '7-12'
   WHEN k <= 24 THEN '13-24' ELSE '25+' END AS bucket, count(*) AS n_persons FROM sp LEFT JOIN t USING (person) WHERE side = 'lost' GROUP BY 1, 2""", ("rec", "sp"))
def _(i):
    return mv.tenure_of_leavers(flow(i).persons, i.recipients, SEG, B)


@query("exit_pattern", f"""
 WITH m AS (SELECT person, mi, sum(amt) AS amt, sum(qty) AS qty FROM lines WHERE mi BETWEEN {B - 8} AND {C}
    AND person IN (SELECT person FROM sp WHERE side = 'lost' AND cause = 'left_bank') GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY mi DESC) AS k FROM m WHERE amt > 0),
 p AS (SELECT person, max(mi) AS last_mi, avg(amt) FILTER (WHERE k <= 2) AS a1, avg(amt) FILTER (WHERE k BETWEEN 3 AND 5) AS a0,
    avg(qty) FILTER (WHERE k <= 2) AS q1, avg(qty) FILTER (WHERE k BETWEEN 3 AND 5) AS q0 FROM r GROUP BY 1)
 SELECT CASE WHEN a0 IS NULL OR a0 <= 0 THEN 'short' WHEN a1 < 0.7 * a0 THEN 'amt' WHEN q1 < 0.7 * q0 THEN 'qty' ELSE 'abrupt' END AS pattern,
   last_mi, count(*) AS n_persons, round(sum(CASE WHEN a0 > 0 THEN a1 / a0 END), 4) AS sum_ratio, count(CASE WHEN a0 > 0 THEN 1 END) AS n_ratio
 FROM p GROUP BY 1, 2""", ("lines", "sp"))
def _(i):
    return mv.exit_pattern(flow(i).persons, i.lines, B - 8, C, 0.7)


@query("pay_level", f"""
 WITH b AS (SELECT *, avg(pf_amt) OVER (PARTITION BY org) AS m, count(*) OVER (PARTITION BY org) AS k FROM rec_w WHERE mi = {B} AND seg = '{SEG}')
 SELECT coalesce(l.cause, 'retained') AS fate, CAST(CASE WHEN b.pf_amt < 0.5 * m THEN 1 WHEN b.pf_amt < 0.8 * m THEN 2 WHEN b.pf_amt < 1.2 * m THEN 3
   WHEN b.pf_amt < 2.0 * m THEN 4 ELSE 5 END AS BIGINT) AS bucket, count(*) AS n_triples
 FROM b LEFT JOIN sg_w l ON l.side = 'lost' AND l.person = b.person AND l.org = b.org AND l.unit = b.unit WHERE k >= 3 GROUP BY 1, 2""", ("rec_w", "sg_w"))
def _(i):
    return mv.pay_level(flow(i, "_w").moves, i.wide.recipients, SEG, B, 3)


@query("below_depth", f"""
 WITH t AS (SELECT person FROM sp WHERE side = 'lost' AND cause = 'below_threshold'),
 b AS (SELECT person, max(a) AS amt_b FROM (SELECT person, org, sum(pf_amt) AS a FROM rec WHERE mi = {B} AND seg = '{SEG}' GROUP BY 1, 2) GROUP BY 1),
 c AS (SELECT person, max(a) AS amt_c FROM (SELECT person, org, sum(amt) AS a FROM lines JOIN orgs o USING (org)
   WHERE mi = {C} AND code <= 2 AND o.seg = '{SEG}' GROUP BY 1, 2) GROUP BY 1)
 SELECT CAST(CASE WHEN coalesce(amt_c, 0) >= 16 THEN 1 WHEN coalesce(amt_c, 0) >= 8 THEN 2 ELSE 3 END AS BIGINT) AS level,
   CAST(CASE WHEN coalesce(amt_c, 0) >= 0.8 * amt_b THEN 1 WHEN coalesce(amt_c, 0) >= 0.5 * amt_b THEN 2 ELSE 3 END AS BIGINT) AS change,
   count(*) AS n_persons FROM t JOIN b USING (person) LEFT JOIN c USING (person) GROUP BY 1, 2""", ("rec", "sp", "lines", "orgs"))
def _(i):
    return mv.below_depth(flow(i).persons, i.recipients, i.lines, i.orgs, SEG, B, C, THRESHOLD)


@query("survival", f"""
 WITH c AS (SELECT person, org, unit FROM rec WHERE mi = {B}),
 a AS (SELECT r.mi, count(*) AS n_alive, count(DISTINCT r.person) AS n_persons FROM rec r JOIN c USING (person, org, unit) WHERE r.mi BETWEEN {B} AND 29 GROUP BY 1)
 SELECT mi, n_alive, n_persons, round(n_alive / (SELECT count(*) FROM c), 4) AS share,
   (SELECT n_alive FROM a p WHERE p.mi = a.mi - 1) - n_alive AS lost FROM a""", "rec")
def _(i):
    return mv.survival(i.recipients, B, 29)


cte("agr", "SELECT *, CASE WHEN code < 4 THEN 'A' || code END AS agreement FROM lines_w", "lines_w")
cte("ostat", f"""
 SELECT r.org, count(*) FILTER (WHERE mi = {B}) AS n_base, count(*) FILTER (WHERE mi = {C}) AS n_cur,
   coalesce((SELECT sum(amt) FROM agr l WHERE l.mi = {C} AND l.org = r.org), 0) AS amt_now,
   (SELECT count(DISTINCT agreement) FROM agr l WHERE l.mi = {B} AND l.org = r.org) AS agr_base,
   (SELECT count(DISTINCT agreement) FROM agr l WHERE l.mi = {B} AND l.org = r.org
      AND agreement IN (SELECT agreement FROM agr m WHERE m.mi = {C} AND m.org = r.org)) AS agr_kept,
   (SELECT count(DISTINCT agreement) FROM agr l WHERE l.mi = {C} AND l.org = r.org) AS agr_cur
 FROM rec_w r WHERE mi IN ({B}, {C}) GROUP BY 1 HAVING count(*) FILTER (WHERE mi = {B}) > 0""", "rec_w", "agr")
cte("oexit", f"""
 SELECT o.org, CASE WHEN n_base < 4 THEN 'small' WHEN n_cur = 0 AND amt_now <= 0 AND lb >= 0.2 * n_base THEN 'left_entirely'
    WHEN n_cur = 0 AND amt_now <= 0 THEN 'stopped_people_stayed' WHEN lb >= 0.2 * n_base THEN 'mass_exit' ELSE 'individual' END AS cls,
   CASE WHEN agr_base = 0 THEN 'no_data' WHEN n_cur = 0 AND amt_now <= 0 THEN 'stopped' WHEN agr_kept > 0 THEN 'same' WHEN agr_cur > 0 THEN 'changed'
    ELSE 'stopped' END AS agreements, n_base, n_cur, lb AS left_bank, loss, lb / n_base AS left_share
 FROM (SELECT s.*, (SELECT count(*) FROM sg_w l WHERE l.org = s.org AND side = 'lost' AND cause = 'left_bank') AS lb,
   (SELECT count(*) FROM sg_w l WHERE l.org = s.org AND side = 'lost' AND cause <> 'stayed_in_segment') AS loss FROM ostat s) o""", "ostat", "sg_w")


def _ostat(i):
    agr = i.wide.lines.withColumn("agreement", F.when(F.col("code") < 4, F.concat(F.lit("A"), F.col("code").cast("string"))))
    return mv.org_status(i.wide.recipients, agr, B, C)


@query("org_status", "SELECT org, n_base, n_cur, CAST(amt_now AS DOUBLE) AS amt_now, agr_base, agr_kept, agr_cur FROM ostat", "ostat")
def _(i):
    return _ostat(i)


@query("org_exit_class", "SELECT * REPLACE (round(left_share, 4) AS left_share) FROM oexit", "oexit")
def _(i):
    return mv.org_exit_class(_ostat(i), flow(i, "_w").moves, 4, 0.2)


@query("org_exit_summary", """
 SELECT cls, agreements, count(*) AS n_orgs, CAST(sum(n_base) AS BIGINT) AS n_base, CAST(sum(left_bank) AS BIGINT) AS left_bank,
   CAST(sum(loss) AS BIGINT) AS loss, round(sum(left_bank) / (SELECT sum(left_bank) FROM oexit), 4) AS share_left FROM oexit GROUP BY 1, 2""", "oexit")
def _(i):
    return mv.org_exit_summary(mv.org_exit_class(_ostat(i), flow(i, "_w").moves, 4, 0.2), ("cls", "agreements"))
