"""Queries of the year-over-year report, cohorts, organisation movement and period series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moves as mv
from ..operators import ranking as rk
from ..operators import series as se
from ..operators import triples as tr
from ..operators import yoy as yo
from .movement import B, C, LOADED, SEG, YB, YC, _gone, flow
from .registry import cte, query

_COMP = {"base": "seg_from <> 'outside'", "lost": "seg_to = 'outside'", "gained": "seg_from = 'outside'", "current": "seg_to <> 'outside'",
         **{f"lost_{x}": f"seg_to = 'outside' AND cause = '{x}'" for x in yo.GONE}, **{f"gained_{x}": f"seg_from = 'outside' AND cause = '{x}'" for x in yo.COME},
         **{f"lost_tenure_{x}": f"seg_to = 'outside' AND coalesce(tenure, 'unknown') = '{x}'" for x in ("new1", "new2", "old", "unknown")},
         "lost_back": "seg_to = 'outside' AND in_next = 1", "gained_gap": "seg_from = 'outside' AND was_before = 1",
         "gained_fresh": "seg_from = 'outside' AND coalesce(was_before, 0) <> 1"}


def _dec(tag: str) -> str:
    parts = []
    for k, cond in _COMP.items():
        side = "c" if k.startswith("gained") or k == "current" else "b"
        parts.append(f"SELECT '{k}' AS component, CAST(coalesce(sum(tr_{side}), 0) AS BIGINT) AS triples, count(*) AS persons, CAST(coalesce(sum(org_{side}), 0) AS BIGINT) AS orgs FROM fl{tag} WHERE {cond}")
    parts.append(f"""SELECT 'inside', CAST(coalesce(sum(tr_c - tr_b), 0) AS BIGINT), CAST(0 AS BIGINT), CAST(coalesce(sum(org_c - org_b), 0) AS BIGINT) FROM fl{tag} WHERE seg_from <> 'outside' AND seg_to <> 'outside'""")
    parts.append("SELECT 'residual', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)")
    return " UNION ALL ".join(parts)


for _t in ("", "_y"):
    cte(f"dec{_t}", _dec(_t), f"fl{_t}")


def pflow(i, tag=""):
    f = flow(i, tag)
    return mv.person_flow(f.panel, f.b, f.c, LOADED)


def tflow(i, tag=""):
    f = flow(i, tag)
    return mv.triple_flow(f.l.recipients, f.panel, f.b, f.c, LOADED)


@query("decompose", "SELECT * FROM dec", "dec")
def _(i):
    return yo.decompose(pflow(i))


@query("diff_in_diff", """SELECT component, a.triples, a.persons, b.triples AS triples_y, b.persons AS persons_y, a.triples - b.triples AS triples_diff, a.persons - b.persons AS persons_diff
 FROM dec a JOIN dec_y b USING (component)""", ("dec", "dec_y"))
def _(i):
    return yo.diff_in_diff(yo.decompose(pflow(i)), yo.decompose(pflow(i, "_y")), ["component"], ["triples", "persons"])


@query("drivers", """SELECT component, a.triples, b.triples AS triples_y, a.triples - b.triples AS triples_diff FROM dec a JOIN dec_y b USING (component)
 ORDER BY abs(a.triples - b.triples) DESC, component LIMIT 5""", ("dec", "dec_y"))
def _(i):
    return yo.drivers(yo.diff_in_diff(yo.decompose(pflow(i)), yo.decompose(pflow(i, "_y")), ["component"], ["triples"]), "triples_diff", "component", 5)


@query("temporary_vs_permanent", """WITH x AS (SELECT max(a.triples) FILTER (WHERE component = 'lost') AS a, max(a.triples) FILTER (WHERE component = 'lost_back') AS t,
   max(b.triples) FILTER (WHERE component = 'lost') AS pa, max(b.triples) FILTER (WHERE component = 'lost_back') AS pt FROM dec a JOIN dec_y b USING (component))
 SELECT 'temp' AS kind, -t AS cur, -pt AS prev, pt - t AS diff FROM x UNION ALL SELECT 'perm', -(a - t), -(pa - pt), (pa - pt) - (a - t) FROM x UNION ALL SELECT 'all', -a, -pa, pa - a FROM x""", ("dec", "dec_y"))
def _(i):
    return yo.temporary_vs_permanent(yo.decompose(pflow(i)), yo.decompose(pflow(i, "_y")))


def _segdec(tag, b, c):
    causes = ", ".join(f"count(*) FILTER (WHERE cause = '{x}') AS {x}" for x in (*yo.GONE, *yo.COME))
    return f"""WITH t AS (SELECT seg, count(*) FILTER (WHERE mi = {b}) AS base, count(*) FILTER (WHERE mi = {c}) AS current FROM rec GROUP BY 1),
     g AS (SELECT seg, -count(*) FILTER (WHERE cause IN {yo.GONE}) AS stopped, count(*) FILTER (WHERE cause IN {yo.COME}) AS started,
      count(*) FILTER (WHERE cause = 'other_seg' AND side = 'gained') - count(*) FILTER (WHERE cause = 'other_seg' AND side = 'lost') AS other_seg,
      count(*) FILTER (WHERE cause = 'inside' AND side = 'gained') - count(*) FILTER (WHERE cause = 'inside' AND side = 'lost') AS inside, {causes} FROM tf{tag} GROUP BY 1)
     SELECT *, current - base AS delta, CAST(0 AS BIGINT) AS residual FROM t JOIN g USING (seg)"""


cte("segdec", _segdec("", B, C), "rec", "tf")
cte("segdec_y", _segdec("_y", YB, YC), "rec", "tf_y")


def _seg_dec(i, tag=""):
    b, c = (YB, YC) if tag else (B, C)
    return yo.segment_decompose(tflow(i, tag), i.recipients.groupBy("mi", "seg").agg(F.count(F.lit(1)).alias("n_triples")), b, c)


@query("segment_decompose", "SELECT * FROM segdec", "segdec")
def _(i):
    return _seg_dec(i)


@query("diff_in_diff_segments", """SELECT seg, a.stopped, a.started, a.delta, b.stopped AS stopped_y, b.started AS started_y, b.delta AS delta_y,
 a.stopped - b.stopped AS stopped_diff, a.started - b.started AS started_diff, a.delta - b.delta AS delta_diff FROM segdec a JOIN segdec_y b USING (seg)""", ("segdec", "segdec_y"))
def _(i):
    return yo.diff_in_diff(_seg_dec(i), _seg_dec(i, "_y"), ["seg"], ["stopped", "started", "delta"])


_SEGS = ("retail", "corp", "public")


@query("flow_matrix", "SELECT seg_from, " + ", ".join(f"count(*) FILTER (WHERE seg_to = '{s}') AS {s}" for s in (*_SEGS, "outside")) + " FROM fl GROUP BY 1", "fl")
def _(i):
    return yo.flow_matrix(pflow(i), _SEGS)


@query("segment_persons", """SELECT seg, (SELECT count(*) FROM fl WHERE seg_from = seg) AS base, (SELECT count(*) FROM fl WHERE seg_to = seg) AS current,
 (SELECT count(*) FROM fl WHERE seg_from = seg AND seg_to = 'outside') AS stopped, (SELECT count(*) FROM fl WHERE seg_to = seg AND seg_from = 'outside') AS started,
 (SELECT count(*) FROM fl WHERE seg_from = seg AND seg_to NOT IN (seg, 'outside')) AS to_other, (SELECT count(*) FROM fl WHERE seg_to = seg AND seg_from NOT IN (seg, 'outside')) AS from_other
 FROM (SELECT DISTINCT seg FROM orgs)""", ("fl", "orgs"))
def _(i):
    return yo.segment_persons(pflow(i))


_ORDER = (("stayed_in_segment", "move"), ("left_bank", "loss"), ("below_threshold", "loss"), ("other_codes", "loss"), ("left_segment", "loss"))


@query("ladder_table", f"""WITH c AS (SELECT side, cause, count(*) AS n_triples, count(DISTINCT person) AS n_persons FROM sg WHERE side = 'lost' GROUP BY 1, 2)
 SELECT side, CAST(list_position({[x for x, _ in _ORDER]}, cause) - 1 AS BIGINT) AS pos, cause, CASE WHEN cause = 'stayed_in_segment' THEN 'move' ELSE 'loss' END AS kind, n_triples, n_persons,
  round(n_triples / (SELECT sum(n_triples) FROM c), 4) AS share_triples, round(n_persons / (SELECT sum(n_persons) FROM c), 4) AS share_persons FROM c""", "sg")
def _(i):
    return yo.ladder_table(mv.cause_totals(flow(i).moves).where("side = 'lost'"), _ORDER)


# --------------------------------------------------------------- cohorts

def _coh(k, before, name):
    cte(name, f"SELECT person, main_seg AS seg, main_org AS org FROM pm WHERE mi = {k} AND person NOT IN (SELECT person FROM pm WHERE mi = {before})", "pm")


_coh(18, 17, "coh")
_coh(6, 5, "coh_y")
_SURV = """SELECT c.seg, p.mi - {k} AS age, (SELECT count(*) FROM {n} x WHERE x.seg = c.seg) AS size, count(*) AS n_alive,
 round(count(*) / (SELECT count(*) FROM {n} x WHERE x.seg = c.seg), 4) AS survival FROM {n} c JOIN pm p ON p.person = c.person AND p.mi BETWEEN {k} AND {k} + 3 GROUP BY 1, 2"""


@query("cohort_survival", _SURV.format(k=18, n="coh"), ("coh", "pm"))
def _(i):
    return yo.cohort_survival(i.person_month, 18, 17)


@query("cohort_excess", """WITH a AS (SELECT p.mi - 18 AS age, count(*) / (SELECT count(*) FROM coh) AS s FROM coh c JOIN pm p ON p.person = c.person AND p.mi BETWEEN 18 AND 21 GROUP BY 1),
 b AS (SELECT p.mi - 6 AS age, count(*) / (SELECT count(*) FROM coh_y) AS s FROM coh_y c JOIN pm p ON p.person = c.person AND p.mi BETWEEN 6 AND 9 GROUP BY 1)
 SELECT age, (SELECT count(*) FROM coh) AS size, round(a.s, 4) AS surv_cur, round(b.s, 4) AS surv_prev, round((SELECT count(*) FROM coh) * (b.s - a.s), 4) + 0.0 AS excess_loss FROM a JOIN b USING (age)""", ("coh", "coh_y", "pm"))
def _(i):
    return yo.cohort_excess(yo.cohort_survival(i.person_month, 18, 17), yo.cohort_survival(i.person_month, 6, 5))


@query("cohort_by_dim", f"""WITH a AS (SELECT c.org, CASE WHEN p.person IS NOT NULL THEN 'alive' ELSE {_gone('ps')} END AS st FROM coh c LEFT JOIN pm p ON p.mi = 20 AND p.person = c.person
   LEFT JOIN presence ps ON ps.mi = 20 AND ps.person = c.person), d AS (SELECT a.st, o.* FROM a LEFT JOIN orgs o USING (org))
 SELECT 'seg' AS dim, seg AS key, st, count(*) AS n FROM d GROUP BY 2, 3 UNION ALL SELECT 'holding', hold, st, count(*) FROM d WHERE hold IS NOT NULL GROUP BY 2, 3
 UNION ALL SELECT 'industry', industry, st, count(*) FROM d GROUP BY 2, 3 UNION ALL SELECT 'focus', 'true', st, count(*) FROM d WHERE focus GROUP BY 3""", ("coh", "pm", "presence", "orgs"))
def _(i):
    return yo.cohort_by_dim(i.person_month, i.presence, i.orgs, 18, 17, 20)


@query("dim_breakdown", """WITH d AS (SELECT r.mi, o.seg, o.hold, o.industry, r.region, o.focus, pf_amt FROM rec r JOIN orgs o USING (org) WHERE mi = 20)
 SELECT dim, key, count(*) AS n, CAST(sum(pf_amt) AS DOUBLE) AS amt FROM (SELECT 'seg' AS dim, seg AS key, pf_amt FROM d UNION ALL SELECT 'holding', hold, pf_amt FROM d WHERE hold IS NOT NULL
  UNION ALL SELECT 'industry', industry, pf_amt FROM d UNION ALL SELECT 'region', CAST(region AS VARCHAR), pf_amt FROM d UNION ALL SELECT 'focus', 'true', pf_amt FROM d WHERE focus) GROUP BY 1, 2""", ("rec", "orgs"))
def _(i):
    d = i.recipients.where("mi = 20").drop("seg", "hold", "focus").join(i.orgs, "org").withColumns({"n": F.lit(1), "amt": F.col("pf_amt")})
    return yo.dim_breakdown(d, {"seg": "seg", "holding": "hold", "industry": "industry", "region": "region", "focus": "focus"}, [], ["n", "amt"], only_true=("focus",))


# ---------------------------------------------------------- organisations

cte("opairs", f"SELECT DISTINCT mi, person, org FROM rec_w WHERE mi IN ({B}, {C})", "rec_w")
cte("olv", f"SELECT person, org FROM opairs WHERE mi = {B} EXCEPT SELECT person, org FROM opairs WHERE mi = {C}", "opairs")
cte("ojn", f"SELECT person, org FROM opairs WHERE mi = {C} EXCEPT SELECT person, org FROM opairs WHERE mi = {B}", "opairs")
cte("omv", f"SELECT l.org AS f, p.org AS t, l.person FROM olv l JOIN opairs p ON p.mi = {C} AND p.person = l.person", "olv", "opairs")
cte("osucc", "SELECT m.f, m.t FROM (SELECT f, t, count(*) AS n FROM omv GROUP BY 1, 2) m JOIN (SELECT org, count(*) AS k FROM olv GROUP BY 1) l ON l.org = m.f WHERE n >= 2 AND n >= 0.4 * k", "omv", "olv")
cte("omove", f"""
 WITH lo AS (SELECT l.org, CASE WHEN EXISTS (SELECT 1 FROM omv m JOIN osucc s ON s.f = m.f AND s.t = m.t WHERE m.f = l.org AND m.person = l.person) THEN 'reorg'
    WHEN EXISTS (SELECT 1 FROM pm_w p WHERE p.mi = {C} AND p.person = l.person) THEN 'moved' WHEN EXISTS (SELECT 1 FROM pm_w p WHERE p.mi = {C + 1} AND p.person = l.person) THEN 'back'
    ELSE {_gone('ps')} END AS cls FROM olv l LEFT JOIN presence_w ps ON ps.mi = {C} AND ps.person = l.person),
 ji AS (SELECT j.org, CASE WHEN EXISTS (SELECT 1 FROM omv m JOIN osucc s ON s.f = m.f AND s.t = m.t WHERE m.t = j.org AND m.person = j.person) THEN 'reorg'
    WHEN EXISTS (SELECT 1 FROM pm_w p WHERE p.mi = {B} AND p.person = j.person) THEN 'moved' ELSE 'new' END AS cls FROM ojn j),
 o AS (SELECT org, count(*) FILTER (WHERE mi = {B}) AS base_n, count(*) FILTER (WHERE mi = {C}) AS cur_n,
   {', '.join(f"(SELECT count(*) FROM lo WHERE lo.org = p.org AND cls = '{x}') AS out_{x}" for x in (*yo.GONE, 'moved', 'reorg', 'back'))},
   {', '.join(f"(SELECT count(*) FROM ji WHERE ji.org = p.org AND cls = '{x}') AS in_{x}" for x in ('new', 'moved', 'reorg'))} FROM opairs p GROUP BY 1 HAVING count(*) FILTER (WHERE mi = {B}) > 0),
 x AS (SELECT *, out_left_bank + out_below_threshold + out_other_codes AS out_stopped, cur_n - base_n AS net, cur_n - base_n + out_reorg - in_reorg + out_back AS net_ex_reorg FROM o)
 SELECT *, CASE WHEN net_ex_reorg < 0 THEN least(out_stopped, -net_ex_reorg) ELSE 0 END AS real_cut FROM x""", "olv", "ojn", "omv", "osucc", "opairs", "pm_w", "presence_w")


def omove(i):
    return yo.org_movement(i.wide.recipients, flow(i, "_w").panel, B, C, 2, 0.4)


CUT = (3, 1, 0.05)
_CUTSQL = "base_n >= 3 AND net_ex_reorg < 0 AND real_cut >= 1 AND real_cut >= 0.05 * base_n"


@query("org_movement", "SELECT * FROM omove", "omove")
def _(i):
    return omove(i)


@query("org_cut_list", f"""WITH p AS (SELECT * FROM omove WHERE {_CUTSQL}), r AS (SELECT org, region, row_number() OVER (PARTITION BY org ORDER BY count(*) DESC, region) AS k FROM rec_w WHERE mi = {B} GROUP BY 1, 2),
 d AS (SELECT f, t, count(*) AS n, row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, t) AS k FROM omv GROUP BY 1, 2)
 SELECT p.org, base_n, cur_n, out_stopped, net_ex_reorg, real_cut, seg, hold, focus, CAST(region AS BIGINT) AS main_region, d.t AS top_org, d.n AS top_n,
  (SELECT count(*) FROM p) AS n_picked, CAST((SELECT sum(real_cut) FROM p) AS BIGINT) AS sum_real
 FROM p LEFT JOIN orgs_w o USING (org) LEFT JOIN r ON r.org = p.org AND r.k = 1 LEFT JOIN d ON d.f = p.org AND d.k = 1 ORDER BY real_cut DESC, p.org LIMIT 6""", ("omove", "omv", "rec_w", "orgs_w"))
def _(i):
    return yo.org_cut_list(omove(i), i.wide.recipients, i.wide.orgs, B, C, yo.is_cut(*CUT), 6)


_SUMS = ("base_n", "cur_n", "out_stopped", "out_moved", "out_reorg", "out_back", "in_new", "in_moved", "real_cut")


@query("org_cut_summary", f"""SELECT CASE WHEN base_n < 3 THEN 'small' WHEN {_CUTSQL} THEN 'cut' WHEN out_reorg > 0 THEN 'reorg' WHEN net_ex_reorg > 0 THEN 'grew'
 WHEN net_ex_reorg = 0 THEN 'flat' WHEN out_stopped = 0 THEN 'down_moved' ELSE 'down_small' END AS cls, seg, count(*) AS n_orgs,
 {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in _SUMS)} FROM omove LEFT JOIN orgs_w USING (org) GROUP BY 1, 2""", ("omove", "orgs_w"))
def _(i):
    return yo.org_cut_summary(omove(i), i.wide.orgs, yo.is_cut(*CUT), 3)


_BRK = ("count(*) AS n_orgs_all, CAST(sum(base_n) AS BIGINT) AS base_n, CAST(sum(p) AS BIGINT) AS n_orgs, CAST(sum(base_n * p) AS BIGINT) AS cut_base, "
        "CAST(sum(real_cut * p) AS BIGINT) AS cut_real, CAST(sum(out_stopped) AS BIGINT) AS out_stopped")


@query("org_cut_break", f"""WITH s AS (SELECT m.*, CASE WHEN {_CUTSQL} THEN 1 ELSE 0 END AS p, seg, hold, industry FROM omove m LEFT JOIN orgs_w USING (org)),
 g AS (SELECT 'seg' AS dim, seg AS key, {_BRK} FROM s GROUP BY seg UNION ALL SELECT 'holding', hold, {_BRK} FROM s WHERE hold IS NOT NULL GROUP BY hold
  UNION ALL SELECT 'industry', industry, {_BRK} FROM s GROUP BY industry)
 SELECT *, row_number() OVER (PARTITION BY dim ORDER BY cut_real DESC, n_orgs_all DESC, key) AS rn FROM g QUALIFY rn <= 1 OR dim = 'seg'""", ("omove", "orgs_w"))
def _(i):
    return yo.org_cut_break(omove(i), i.wide.orgs, yo.is_cut(*CUT), 1)


_HOLE = """SELECT *, CAST(n_cur <= 0.7 * n_prev AND n_next >= 0.8 * n_prev AS BIGINT) AS hit, CASE WHEN n_cur <= 0.7 * n_prev AND n_next >= 0.8 * n_prev THEN n_prev - n_cur ELSE 0 END AS hole
 FROM (SELECT org, count(*) FILTER (WHERE mi = 13) AS n_prev, count(*) FILTER (WHERE mi = 14) AS n_cur, count(*) FILTER (WHERE mi = 15) AS n_next FROM rec_w WHERE mi BETWEEN 13 AND 15 GROUP BY 1) WHERE n_prev >= 3"""


@query("org_hole", _HOLE, "rec_w")
def _(i):
    return yo.org_hole(i.wide.recipients, 14, 3, fall=0.7)


@query("org_hole_by_dim", f"""WITH h AS (SELECT * FROM ({_HOLE}) LEFT JOIN orgs_w USING (org))
 SELECT dim, key, count(*) AS n_orgs_base, CAST(sum(n_prev) AS BIGINT) AS n_prev, CAST(sum(hit) AS BIGINT) AS n_orgs, CAST(sum(hole) AS BIGINT) AS hole FROM (
  SELECT 'seg' AS dim, seg AS key, * FROM h UNION ALL SELECT 'holding', hold, * FROM h WHERE hold IS NOT NULL UNION ALL SELECT 'industry', industry, * FROM h) GROUP BY 1, 2""", ("rec_w", "orgs_w"))
def _(i):
    return yo.org_hole_by_dim(yo.org_hole(i.wide.recipients, 14, 3, fall=0.7), i.wide.orgs)


@query("return_pay_signature", """WITH g AS (SELECT p.person, CASE WHEN c.person IS NULL THEN 'gap' ELSE 'steady' END AS grp FROM pm p JOIN pm n ON n.mi = 15 AND n.person = p.person
   LEFT JOIN pm c ON c.mi = 14 AND c.person = p.person WHERE p.mi = 13), r AS (SELECT grp, CAST(b.amt_codes AS DOUBLE) / CAST(a.amt_codes AS DOUBLE) AS q FROM g JOIN presence a ON a.mi = 13 AND a.person = g.person
   JOIN presence b ON b.mi = 15 AND b.person = g.person WHERE a.amt_codes > 0)
 SELECT grp, count(*) AS n_persons, round(median(q), 4) AS median_ratio, round(avg(CASE WHEN q >= 1.6 THEN 1.0 ELSE 0 END), 4) AS share_double,
  round(avg(CASE WHEN q BETWEEN 0.7 AND 1.4 THEN 1.0 ELSE 0 END), 4) AS share_single FROM r GROUP BY 1""", ("pm", "presence"))
def _(i):
    return yo.return_pay_signature(i.person_month, i.presence, 14)


# -------------------------------------------------------------------- cuts

_CZ = ("left_bank", "below_threshold", "other_codes", "left_segment")


@query("cut_by_dim", f"""WITH g AS (SELECT CAST(region AS VARCHAR) AS region, {', '.join(f"count(*) FILTER (WHERE side = 'lost' AND cause = '{x}') AS {x}" for x in _CZ)},
  count(*) FILTER (WHERE side = 'lost' AND cause <> 'stayed_in_segment') AS loss, count(*) FILTER (WHERE side = 'gained' AND cause <> 'stayed_in_segment') AS arrived,
  count(*) FILTER (WHERE side = 'lost' AND cause = 'stayed_in_segment') AS moved_out, count(*) FILTER (WHERE side = 'gained' AND cause = 'stayed_in_segment') AS moved_in FROM sg GROUP BY 1),
 t AS (SELECT CAST(region AS VARCHAR) AS region, count(*) FILTER (WHERE mi = {B}) AS base, count(*) FILTER (WHERE mi = {C}) AS current FROM rec WHERE seg = '{SEG}' AND mi IN ({B}, {C}) GROUP BY 1),
 x AS (SELECT *, current - base AS net FROM t JOIN g USING (region)),
 y AS (SELECT * FROM x UNION ALL BY NAME SELECT 'TOTAL' AS region, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in (*_CZ, 'loss', 'arrived', 'moved_out', 'moved_in', 'base', 'current', 'net'))} FROM x)
 SELECT *, round(loss / (SELECT sum(loss) FROM x), 4) AS loss_share, round(loss / base, 4) AS loss_rate FROM y""", ("sg", "rec"))
def _(i):
    return yo.cut_by_dim(flow(i).moves, i.recipients.where(F.col("seg") == SEG), "region", B, C)


@query("net_top_orgs", """WITH p AS (SELECT org, side, cause, count(*) AS n FROM sg_w GROUP BY 1, 2, 3), l AS (SELECT org, cause, row_number() OVER (PARTITION BY org ORDER BY n DESC, cause) AS k
  FROM p WHERE side = 'lost' AND cause <> 'stayed_in_segment'), g AS (SELECT org, CAST(coalesce(sum(n) FILTER (WHERE side = 'lost' AND cause <> 'stayed_in_segment'), 0) AS BIGINT) AS lost,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'gained' AND cause <> 'stayed_in_segment'), 0) AS BIGINT) AS gained FROM p GROUP BY 1)
 SELECT g.*, cause AS lead_cause, gained - lost AS net FROM g LEFT JOIN l ON l.org = g.org AND k = 1 ORDER BY net, g.org LIMIT 5""", "sg_w")
def _(i):
    return yo.net_top_orgs(flow(i, "_w").moves, 5)


@query("multi_job_split", f"""WITH p AS (SELECT mi, person, count(DISTINCT org) AS k, count(*) AS n FROM rec WHERE mi IN ({YC}, {C}) GROUP BY 1, 2),
 s AS (SELECT mi, count(*) AS np, sum(n) AS nt, sum(k - 1) AS eo, sum(n - k) AS eu FROM p GROUP BY 1)
 SELECT CAST(c.nt - b.nt AS BIGINT) AS d_triples, CAST(c.np - b.np AS BIGINT) AS d_persons, CAST(c.eo - b.eo AS BIGINT) AS d_orgs, CAST(c.eu - b.eu AS BIGINT) AS d_units,
  round((b.nt - b.np) / b.np, 4) AS extra_share_b, round((c.nt - c.np) / c.np, 4) AS extra_share_c, CAST(0 AS BIGINT) AS residual FROM s c, s b WHERE c.mi = {C} AND b.mi = {YC}""", "rec")
def _(i):
    return yo.multi_job_split(tr.multi_structure(i.recipients), YC, C)


_TWO = f"SELECT org, region, seg, count(*) FILTER (WHERE mi = {YC}) AS n_b, count(*) FILTER (WHERE mi = {C}) AS n_c FROM rec_w WHERE mi IN ({YC}, {C}) GROUP BY 1, 2, 3"


@query("two_date_compare", f"SELECT org, CAST(region AS BIGINT) AS region, seg, n_b, n_c FROM ({_TWO})", "rec_w")
def _(i):
    return yo.two_date_compare(i.wide.recipients, ["org", "region", "seg"], YC, C)


@query("dim_yoy", f"""WITH x AS (SELECT o.industry, t.* FROM ({_TWO}) t JOIN orgs_w o USING (org))
 SELECT industry, CAST(sum(n_b) AS BIGINT) AS was, CAST(sum(n_c) AS BIGINT) AS now, CAST(sum(n_c - n_b) AS BIGINT) AS total,
 {', '.join(f"CAST(coalesce(sum(n_c - n_b) FILTER (WHERE seg = '{s}'), 0) AS BIGINT) AS {s}" for s in _SEGS)},
 round(sum(n_c - n_b) / sum(n_b), 4) AS pct, round(sum(n_c - n_b) / (SELECT sum(n_c - n_b) FROM x), 4) AS share_of_change FROM x GROUP BY 1""", ("rec_w", "orgs_w"))
def _(i):
    t = yo.two_date_compare(i.wide.recipients, ["org", "region", "seg"], YC, C).join(i.wide.orgs.select("org", "industry"), "org")
    return yo.dim_yoy(t, "industry", _SEGS)


@query("source_agreement", f"""WITH x AS (SELECT t.*, o.industry AS a, CASE WHEN org LIKE 'view%' THEN 'it' WHEN org LIKE 'signup%' THEN 'unknown' WHEN org LIKE 'error%' THEN 'trade' ELSE 'trade' END AS b
  FROM ({_TWO}) t JOIN orgs_w o USING (org))
 SELECT seg, CAST(sum(n_c) AS BIGINT) AS n, 1.0::DOUBLE AS a_known, round(sum(n_c) FILTER (WHERE b <> 'unknown') / sum(n_c), 4) AS b_known, CAST(sum(n_c) FILTER (WHERE b <> 'unknown') AS BIGINT) AS both,
  round(coalesce(sum(n_c) FILTER (WHERE a = b), 0) / sum(n_c) FILTER (WHERE b <> 'unknown'), 4) AS agree FROM x GROUP BY 1""", ("rec_w", "orgs_w"))
def _(i):
    t = yo.two_date_compare(i.wide.recipients, ["org", "region", "seg"], YC, C).join(i.wide.orgs.select("org", F.col("industry").alias("a")), "org")
    b = F.when(F.col("org").startswith("view"), "it").when(F.col("org").startswith("signup"), "unknown").otherwise("trade")
    return yo.source_agreement(t.withColumn("b", b), "a", "b", ["seg"])


@query("area_match", f"""WITH x AS (SELECT org, unit, count(*) FILTER (WHERE mi = {YC}) AS n_b, count(*) FILTER (WHERE mi = {C}) AS n_c FROM rec_w WHERE mi IN ({YC}, {C}) GROUP BY 1, 2),
 g AS (SELECT DISTINCT org, unit FROM rec_w WHERE mi = 3 AND org LIKE '%-1')
 SELECT CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.org = x.org AND g.unit = x.unit) THEN 'pair' WHEN EXISTS (SELECT 1 FROM g WHERE g.org = x.org) THEN 'org_only' ELSE 'none' END AS match,
  CAST(sum(n_b) AS BIGINT) AS n_b, CAST(sum(n_c) AS BIGINT) AS n_c FROM x GROUP BY 1""", "rec_w")
def _(i):
    r = i.wide.recipients
    return yo.area_match(yo.two_date_compare(r, ["org", "unit"], YC, C), r.where((F.col("mi") == 3) & F.col("org").endswith("-1")))


# ------------------------------------------------------------------- series

cte("ser", "SELECT mi, count(*) AS v, count(DISTINCT person) AS p FROM rec GROUP BY 1", "rec")
cte("chg", """SELECT *, v - lag(v) OVER (ORDER BY mi) AS mom, (v - lag(v) OVER (ORDER BY mi)) / lag(v) OVER (ORDER BY mi) AS mom_pct, v - lag(v, 12) OVER (ORDER BY mi) AS yoy,
 (v - lag(v, 12) OVER (ORDER BY mi)) / lag(v, 12) OVER (ORDER BY mi) AS yoy_pct, v / p AS per_person FROM ser""", "ser")
_R4 = "round({0}, 4) + 0.0 AS {0}"


def ser(i):
    return tr.month_totals(i.recipients).select("mi", F.col("n_triples").alias("v"), F.col("n_persons").alias("p"))


def orgser(i):
    return i.wide.recipients.groupBy("org", "mi").agg(F.count(F.lit(1)).alias("v"))


cte("oser", "SELECT o.org, m.mi, coalesce(v, 0) AS v, v IS NOT NULL AS present FROM (SELECT DISTINCT org FROM rec_w) o CROSS JOIN (SELECT CAST(range AS INTEGER) AS mi FROM range(30)) m LEFT JOIN (SELECT org, mi, count(*) AS v FROM rec_w GROUP BY 1, 2) s ON s.org = o.org AND s.mi = m.mi", "rec_w")


def full(i):
    return se.scaffold(orgser(i), ["org"], 0, 29, ["v"], "present")


@query("scaffold", "SELECT org, CAST(mi AS BIGINT) AS mi, v, present FROM oser", "oser")
def _(i):
    return full(i)


@query("lag_delta", "SELECT org, CAST(mi AS BIGINT) AS mi, v, present, lag(v) OVER w AS prev, v - lag(v) OVER w AS delta, CASE WHEN lag(v) OVER w <> 0 THEN round((v - lag(v) OVER w) / lag(v) OVER w, 4) + 0.0 END AS pct FROM oser WINDOW w AS (PARTITION BY org ORDER BY mi)", "oser")
def _(i):
    return se.lag_delta(full(i), ["org"], "v")


@query("null_safe_join", """WITH a AS (SELECT hold, count(*) AS n FROM rec WHERE mi = 20 GROUP BY 1), b AS (SELECT hold, count(*) AS k FROM rec WHERE mi = 21 GROUP BY 1)
 SELECT a.hold, n, k FROM a JOIN b ON a.hold IS NOT DISTINCT FROM b.hold""", "rec")
def _(i):
    a = i.recipients.where("mi = 20").groupBy("hold").agg(F.count(F.lit(1)).alias("n"))
    b = i.recipients.where("mi = 21").groupBy("hold").agg(F.count(F.lit(1)).alias("k"))
    return se.null_safe_join(a, b, ["hold"])


@query("series_changes", f"SELECT mi, v, p, mom, {_R4.format('mom_pct')}, yoy, {_R4.format('yoy_pct')}, {_R4.format('per_person')} FROM chg", "chg")
def _(i):
    return se.series_changes(ser(i), [], "v", "p")


@query("seasonal_profile", f"SELECT mi, CAST(mi % 12 AS BIGINT) AS slot, CAST((29 - mi) // 12 AS BIGINT) AS years_back, mom, {_R4.format('mom_pct')} FROM chg WHERE mom IS NOT NULL AND (29 - mi) // 12 <= 1", "chg")
def _(i):
    return se.seasonal_profile(se.series_changes(ser(i), [], "v"))


_STEP = """WITH v AS (SELECT mi, {v} AS v FROM chg WHERE yoy IS NOT NULL), w AS (SELECT mi, {d} AS v FROM v), m AS (SELECT median(v) AS med FROM w), d AS (SELECT mi, v, abs(v - med) AS dev, med FROM w, m WHERE v IS NOT NULL),
 x AS (SELECT *, (SELECT CASE WHEN median(dev) > 0 THEN median(dev) ELSE avg(dev) END FROM d) AS mad FROM d)
 SELECT mi, 'yoy' AS measured, v AS delta, round((v - med) / mad, 4) + 0.0 AS score FROM x WHERE {c}"""


@query("step_months", _STEP.format(v="yoy", d="v", c="(v - med) / mad <= -1.2"), "chg")
def _(i):
    return se.step_months(se.series_changes(ser(i), [], "v"), [], 1.2)


@query("step_months_of_change", _STEP.format(v="yoy", d="v - lag(v) OVER (ORDER BY mi)", c="abs((v - med) / mad) > 1.5"), "chg")
def _(i):
    return se.step_months(se.series_changes(ser(i), [], "v"), [], 1.5, of_change=True, drops_only=False)


@query("direction", """WITH x AS (SELECT org, v, row_number() OVER (PARTITION BY org ORDER BY mi DESC) AS r FROM oser), a AS (SELECT org, avg(v) FILTER (WHERE r <= 3) AS last, avg(v) FILTER (WHERE r BETWEEN 4 AND 6) AS prev FROM x GROUP BY 1)
 SELECT org, true AS measurable, round(last, 4) AS last, round(prev, 4) AS prev, round(coalesce((last - prev) / nullif(prev, 0), 0), 4) + 0.0 AS rel,
  CASE WHEN abs(coalesce((last - prev) / nullif(prev, 0), 0)) < 0.05 THEN 'holds' WHEN last > prev THEN 'grows' ELSE 'falls' END AS word FROM a""", "oser")
def _(i):
    return se.direction(full(i), ["org"], "v")


@query("month_compare", """SELECT max(v) FILTER (WHERE mi = 19) AS prev, max(v) FILTER (WHERE mi = 20) AS cur, max(v) FILTER (WHERE mi = 21) AS next, max(v) FILTER (WHERE mi = 8) AS year_ago,
 max(v) FILTER (WHERE mi = 20) - max(v) FILTER (WHERE mi = 19) AS mom, max(v) FILTER (WHERE mi = 20) - max(v) FILTER (WHERE mi = 8) AS yoy, max(v) FILTER (WHERE mi = 21) - max(v) FILTER (WHERE mi = 20) AS to_next FROM ser""", "ser")
def _(i):
    return se.month_compare(ser(i), "v", 20)


@query("bridge", """WITH x AS (SELECT max(v) FILTER (WHERE mi = 19) AS prev, max(v) FILTER (WHERE mi = 20) AS cur, max(v) FILTER (WHERE mi = 21) AS next, max(v) FILTER (WHERE mi = 7) AS y_prev,
  max(v) FILTER (WHERE mi = 8) AS y_cur, max(v) FILTER (WHERE mi = 9) AS y_next FROM ser), y AS (SELECT *, (cur - prev) - (y_cur - y_prev) AS did_cur, (next - cur) - (y_next - y_cur) AS did_next FROM x)
 SELECT *, did_cur + did_next AS two_periods, CASE WHEN did_cur < 0 AND did_next >= -did_cur THEN 'shift' WHEN did_cur < 0 AND did_next > 0 THEN 'partly back' WHEN did_cur < 0 THEN 'loss' ELSE 'no drop' END AS verdict FROM y""", "ser")
def _(i):
    return se.bridge(ser(i), "v", 20)


@query("window_sum_known", """WITH u AS (SELECT org, mi, CASE WHEN present THEN v END AS v FROM oser), w AS (SELECT *, CASE WHEN count(v) OVER f = 3 THEN sum(v) OVER f END AS win FROM u WINDOW f AS (PARTITION BY org ORDER BY mi ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT org, CAST(mi AS BIGINT) AS mi, v, CAST(win AS BIGINT) AS win, CAST(0 AS DOUBLE) AS base_none, CAST(lag(win, 12) OVER o AS DOUBLE) AS base_y1, round((lag(win, 12) OVER o + lag(win, 24) OVER o) / 2.0, 4) AS base_y12 FROM w WINDOW o AS (PARTITION BY org ORDER BY mi)""", "oser")
def _(i):
    f = full(i).select("org", "mi", F.when(F.col("present"), F.col("v")).alias("v"))
    return se.window_sum_known(f, ["org"], "v", 3, {"none": (), "y1": (12,), "y12": (12, 24)})


_EW = ["(CASE WHEN x{j} IS NOT NULL THEN x{j} * {w} ELSE 0 END)", "(CASE WHEN x{j} IS NOT NULL THEN {w} ELSE 0 END)"]


@query("history_features", "WITH u AS (SELECT org, mi, v, present, CASE WHEN present THEN v::DOUBLE END AS x FROM oser), l AS (SELECT *, " + ", ".join(f"lag(x, {j}) OVER (PARTITION BY org ORDER BY mi) AS x{j}" for j in range(1, 13))
       + ", avg(x) OVER (PARTITION BY org ORDER BY mi ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_3, median(x) OVER (PARTITION BY org ORDER BY mi ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS median_3 FROM u) "
       + "SELECT org, CAST(mi AS BIGINT) AS mi, v, present, round(mean_3, 4) AS mean_3, round(median_3, 4) AS median_3, round((" + " + ".join(_EW[0].format(j=j, w=0.5 * 0.5 ** (j - 1)) for j in range(1, 13))
       + ") / nullif(" + " + ".join(_EW[1].format(j=j, w=0.5 * 0.5 ** (j - 1)) for j in range(1, 13)) + ", 0), 4) AS ewma FROM l", "oser")
def _(i):
    return se.history_features(full(i), ["org"], "v", (3,))


@query("history_rate", """WITH u AS (SELECT *, lag(v) OVER (PARTITION BY org ORDER BY mi) AS base FROM oser)
 SELECT org, CAST(mi AS BIGINT) AS mi, v, present, base, round(sum(CASE WHEN present THEN v::DOUBLE END) OVER f / nullif(sum(CASE WHEN present THEN base::DOUBLE END) OVER f, 0), 4) AS rate FROM u
 WINDOW f AS (PARTITION BY org ORDER BY mi ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""", "oser")
def _(i):
    from pyspark.sql import Window as W
    x = full(i).withColumn("base", F.lag("v").over(W.partitionBy("org").orderBy("mi")))
    return se.history_rate(x, ["org"], "v", "base", 6)


# ------------------------------------------------------------------ ranking

@query("latest_row", """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS k FROM customer) WHERE k = 1""")
def _(i):
    c = i.table("customer")
    bal = F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))
    return rk.latest_row(c, ["c_nationkey"], [F.desc(F.col("c_mktsegment") == "BUILDING"), bal.desc_nulls_last(), F.asc("c_custkey")]).select("c_nationkey", "c_custkey")


@query("top_n_per_group", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer QUALIFY rn <= 4")
def _(i):
    return rk.top_n_per_group(i.table("customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 4).drop("c_acctbal")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(i):
    return rk.top_k(i.table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("list_with_totals", "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS n_all, CAST((SELECT sum(o_custkey) FROM orders) AS BIGINT) AS o_custkey_all FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(i):
    return rk.with_totals(i.table("orders"), ["o_custkey"], 10, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_custkey", "n_all", "o_custkey_all")


@query("top_and_rest", """WITH g AS (SELECT c_mktsegment AS s, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY s) AS t FROM g)
 SELECT s, CASE WHEN n >= 0.05 * t OR k = 7 THEN CAST(k AS VARCHAR) ELSE 'others' END AS k, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_keys FROM x GROUP BY 1, 2""")
def _(i):
    c = i.table("customer").select(F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("k"), F.lit(1).alias("n"))
    return rk.top_and_rest(c, ["s"], "k", "n", min_share=0.05, pinned=[7])


@query("top_and_rest_k", """WITH g AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS r FROM g)
 SELECT CASE WHEN r <= 5 THEN CAST(k AS VARCHAR) ELSE 'others' END AS k, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_keys FROM x GROUP BY 1""")
def _(i):
    return rk.top_and_rest(i.table("customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("n")), [], "k", "n", k=5)


_MC = """WITH g AS (SELECT c_mktsegment AS s, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT *, row_number() OVER w AS r, sum(n) OVER (PARTITION BY s) AS t,
  coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WINDOW w AS (PARTITION BY s ORDER BY n DESC, k)), p AS (SELECT * FROM x WHERE r <= 8 AND before < 0.3 * t AND n >= 15)"""


def _mc(i):
    g = i.table("customer").groupBy(F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g, rk.material_cover(g, ["s"], "n", "k", 0.3, 8, 15)


@query("material_cover", _MC + " SELECT s, CAST(k AS BIGINT) AS k, n, CAST(t AS BIGINT) AS group_total FROM p")
def _(i):
    return _mc(i)[1]


@query("cover_tail", _MC + " SELECT s, count(*) - (SELECT count(*) FROM p WHERE p.s = x.s) AS n_rest, CAST(sum(n) - coalesce((SELECT sum(n) FROM p WHERE p.s = x.s), 0) AS BIGINT) AS rest FROM x GROUP BY s")
def _(i):
    g, p = _mc(i)
    return rk.cover_tail(g, p, ["s"], "n")


@query("not_in_dimension", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def _(i):
    li, p = i.table("lineitem"), i.table("part").where("p_size > 5")
    return li.join(p, li.l_partkey == p.p_partkey, "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("both_periods", f"SELECT DISTINCT person FROM rec WHERE mi = {B} INTERSECT SELECT DISTINCT person FROM rec WHERE mi = {C}", "rec")
def _(i):
    r = i.recipients
    return r.where(F.col("mi") == B).select("person").intersect(r.where(F.col("mi") == C).select("person"))


@query("union_all_sides", f"SELECT 'b' AS side, org, count(*) AS n FROM rec WHERE mi = {B} GROUP BY 2 UNION ALL SELECT 'c', org, count(*) FROM rec WHERE mi = {C} GROUP BY 2", "rec")
def _(i):
    def side(t, m):
        return i.recipients.where(F.col("mi") == m).groupBy(F.lit(t).alias("side"), "org").agg(F.count(F.lit(1)).alias("n"))
    return side("b", B).unionByName(side("c", C))


@query("semi_filter", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 3) AS flag FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 6)")
def _(i):
    c = i.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    flag = c.where("c_nationkey < 3").select("o_custkey").distinct().withColumn("flag", F.lit(True))
    return (i.table("orders").select("o_orderkey", "o_custkey").join(c.where("c_nationkey < 6"), "o_custkey", "left_semi").join(flag, "o_custkey", "left")
            .select("o_orderkey", F.col("flag").isNotNull().alias("flag")))
