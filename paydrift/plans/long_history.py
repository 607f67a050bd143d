"""Histories of more than 60 periods: the same reports over the 83 months of the payroll, on masks of two words."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import functions as F

from ..functions import wide_masks as wm
from ..operators import summary as sm
from ..operators import triples as tr
from .monthly import _FLIP, _between, _has, _once, _round, _ten
from .registry import CTES, cte, query

LAST, THRESHOLD = 83, 30_000
#: Lines of a task that sorts them with their masks: compressed they are a few MB, by which adaptive plans would put many such tasks into one that spills.
TASK_LINES = 250_000


class Long:
    def __init__(self, i):
        self.i = i

    def _states(self, *tasks):
        # what a code means is known before the one shuffle of the lines by person, so that it carries flags
        lines = self.i.payroll.select("mi", "person", "org", "unit", "code", "amt", (F.col("code") != "A").alias("salary"), (F.col("code") == "X").alias("is_fixed")).repartition(*tasks, "person")
        lines = lines.select("mi", "person", "org", "unit", F.col("org").alias("region"), "code", "amt", F.lit(1).alias("qty"), F.col("salary").alias("is_pf"), F.col("salary").alias("is_fot"), "is_fixed")
        return tr.triple_state(tr.triples(lines), THRESHOLD)

    @cached_property
    def rows(self):
        """The state of each triple and month beside the masks of its triple and person; worked out where the lines of a person lie."""
        return sm.with_histories(self._states(self.i.table("lineitem").count() // TASK_LINES + 1), LAST)

    @cached_property
    def kinds(self):
        """The state of each triple and month without its sums: all that histories and movements read."""
        return self.i.staged("long_kinds", lambda: self._states().select(*tr.KEYS, "st"))

    @cached_property
    def orgs(self):
        hold = F.when(F.col("r_regionkey") < 2, "h1").when(F.col("r_regionkey") < 4, "h2")
        return self.i.table("region").select(F.col("r_regionkey").cast("int").alias("org"), hold.alias("hold"))

    @cached_property
    def masks(self):
        return self.i.staged("long_masks", lambda: sm._annotated(sm.triple_masks(self.kinds.repartition("person"), LAST), self.orgs))


cte("ltri", f"""SELECT mi, person, org, unit, org AS region, n_rows, n_pay, CASE WHEN pos_pf AND sum_pf > {THRESHOLD} THEN 'P' WHEN pos_pf THEN 'Z' ELSE 'N' END AS st, CASE WHEN pos_pf AND sum_pf > {THRESHOLD} THEN a_pf ELSE 0 END AS pf_amt, CASE WHEN sum_pf > {THRESHOLD} THEN a_pf ELSE 0 END AS fot_amt
 FROM (SELECT mi, person, org, unit, count(*) AS n_rows, CAST(count(*) FILTER (amt > 0) AS BIGINT) AS n_pay, sum(CASE WHEN code <> 'A' THEN amt ELSE 0 END) AS sum_pf, bool_or(code <> 'A' AND amt > 0) AS pos_pf, sum(CASE WHEN code <> 'A' AND amt > 0 THEN amt ELSE 0 END) AS a_pf FROM payroll GROUP BY 1, 2, 3, 4 HAVING bool_or(amt > 0))""", "payroll")
cte("lorgs", "SELECT r_regionkey AS org, CASE WHEN r_regionkey < 2 THEN 'h1' WHEN r_regionkey < 4 THEN 'h2' END AS hold FROM region")
_NAMES = ("tri", "orgs", "kpf", "po", "ph", "min_m", "min_y", "mout_m", "mout_y", "stk")


def _long(sql: str) -> str:
    """A stage's SQL over the payroll's triples."""
    named = re.sub(r"\b(FROM|JOIN) (" + "|".join(_NAMES) + r")\b", r"\1 l\2", sql).replace("<= 29", f"<= {LAST}")
    return re.sub(r"JOIN l(po|ph) ON", r"JOIN l\1 AS \1 ON", named)


for _n in _NAMES[2:]:
    _needs, _body = CTES[_n]
    cte(f"l{_n}", _long(_body), *[f"l{x}" for x in _needs])


@query("history_masks_long", """SELECT person, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, string_agg(mi::VARCHAR, ',' ORDER BY mi) AS paid, coalesce(string_agg(mi::VARCHAR, ',' ORDER BY mi) FILTER (st = 'P'), '') AS in_portfolio,
  coalesce(string_agg(mi::VARCHAR, ',' ORDER BY mi) FILTER (st = 'N'), '') AS other_codes FROM ltri GROUP BY 1, 2, 3""", "ltri")
def _(i):
    m = Long(i).masks
    k = wm.of(m)
    return m.select("person", "org", "unit", *[F.array_join(k.bit_positions(F.col(c), LAST).cast("array<string>"), ",").alias(n) for c, n in (("b_any", "paid"), ("b_p", "in_portfolio"), ("b_n", "other_codes"))])


@query("mask_probes_long", f"""SELECT person, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, CASE WHEN {_long(_has('c', '60'))} THEN 1 ELSE 0 END AS bit60, {_long(_between('c', '55', '65', "h.st = 'P'"))} AS any_55_65, {_long(_ten('c', '66'))} AS tenure66, {_long(_once('c', '59'))} AS once59,
  {_long(_FLIP).replace('c.mi', '65')} >= 3 AS flapping65 FROM (SELECT DISTINCT person, org, unit FROM ltri) c""", "ltri")
def _(i):
    m, at = Long(i).masks, F.lit
    k, a, p, n = wm.of(m), F.col("b_any"), F.col("b_p"), F.col("b_n")
    return m.select("person", "org", "unit", k.mask_bit(a, 60).alias("bit60"), k.any_in(p, at(55), at(65)).alias("any_55_65"), k.tenure_band(p, at(66)).alias("tenure66"), k.one_time(a, at(59)).alias("once59"), k.flapping(a, n, at(65)).alias("flapping65"))


for _t, _k in (("m", 1), ("y", 12)):
    _period = {"m": "month", "y": "year"}[_t]

    @query(f"movement_in_{_period}_long", f"SELECT mi, person, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, lab, round(fl, 4) AS fl, CAST(in_new AS BIGINT) AS in_new, round(in_conc, 4) AS in_conc, CAST(in_temp AS BIGINT) AS in_temp FROM lmin_{_t}", f"lmin_{_t}")
    def _(i, k=_k):
        x = Long(i)
        return sm.movement_in(x.masks, x.kinds, x.orgs, k, LAST)

    @query(f"movement_out_{_period}_long", f"SELECT mi, person, CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, lab, round(fl, 4) AS fl, CAST(out_gone AS BIGINT) AS out_gone, round(out_conc, 4) AS out_conc, CAST(out_temp AS BIGINT) AS out_temp, ten FROM lmout_{_t}", f"lmout_{_t}")
    def _(i, k=_k):
        x = Long(i)
        return sm.movement_out(x.masks, x.kinds, x.orgs, k, LAST)


@query("stock_long", f"SELECT * EXCLUDE (org, unit, region, pf_fl, pf_amt, fot_amt), CAST(org AS BIGINT) AS org, CAST(unit AS BIGINT) AS unit, CAST(region AS BIGINT) AS region, {_round(('pf_fl', 'pf_amt', 'fot_amt'))} FROM lstk", "lstk")
def _(i):
    x = Long(i)
    return sm.stock(x.rows, x.rows, x.orgs)
