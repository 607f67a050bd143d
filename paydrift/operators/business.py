"""Business review of the panel: the month with the biggest change, its flows, and the change over last year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from .calendar import _exact

ATOM = ("seg_rep", "region", "unit")
# Flows with their sign.
FLOWS = (("m_in_from_outside", 1), ("m_out_left_bank", -1), ("m_in_from_other_org", 1), ("m_out_to_other_org", -1), ("m_in_codes", 1), ("m_out_codes", -1))
REASONS = (("m_lb_one_time", -1), ("m_lb_seasonal", -1), ("m_lb_org_stopped", -1), ("m_lb_unknown", -1), ("m_out_temp_left", -1), ("m_in_temp_outside", 1))
STOCK_MARKS = ("single_pay_recip", "one_time_pf", "multi_recip")


def bank_totals(atoms: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Totals per period over atoms; one active atom with an unknown value makes the total unknown."""
    active = F.col("pf_recip").isNotNull() | F.col("m_base_pf").isNotNull()
    return atoms.groupBy(*by, "mi").agg(*[fc.sum_known(m, active).alias(m) for m in measures])


def business_history(atoms: DataFrame) -> DataFrame:
    """Per period: change, flows, residual, and the volume of change including opposite moves of atoms."""
    m = [f for f, _ in FLOWS]
    t = _exact(bank_totals(atoms, ["pf_recip", "m_base_pf", *m]), [], ["pf_recip"], (1,))
    change = F.col("pf_recip") - F.col("pf_recip_1")
    net = sum((s * F.col(f) for f, s in FLOWS[1:]), FLOWS[0][1] * F.col(FLOWS[0][0]))
    a = _exact(atoms, list(ATOM), ["pf_recip"], (1,)).where("pf_recip_1 is not null").groupBy("mi").agg((0.5 * F.sum(F.abs(F.col("pf_recip") - F.col("pf_recip_1")))).alias("opposite"))
    x = t.where("pf_recip_1 is not null").join(a, "mi", "left")
    return x.select("mi", F.col("pf_recip_1").alias("was"), F.col("pf_recip").alias("now"), change.alias("change"), net.alias("net_flow"), (change - net).alias("residual"),
                    (F.coalesce(F.abs(change - net), F.lit(1.0)) <= 0.5).alias("verified"), F.greatest(F.abs(change), "opposite").alias("volume"))


def business_month(atoms: DataFrame, mi: int | None = None) -> DataFrame:
    """Flows of the chosen period, or of the one with the biggest change: contribution of each movement."""
    h = business_history(atoms)
    pick = F.lit(mi) if mi is not None else h.agg(F.max_by("mi", F.struct("volume", (-F.col("mi")).alias("p")))).scalar()
    t = bank_totals(atoms, [f for f, _ in FLOWS]).where(F.col("mi") == pick)
    rows = ", ".join(f"'{f}', cast({s} * {f} as double)" for f, s in FLOWS)
    flows = t.selectExpr("mi", f"stack({len(FLOWS)}, {rows}) as (movement, contribution)")
    rest = h.where(F.col("mi") == pick).select("mi", F.lit("residual").alias("movement"), F.col("residual").cast("double").alias("contribution"))
    return flows.unionByName(rest)


def business_slices(atoms: DataFrame, key: str, mi: int) -> DataFrame:
    """Change of one period by a slice of the atoms."""
    t = _exact(bank_totals(atoms, ["pf_recip"], [key]), [key], ["pf_recip"], (1,)).where(F.col("mi") == mi)
    return t.select(key, F.col("pf_recip_1").alias("was"), F.col("pf_recip").alias("now"), (F.col("pf_recip") - F.col("pf_recip_1")).alias("change"))


def business_yoy(atoms: DataFrame, year: int = 12) -> DataFrame:
    """(M − M₋₁) − (M₋₁₂ − M₋₁₃) for the whole, every period where the four are there."""
    t = _exact(bank_totals(atoms, ["pf_recip", "pf_fl"]), [], ["pf_recip", "pf_fl"], (1, year, year + 1))
    def d(c: str) -> tuple[Column, Column]:
        return F.col(c) - F.col(f"{c}_1"), F.col(f"{c}_{year}") - F.col(f"{c}_{year + 1}")
    (a, b), (p, q) = d("pf_recip"), d("pf_fl")
    return t.select("mi", a.alias("this_year"), b.alias("last_year"), (a - b).alias("excess"), ((p - q)).alias("excess_persons")).where("excess is not null")


def yoy_flows(atoms: DataFrame, mi: int, year: int = 12) -> DataFrame:
    """Excess over last year split by flows, leaving reasons, calendar marks and stock marks."""
    signed = [*FLOWS, *REASONS]
    t = bank_totals(atoms, [*dict.fromkeys([m for m, _ in signed] + list(STOCK_MARKS))])
    x = _exact(t, [], [*dict.fromkeys([m for m, _ in signed])], (year,))
    x = _exact(x, [], list(STOCK_MARKS), (1, year, year + 1)).where(F.col("mi") == mi)
    rows = [f"'{m}', cast({s} * {m} as double), cast({s} * {m}_{year} as double)" for m, s in signed]
    rows += [f"'stock {m}', cast({m} - {m}_1 as double), cast({m}_{year} - {m}_{year + 1} as double)" for m in STOCK_MARKS]
    return x.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (mark, this_year, last_year)").withColumn("excess", F.col("this_year") - F.col("last_year"))


def yoy_explanation(atoms: DataFrame, mi: int, year: int = 12) -> DataFrame:
    """Non-overlapping parts of the excess, adding up to it with the residual."""
    f = yoy_flows(atoms, mi, year).agg(*[F.max(F.when(F.col("mark") == m, F.col("excess"))).alias(m) for m, _ in (*FLOWS, *REASONS)])
    total = business_yoy(atoms, year).where(F.col("mi") == mi).agg(F.max("excess")).scalar().cast("double")
    c = F.col
    parts = {"temporary leave": c("m_out_temp_left"), "return after temporary leave": c("m_in_temp_outside"), "permanent leave": c("m_out_left_bank") - c("m_out_temp_left"),
             "arrivals without returns": c("m_in_from_outside") - c("m_in_temp_outside"), "between organisations": c("m_in_from_other_org") + c("m_out_to_other_org"),
             "codes": c("m_in_codes") + c("m_out_codes")}
    one = f.select(*[v.alias(k) for k, v in parts.items()], total.alias("total")).withColumn("residual", F.col("total") - sum((F.col(f"`{k}`") for k in list(parts)[1:]), F.col(f"`{list(parts)[0]}`")))
    keys = [*parts, "residual"]
    return one.selectExpr("total", f"stack({len(keys)}, " + ", ".join(f"'{k}', `{k}`" for k in keys) + ") as (part, excess)").select("part", "excess", fc.share("excess", "total").alias("share"))


def neighbour_case(atoms: DataFrame, mi: int, year: int = 12, measures: Sequence[str] = ("pf_recip", "m_in_from_outside", "m_out_left_bank", "m_out_temp_left", "m_in_temp_outside", "single_pay_recip")) -> DataFrame:
    """Facts of m−1, m, m+1 in two years side by side."""
    t = bank_totals(atoms, measures)
    at = {f"{y}_{n}": mi + d - k for y, k in (("now", 0), ("ago", year)) for n, d in (("prev", -1), ("cur", 0), ("next", 1))}
    rows = ", ".join(f"'{m}', cast({m} as double)" for m in measures)
    long = t.where(F.col("mi").isin(list(at.values()))).selectExpr("mi", f"stack({len(measures)}, {rows}) as (measure, v)")
    return long.groupBy("measure").agg(*[F.max(F.when(F.col("mi") == m, F.col("v"))).alias(n) for n, m in at.items()])
