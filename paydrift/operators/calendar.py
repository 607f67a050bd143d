"""Calendar shift of payments: daily fact by calendar month and by the 16–15 window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from .triples import in_portfolio

WINDOW_KEYS = ("mi", "person", "org", "unit")


def _n() -> Column:
    return F.count(F.lit(1))


def day_window(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and money per pay day around the month border."""
    return lines.groupBy(*keys).agg(_n().alias("n_rows"), F.sum("amt").alias("amt"))


def half_months(lines: DataFrame, border: int = 15) -> DataFrame:
    """The daily fact folded once to half months: every later window is a sum of these."""
    half = F.when(F.dayofmonth("day") <= border, 1).otherwise(2)
    pf, fixed, pos = F.col("is_pf"), F.col("is_fixed"), F.col("amt") > 0
    return lines.groupBy(*WINDOW_KEYS, half.alias("half")).agg(
        F.min("region").alias("region"), F.sum(F.when(pf, F.col("amt"))).alias("sum_pf"), F.bool_or(pf & pos).alias("pos_pf"),
        F.bool_or(fixed & pos).alias("pos_fixed"))


def windows_from_halves(halves: DataFrame, threshold, exempt: DataFrame | None = None) -> DataFrame:
    """Half months regrouped to calendar (cal) and shifted (sh) windows; the threshold is applied after.

    A first half counts in its own month for both kinds, a second half in the next month when shifted.
    """
    to = F.explode(F.array(F.struct(F.lit("cal").alias("kind"), F.col("mi").alias("period")),
                           F.struct(F.lit("sh").alias("kind"), F.when(F.col("half") == 1, F.col("mi")).otherwise(F.col("mi") + 1).alias("period"))))
    g = halves.withColumn("w", to).groupBy("w.kind", "w.period", "person", "org", "unit").agg(
        F.min("region").alias("region"), F.sum("sum_pf").alias("sum_pf"), F.bool_or("pos_pf").alias("pos_pf"), F.bool_or("pos_fixed").alias("pos_fixed"))
    if exempt is not None:
        g = g.join(exempt.select("org").distinct().withColumn("exempt", F.lit(True)), "org", "left")
        free = F.coalesce(F.col("exempt"), F.lit(False))
    else:
        free = F.lit(False)
    return g.where(in_portfolio(threshold, free)).select("kind", F.col("period").alias("mi"), "person", "org", "unit", "region", "sum_pf")


def calendar_triples(windows: DataFrame, keys: Sequence[str] = ("mi", "org", "unit")) -> DataFrame:
    """Triples in portfolio by the calendar month, by the 16–15 window, and in both."""
    t = windows.groupBy("mi", "person", "org", "unit").agg(F.min("region").alias("region"), F.bool_or(F.col("kind") == "cal").alias("c"), F.bool_or(F.col("kind") == "sh").alias("s"))
    return t.groupBy(*keys).agg(F.min("region").alias("region"), F.count_if("c").alias("n_cal"), F.count_if("s").alias("n_sh"), F.count_if(F.col("c") & F.col("s")).alias("n_both"))


def _exact(df: DataFrame, keys: Sequence[str], cols: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Columns of exactly ``lag`` periods earlier, NULL where that period has no row."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("mi")
    return df.withColumns({f"{c}_{k}": F.max(c).over(w.rangeBetween(-k, -k)) for c in cols for k in lags})


def year_excess(df: DataFrame, keys: Sequence[str], cols: Sequence[str], year: int = 12) -> DataFrame:
    """(M − M₋₁) − (M₋₁₂ − M₋₁₃) per column, NULL unless all four periods are there."""
    x = _exact(df, keys, cols, (1, year, year + 1))
    return x.select(*keys, "mi", *[((F.col(c) - F.col(f"{c}_1")) - (F.col(f"{c}_{year}") - F.col(f"{c}_{year + 1}"))).alias(f"{c}_excess") for c in cols])


def calendar_boundary(calendar: DataFrame, monthly: DataFrame, year: int = 12, tol: float = 0.005, vanish: float = 0.2) -> DataFrame:
    """Excess over last year by calendar month = border shift + remainder, with a verdict.

    Only where the daily and the monthly tables agree within the tolerance in all four periods.
    ``calendar``: mi, n_cal, n_sh; ``monthly``: mi, pf.
    """
    c = calendar.groupBy("mi").agg(F.sum("n_cal").alias("cal"), F.sum("n_sh").alias("sh"))
    j = c.join(monthly.groupBy("mi").agg(F.sum("pf").alias("pf")), "mi", "left")
    j = j.withColumn("off", F.abs(F.col("cal") - F.col("pf")) / F.col("pf"))
    x = _exact(j, [], ["off"], (1, year, year + 1))
    worst = F.when(F.col("off").isNotNull() & F.col("off_1").isNotNull() & F.col(f"off_{year}").isNotNull() & F.col(f"off_{year + 1}").isNotNull(),
                   F.greatest("off", "off_1", f"off_{year}", f"off_{year + 1}"))
    e = year_excess(j, [], ["cal", "sh", "pf"], year).join(x.select("mi", worst.alias("sync_gap")), "mi")
    border, rest, gap = F.col("cal_excess") - F.col("sh_excess"), F.col("sh_excess"), F.col("pf_excess") - F.col("cal_excess")
    verdict = (F.when(F.col("sync_gap").isNull(), "cannot compare").when(F.col("sync_gap") > tol, "sources differ")
               .when(F.col("cal_excess").isNull() | F.col("sh_excess").isNull(), "unknown")
               .when(F.abs(rest) < vanish * F.abs("cal_excess"), "calendar").otherwise("other reasons"))
    return e.select("mi", F.col("pf_excess").alias("monthly_excess"), border.alias("border_shift"), rest.alias("remainder"), gap.alias("source_gap"),
                    fc.share(border, "pf_excess").alias("border_share"), "sync_gap", verdict.alias("verdict"))


def boundary_by_slice(calendar: DataFrame, key: str, mi: int, year: int = 12) -> DataFrame:
    """The same split by one slice for one month."""
    c = calendar.groupBy(key, "mi").agg(F.sum("n_cal").alias("cal"), F.sum("n_sh").alias("sh"))
    e = year_excess(c, [key], ["cal", "sh"], year).where(F.col("mi") == mi)
    return e.select(key, "cal_excess", "sh_excess", (F.col("cal_excess") - F.col("sh_excess")).alias("border_shift"))


def largest_months(monthly: DataFrame, k: int, year: int = 12) -> DataFrame:
    """Months that differ most from last year."""
    return year_excess(monthly, [], ["pf"], year).where("pf_excess is not null").orderBy(F.desc(F.abs("pf_excess")), "mi").limit(k)
