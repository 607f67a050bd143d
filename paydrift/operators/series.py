"""Period series: changes, breaks, direction, bridges, windows with unknown values, features of the past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc


def _w(keys: Sequence[str]):
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy("mi")


def scaffold(df: DataFrame, keys: Sequence[str], first: int, last: int, zeros: Sequence[str] = (), flag: str | None = None) -> DataFrame:
    """Complete period index per key; zeros where asked, NULL elsewhere, and a presence flag.

    Every key is exploded over a fixed list of periods, so no cross join is planned.
    """
    grid = df.select(*keys).distinct().withColumn("mi", F.explode(F.sequence(F.lit(first), F.lit(last))))
    own = df.select(*[F.col(c).alias(f"_{c}") for c in df.columns], F.lit(True).alias("_present"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("mi") == F.col("_mi")]
    rest = [c for c in df.columns if c not in (*keys, "mi")]
    vals = [(F.coalesce(f"_{c}", F.lit(0)) if c in zeros else F.col(f"_{c}")).alias(c) for c in rest]
    mark = [F.coalesce("_present", F.lit(False)).alias(flag)] if flag else []
    return grid.join(own, on, "left").select(*keys, "mi", *vals, *mark)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that are equal or both NULL."""
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    return left.join(right, on, how).select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in keys])


def lag_delta(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Previous value, change and relative change on a complete index."""
    p = F.lag(value).over(_w(keys))
    return df.select("*", p.alias("prev"), (F.col(value) - p).alias("delta"), fc.share(F.col(value) - p, p).alias("pct"))


def series_changes(df: DataFrame, keys: Sequence[str], value: str, persons: str | None = None, year: int = 12) -> DataFrame:
    """Change to the previous period and to a year ago, both relative too, and jobs per person."""
    w = _w(keys)
    p, y = F.lag(value, 1).over(w), F.lag(value, year).over(w)
    cols = {"mom": F.col(value) - p, "mom_pct": fc.share(F.col(value) - p, p), "yoy": F.col(value) - y, "yoy_pct": fc.share(F.col(value) - y, y)}
    if persons:
        cols["per_person"] = fc.share(value, persons)
    return df.withColumns(cols)


def seasonal_profile(changes: DataFrame, year: int = 12) -> DataFrame:
    """Change to the previous period by place in the year, for the last year and the one before it."""
    last = changes.agg(F.max("mi")).scalar()
    k = F.floor((last - F.col("mi")) / year)
    return changes.where(F.col("mom").isNotNull()).select("mi", (F.col("mi") % year).alias("slot"), k.alias("years_back"), "mom", "mom_pct").where("years_back <= 1")


def step_months(changes: DataFrame, keys: Sequence[str], k_mad: float = 3.5, min_yearly: int = 3, of_change: bool = False,
                drops_only: bool = True) -> DataFrame:
    """Break periods: the yearly change is off its median by more than ``k_mad`` median deviations.

    With fewer than ``min_yearly`` yearly changes the neighbouring period is used, and said so. A zero
    MAD falls back to the mean deviation. ``of_change`` scans the period-to-period change of it.
    """
    g = list(keys)
    wk = W.partitionBy(*(g or [F.lit(0)]))
    use_year = F.count("yoy").over(wk) >= min_yearly
    x = changes.withColumns({"measured": F.when(use_year, "yoy").otherwise("mom"), "v": F.when(use_year, F.col("yoy")).otherwise(F.col("mom"))}).where("v is not null")
    if of_change:
        x = x.withColumn("v", F.col("v") - F.lag("v").over(_w(g))).where("v is not null")
    x = x.withColumn("med", F.median("v").over(wk)).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    x = x.withColumn("mad", F.median("dev").over(wk)).withColumn("mad", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.avg("dev").over(wk)))
    x = x.where("mad > 0").withColumn("score", (F.col("v") - F.col("med")) / F.col("mad"))
    hit = (F.col("score") <= -k_mad) if drops_only else (F.abs("score") > k_mad)
    return x.where(hit).select(*g, "mi", "measured", F.col("v").alias("delta"), "score")


def direction(df: DataFrame, keys: Sequence[str], value: str, k: int = 3, flat: float = 0.05) -> DataFrame:
    """Mean of the last k periods against the k before: grows, falls or holds."""
    g = list(keys)
    n = F.count(F.lit(1)).over(W.partitionBy(*(g or [F.lit(0)])))
    r = F.row_number().over(W.partitionBy(*(g or [F.lit(0)])).orderBy(F.desc("mi")))
    x = df.select(*g, value, n.alias("n"), r.alias("r")).withColumn("k", F.least(F.lit(k), F.floor(F.col("n") / 2)))
    a = x.groupBy(*g).agg(F.max("n").alias("n"), F.avg(F.when(F.col("r") <= F.col("k"), F.col(value))).alias("last"),
                          F.avg(F.when((F.col("r") > F.col("k")) & (F.col("r") <= 2 * F.col("k")), F.col(value))).alias("prev"))
    rel = F.coalesce(F.try_divide(F.col("last") - F.col("prev"), F.col("prev")), F.lit(0.0))
    word = F.when(F.abs(rel) < flat, "holds").when(F.col("last") > F.col("prev"), "grows").otherwise("falls")
    return a.select(*g, (F.col("n") >= 2).alias("measurable"), "last", "prev", F.when(F.col("n") >= 2, rel).alias("rel"), F.when(F.col("n") >= 2, word).alias("word"))


def month_compare(df: DataFrame, value: str, mi: int, year: int = 12) -> DataFrame:
    """The report period against its neighbours and a year ago."""
    at = {"prev": mi - 1, "cur": mi, "next": mi + 1, "year_ago": mi - year}
    one = df.where(F.col("mi").isin(list(at.values()))).agg(*[F.max(F.when(F.col("mi") == m, F.col(value))).alias(t) for t, m in at.items()])
    return one.select("*", (F.col("cur") - F.col("prev")).alias("mom"), (F.col("cur") - F.col("year_ago")).alias("yoy"), (F.col("next") - F.col("cur")).alias("to_next"))


def bridge(df: DataFrame, value: str, mi: int, year: int = 12) -> DataFrame:
    """m−1 → m → m+1 this year and a year ago: levels, changes, difference of changes, verdict.

    One row; empty when one of the six periods is missing.
    """
    at = {f"{p}{t}": mi + d - (year if p == "y_" else 0) for p in ("", "y_") for t, d in (("prev", -1), ("cur", 0), ("next", 1))}
    one = df.where(F.col("mi").isin(list(at.values()))).agg(
        F.count_distinct("mi").alias("n"), *[F.max(F.when(F.col("mi") == m, F.col(value))).alias(t) for t, m in at.items()]).where(F.col("n") == 6).drop("n")
    c = F.col
    x = one.withColumns({"did_cur": (c("cur") - c("prev")) - (c("y_cur") - c("y_prev")), "did_next": (c("next") - c("cur")) - (c("y_next") - c("y_cur"))})
    verdict = (F.when((c("did_cur") < 0) & (c("did_next") >= -c("did_cur")), "shift").when((c("did_cur") < 0) & (c("did_next") > 0), "partly back")
               .when(c("did_cur") < 0, "loss").otherwise("no drop"))
    return x.withColumns({"two_periods": c("did_cur") + c("did_next"), "verdict": verdict})


def window_sum_known(df: DataFrame, keys: Sequence[str], value: str, length: int, bases: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """Sum over the last ``length`` periods, NULL when one is unknown, beside shifted bases of it.

    A base is the mean of the window at the given lags; one unknown lag makes it unknown.
    """
    w = _w(keys)
    frame = w.rowsBetween(-(length - 1), 0)
    x = df.withColumn("win", F.when(F.count(value).over(frame) == length, F.sum(value).over(frame)))
    cols = {}
    for name, lags in (bases or {}).items():
        parts = [F.lag("win", k).over(w) for k in lags]
        cols[f"base_{name}"] = sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.0)
    return x.withColumns(cols) if cols else x


def history_features(df: DataFrame, keys: Sequence[str], value: str, ks: Sequence[int] = (3, 6, 12), alpha: float = 0.5, present: str = "present",
                     depth: int = 12) -> DataFrame:
    """Mean, median and weighted mean of the periods strictly before, where the row existed."""
    w = _w(keys)
    x = df.withColumn("_x", F.when(F.col(present), F.col(value).cast("double")))
    cols = {}
    for k in ks:
        f = w.rowsBetween(-k, -1)
        cols[f"mean_{k}"] = F.avg("_x").over(f)
        cols[f"median_{k}"] = F.percentile("_x", 0.5).over(f)
    num, den = F.lit(0.0), F.lit(0.0)
    for j in range(1, depth + 1):
        wgt, v = alpha * (1 - alpha) ** (j - 1), F.lag("_x", j).over(w)
        num, den = num + F.coalesce(v * wgt, F.lit(0.0)), den + F.when(v.isNotNull(), wgt).otherwise(0.0)
    cols["ewma"] = F.try_divide(num, den)
    return x.withColumns(cols).drop("_x")


def history_rate(df: DataFrame, keys: Sequence[str], part: str, whole: str, k: int, present: str = "present", shrink: float = 0.0, prior: Column | None = None) -> DataFrame:
    """Sum of one measure over the sum of another in the k periods before; optionally shrunk to a prior."""
    f = _w(keys).rowsBetween(-k, -1)
    p = F.sum(F.when(F.col(present), F.col(part).cast("double"))).over(f)
    q = F.sum(F.when(F.col(present), F.col(whole).cast("double"))).over(f)
    rate = F.try_divide(p, q) if prior is None else F.try_divide(p + shrink * prior, q + F.lit(shrink))
    return df.withColumn("rate", rate)
