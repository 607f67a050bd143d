"""Ordered picks: latest rows, top-n, tails, coverage, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key by an ordered rule. Spell out the null order in ``order``.

    ``row_number() = 1`` lets Spark keep one row per key and task before the shuffle
    (window group limit), so a hot key does not travel whole.
    """
    return (df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .where("_rn = 1").drop("_rn"))


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank_col: str = "rn") -> DataFrame:
    """First n rows per group; at most n rows per group and task reach the shuffle."""
    return df.withColumn(rank_col, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col(rank_col) <= n)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def with_totals(df: DataFrame, sums: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """First k rows, each beside the count and sums of the whole list."""
    total = df.agg(F.struct(F.count(F.lit(1)).alias("n_all"), *[F.sum(s).alias(f"{s}_all") for s in sums]).alias("t")).scalar()
    return top_k(df, order, k).withColumn("t", total).select("*", "t.*").drop("t")


def top_and_rest(df: DataFrame, groups: Sequence[str], key: str, value: str, *, min_share: float | None = None,
                 k: int | None = None, pinned: Sequence = (), rest: str = "others") -> DataFrame:
    """Keys above a share (or the first k) stay, the tail becomes one summed row per group.

    The first k are found by a limited sort (or a limited rank per group), which Spark cuts before the shuffle;
    the other keys are never sorted.
    """
    g = df.groupBy(*groups, key).agg(F.sum(value).alias(value))
    keep = F.lit(False)
    if min_share is not None:
        total = g.groupBy(*groups).agg(F.sum(value).alias("_t"))
        g = g.join(total, list(groups)) if groups else g.withColumn("_t", total.scalar())
        keep = F.col(value) >= min_share * F.col("_t")
    if k is not None:
        order = (F.desc(value), F.asc(key))
        top = g.withColumn("_r", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("_r") <= k) if groups else g.orderBy(*order).limit(k)
        top = top.select(*[F.col(c).alias(f"_{c}") for c in (*groups, key)], F.lit(True).alias("_keep"))
        same = F.lit(True)
        for c in (*groups, key):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        g = g.join(top, same, "left")
        keep = F.coalesce("_keep", F.lit(False))
    if pinned:
        keep = keep | F.col(key).isin(list(pinned))
    label = F.when(keep, F.col(key).cast("string")).otherwise(rest)
    return g.groupBy(*groups, label.alias(key)).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n_keys"))


def material_cover(df: DataFrame, groups: Sequence[str], value: str, tie: str, cover: float = 0.6, cap: int = 8,
                   floor: float = 0.0) -> DataFrame:
    """Largest rows until they explain ``cover`` of the group, at most ``cap``, none below ``floor``.

    Only the first ``cap`` rows per group can be chosen, so the running sum is built over those.
    """
    total = df.groupBy(*groups).agg(F.sum(value).alias("_total"))
    head = top_n_per_group(df, groups, [F.desc(value), F.asc(tie)], cap, "_rn")
    run = W.partitionBy(*groups).orderBy("_rn").rowsBetween(W.unboundedPreceding, -1)
    return (head.join(total, list(groups)).withColumn("_before", F.coalesce(F.sum(value).over(run), F.lit(0)))
            .where((F.col("_before") < cover * F.col("_total")) & (F.col(value) >= floor))
            .drop("_rn", "_before").withColumnRenamed("_total", "group_total"))


def cover_tail(df: DataFrame, picked: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """What the picked rows leave out: rows and amount per group."""
    a = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    p = picked.groupBy(*groups).agg(F.count(F.lit(1)).alias("np"), F.sum(value).alias("vp"))
    return a.join(p, list(groups), "left").select(
        *groups, (F.col("n") - F.coalesce("np", F.lit(0))).alias("n_rest"), (F.col("v") - F.coalesce("vp", F.lit(0))).alias("rest"))


def running_cover(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, target: str) -> DataFrame:
    """Smallest leading set whose sum reaches the target: a row is needed while the sum before it is short.

    A two-level running sum keeps a hot group out of one task: rows are range-bucketed by the first
    order column, bucket sums are accumulated over the few buckets, and rows only within a bucket.
    """
    w = W.partitionBy(*groups, "_bucket").orderBy(*order)
    inner = F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = df.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*groups).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*groups, "_bucket", before.alias("_before"))
    return (df.withColumn("_inner", inner).join(sums, [*groups, "_bucket"])
            .withColumn("sum_before", F.col("_before") + F.col("_inner")).where(F.col("sum_before") < F.col(target))
            .drop("_bucket", "_inner", "_before"))


def bucket_by(value: Column, width: float) -> Column:
    """Bucket number for ``running_cover``: larger values lie in larger buckets."""
    return F.floor(value / F.lit(width)).alias("_bucket")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Median per key without bringing a key's rows into one task.

    Bucket counts (partial aggregation) locate the buckets of the two middle ranks; only their rows are
    ranked, with the number of rows before the bucket as offset.
    """
    x = df.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / width))
    per = x.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    cum = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b"))
    tot = F.sum("_n").over(W.partitionBy(*keys))
    marks = per.select(*keys, "_b", (cum - F.col("_n")).alias("_before"), cum.alias("_upto"), tot.alias("_tot"))
    lo, hi = F.floor((F.col("_tot") + 1) / 2), F.floor((F.col("_tot") + 2) / 2)
    need = marks.where(((F.col("_before") < lo) & (lo <= F.col("_upto"))) | ((F.col("_before") < hi) & (hi <= F.col("_upto"))))
    rows = x.join(need, [*keys, "_b"]).groupBy(*keys, "_b", value, "_before", "_tot").agg(F.count(F.lit(1)).alias("_k"))
    end = F.col("_before") + F.sum("_k").over(W.partitionBy(*keys, "_b").orderBy(value))
    r = rows.select(*keys, value, "_tot", (end - F.col("_k")).alias("_s"), end.alias("_e"))
    pick = lambda rank: F.max(F.when((F.col("_s") < rank) & (rank <= F.col("_e")), F.col(value)))
    return r.groupBy(*keys).agg(((pick(lo) + pick(hi)) / 2).alias("median"))
