"""Reads: period scans with partition pruning, archive unions, dimensions, column discovery, guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Rename a source to the library's column names; the mapping is the whole schema knowledge."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in mapping.items()])


def scan_period(df: DataFrame, period_col: str, period, columns: Sequence[str] | None = None) -> DataFrame:
    """One period of a fact: the filter on the partition column prunes directories."""
    out = df.where(F.col(period_col) == F.lit(period))
    return out.select(*columns) if columns else out


def scan_periods(df: DataFrame, period_col: str, periods: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    out = df.where(F.col(period_col).isin(list(periods)))
    return out.select(*columns) if columns else out


def scan_range(df: DataFrame, day_col: str, first, last, columns: Sequence[str] | None = None) -> DataFrame:
    out = df.where(F.col(day_col).between(F.lit(first), F.lit(last)))
    return out.select(*columns) if columns else out


def scan_archive_union(archive: DataFrame, current: DataFrame, period_col: str, split,
                       columns: Sequence[str]) -> DataFrame:
    """Archive up to the split, live table after it, tagged with the source, duplicates removed."""
    old = archive.where(F.col(period_col) <= F.lit(split)).select(*columns, F.lit("archive").alias("source"))
    new = current.where(F.col(period_col) > F.lit(split)).select(*columns, F.lit("current").alias("source"))
    return old.unionByName(new).distinct()


def scan_dimension_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def discover_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First of the candidate names the table has; stop when there is none."""
    have = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in have:
            return have[name.lower()]
    raise LookupError(f"none of {list(candidates)} in {df.columns}")


def discover_columns(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Candidate names with a found flag, read from the schema alone."""
    spark = df.sparkSession
    have = {c.lower() for c in df.columns}
    return spark.createDataFrame([(n, n.lower() in have) for n in candidates], "name string, found boolean")


def narrow_copy(fact: DataFrame, period_col: str, columns: Sequence[str], work: Sequence, series: Sequence,
                series_filter: Column) -> DataFrame:
    """The single read of the big fact: every row of work periods, only useful rows of series periods."""
    p = F.col(period_col)
    series_only = [s for s in series if s not in set(work)]
    keep = p.isin(list(work)) | (p.isin(series_only) & F.coalesce(series_filter, F.lit(False)))
    return fact.where(p.isin(list(work) + series_only)).where(keep).select(*columns)


def level_filter(mart: DataFrame, level: str, org_type: str, level_col: str = "level_name",
                 type_col: str = "org_type") -> DataFrame:
    """The filter every reader of a multi-level mart must apply so that levels never mix."""
    return mart.where((F.col(level_col) == level) & (F.col(type_col) == org_type))


class TooManyRows(RuntimeError):
    """A result meant for the driver is larger than agreed; it is refused, never cut."""


def collect_guard(df: DataFrame, limit: int = 1_000_000):
    """Rows as pandas, only when there are at most ``limit`` of them."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise TooManyRows(f"more than {limit} rows")
    return rows


def source_probe(df: DataFrame, period_col: str, key_cols: Sequence[str], fill_cols: Sequence[str]) -> DataFrame:
    """Rows, periods, distinct keys and fill shares of a source in one pass."""
    n = F.count(F.lit(1))
    aggs = [n.alias("n_rows"), F.min(period_col).alias("first_period"), F.max(period_col).alias("last_period")]
    aggs += [F.countDistinct(F.col(k)).alias(f"n_{k}") for k in key_cols]
    aggs += [F.try_divide(F.count(F.col(c)), n).alias(f"fill_{c}") for c in fill_cols]
    return df.agg(*aggs)


def key_match_rate(fact: DataFrame, candidates: Sequence[str], dim: DataFrame, dim_key: str) -> DataFrame:
    """Which candidate key the dimension recognises, over distinct keys and over rows.

    All candidates are counted in one pass (stack), so the fact is read once.
    """
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in candidates)
    keys = (fact.selectExpr(f"stack({len(candidates)}, {pairs}) as (candidate, key)")
            .groupBy("candidate", "key").agg(F.count(F.lit(1)).alias("n")))
    known = dim.select(F.col(dim_key).cast("string").alias("key")).distinct().withColumn("hit", F.lit(True))
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return (keys.join(known, "key", "left").groupBy("candidate")
            .agg(F.count_if(F.col("key").isNotNull()).alias("n_keys"), F.count_if(hit).alias("n_known"),
                 F.sum("n").alias("n_rows"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_known_rows"))
            .withColumn("row_share", F.try_divide(F.col("n_known_rows"), F.col("n_rows"))))


def choose_key(rates: DataFrame, min_share: float) -> DataFrame:
    """Best recognised candidate, or no row when none reaches the share."""
    best = F.max_by(F.struct("candidate", "row_share"), F.struct("row_share", "n_known", F.col("candidate")))
    return rates.agg(best.alias("b")).select("b.*").where(F.col("row_share") >= min_share)
