"""Connected components of an edge table, on Spark: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import work_table


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """u, root: for every node of ``edges`` (u, v) but the roots, the smallest node it is connected to.

    Every step rewires nodes to smaller neighbours, so the table ends as stars around the smallest nodes; each
    step's table is written to the shared folder.
    """
    e = work_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        e = work_table(small, "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select("u", F.col("v").alias("root"))
