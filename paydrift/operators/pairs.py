"""Pairs of a person's places whose number is the product of two lists, in joins whose keys have a bounded number of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of one side of a person that meet in one key of the join.
BLOCK = 512


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Inner join of two lists per key, each pair once.

    Where a key has more than ``block`` rows on a side, both of its lists are dealt into blocks by a hash of the row, and every
    block of one side meets every block of the other under a key of its own: a heavy person is many small keys, and a row is
    copied once for each block of the other side. Keys that are heavy on neither side, nearly all, are joined as they are.
    Repeated rows are pairs of their own. The list of heavy keys is joined, never collected.
    """
    keys = list(keys)
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)
    heavy = n.where((F.col("_l") > block) | (F.col("_r") > block)).select(*keys, *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("_l", "_r")])

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        x = df.join(heavy, keys, "left").na.fill(1, ["_l", "_r"])
        return x.select(*keys, *rest, F.pmod(F.xxhash64(*rest), own).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    return dealt(left, "_l", "_r", "_a", "_b").join(dealt(right, "_r", "_l", "_b", "_a"), [*keys, "_a", "_b"]).drop("_a", "_b")
