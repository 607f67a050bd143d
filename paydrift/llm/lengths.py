"""Token counts from an exact length histogram.

Documents are counted by encoded length (a hot length is one partial count per task), and suffix sums over
the lengths answer document and token totals, quantiles and truncated totals for every context limit. Sums
run inside blocks of ``BLOCK`` neighbouring lengths and over the blocks' totals, so no task sees all lengths.

Null and empty texts have length 0 and count. An empty table gives an empty histogram. ``n_tokens`` is
replaced if the table has it; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode
from .texts import table, work_table

BLOCK = 256


def histogram(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    coded = encode(docs.select(text), path, text).select("n_tokens")
    return coded.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit:

    n_docs of exactly this length, docs_at_least and tokens_at_least over this and longer ones, docs_total,
    tokens_total, share of documents that fit, and truncated_total, the tokens left when longer ones are cut.
    """
    block = F.floor(F.col("n_tokens") / BLOCK).cast("long")
    rows = hist.select("n_tokens", "n_docs", block.alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("n_sum"))
    of_block = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("n_sum").alias("b_sum"))
    longer = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_block = of_block.select("block", *[F.coalesce(F.sum(x).over(longer), F.lit(0)).alias(f"{x}_longer") for x in ("b_docs", "b_sum")],
                               F.sum("b_docs").over(every).alias("docs_total"), F.sum("b_sum").over(every).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("n_tokens", "n_docs", "block", F.sum("n_docs").over(inside).alias("i_docs"), F.sum("n_sum").over(inside).alias("i_sum"))
    docs, tokens = F.col("i_docs") + F.col("b_docs_longer"), F.col("i_sum") + F.col("b_sum_longer")
    return rows.join(of_block, "block").select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "docs_total", "tokens_total",
        ((F.col("docs_total") - docs + F.col("n_docs")) / F.col("docs_total")).alias("share_fitting"),
        (F.col("tokens_total") - tokens + F.col("n_tokens") * docs).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the shortest length that at least this share of the documents does not exceed."""
    asked = sums.select("n_tokens", F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs"), "docs_total").toDF("n_tokens", "upto", "docs_total")
    hit = asked.select("n_tokens", F.explode(F.filter(F.array(*map(F.lit, shares)), lambda s: F.col("upto") >= s * F.col("docs_total"))).alias("share"))
    return hit.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context, tokens, docs_cut for any limits, also ones that no document has as its length."""
    asked = sums.select("n_tokens", "docs_at_least", "tokens_at_least", "tokens_total", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context"))
    over = asked.groupBy("context").agg(F.max("tokens_total").alias("total"), F.min(F.when(F.col("n_tokens") > F.col("context"), F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias("next"))
    docs, tokens = (F.coalesce(F.col(f"next.{x}"), F.lit(0)) for x in ("docs_at_least", "tokens_at_least"))
    return over.select("context", (F.col("total") - tokens + F.col("context") * docs).alias("tokens"), docs.alias("docs_cut"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two sums read the histogram: it is written once, one small row per length
    return suffix_sums(work_table(histogram(table(spark, sf_dir, "documents")), "lengths"))


QUERIES = {"op7_token_counts": op7_token_counts}
