"""Quality rules in DataFrame functions only: base counts, and a hashed n-gram log-likelihood ratio.

Every document is thresholded by fixed base rules and by how much likelier a multinomial over trusted documents
makes its n-grams than one over the whole corpus. N-grams (one and two tokens; a token is a run of letters and digits
or a run of other signs) are hashed into ``BUCKETS`` buckets; both multinomials are counted over all documents with
add-``SMOOTH`` smoothing, the ratio is averaged over the document's n-grams and compared with ``LEAST_RATIO``. The
trusted documents are all those labelled with quality 1. The model is one array of fixed length in a scalar subquery.

Null texts count as empty: no words, base_failed. A document without n-grams has ratio 0. Repeated rows count as often
as they stand in the table; repeated labels of a document count once, the largest; null ids are never trusted.
Without trusted documents the target is uniform. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import table

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
STEPS = (1, 2, 4)  # windows of 2, 4, 8 words: 1 + sum(STEPS) is WINDOW
BUCKETS, SMOOTH, LEAST_RATIO = 1 << 14, 1.0, -0.05
SPACE = "[ \\x09\\x0A\\x0B\\x0C\\x0D]"  # listed one by one: a range is slower to match
TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def neighbour_hashes(keys: Column, step: int = 1) -> Column:
    """A hash of every two keys that stand ``step`` places apart."""
    n = F.greatest(F.size(keys) - step, F.lit(0))
    return F.zip_with(F.slice(keys, F.lit(1), n), F.slice(keys, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(keys: Column, n: int = WINDOW) -> Column:
    """How many words lie in windows whose hash stands twice or more in the text."""
    def covered(pairs: Column) -> Column:
        def tied(x: Column, j: Column) -> Column:
            before = F.get(pairs, j - 1)["k"] == x["k"]
            after = F.get(pairs, j + 1)["k"] == x["k"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        places = F.sort_array(F.transform(F.filter(pairs, tied), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + (i + n) - F.greatest(a["end"], i)).alias("n"), (i + n).alias("end")), lambda a: a["n"])

    pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(pairs, covered)).otherwise(F.lit(0).cast("long"))


def with_base(rows: DataFrame) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole ``text``.

    Window hashes come by doubling: of 2 words, of 4, of 8. A window of 8 that stands twice begins with 4 words that
    stand twice, so the last step is left out where the hashes of 4 all differ. Each step is a column of its own: Spark
    works out a column once and compiles functions that stand outside lambdas.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", word_array(F.col("text"))).withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.size(F.split("text", f"[{SYMBOLS}]")) - 1).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "h": F.transform("words", lambda w: F.xxhash64(w)),
    })
    for step in STEPS[:-1]:
        found = found.withColumn("h", neighbour_hashes(F.col("h"), step))
    repeated = let(neighbour_hashes(F.col("h"), STEPS[-1]), repeated_words)
    twice = F.size(F.array_distinct("h")) < F.size("h")
    return found.withColumn("n_repeat_words", F.when(twice, repeated).otherwise(F.lit(0).cast("long"))).drop("words", "h")


def with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` with hashes of the text's ``tokens`` and of its ``pairs`` of neighbouring tokens."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return rows.withColumn("tokens", tokens).withColumn("pairs", neighbour_hashes(F.col("tokens")))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> DataFrame:
    """One row, ``ratios``: for each bucket the log of trusted over corpus probability, counted over all rows."""
    # labels grow with the documents: the same merge join at every size, no broadcast while they happen to be few
    marks = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("t", F.lit(1)).hint("merge")
    known = docs.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    nameless = docs.where(F.col("doc_id").isNull()).withColumn("t", F.lit(None).cast("int"))
    rows = known.select("text", "t").union(nameless.select("text", "t"))
    grams = with_grams(rows).select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(F.concat("tokens", "pairs")).alias("g"))
    counts = grams.select("t", bucket(F.col("g"), buckets).alias("b")).groupBy("b").agg(F.sum("t").alias("target"), F.count(F.lit(1)).alias("raw"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").select("b", F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("raw", F.lit(0)).alias("raw"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("b", "target", "raw"))).alias("c"), F.sum("target").alias("targets"), F.sum("raw").alias("raws"))
    extra = smooth * buckets
    return one.select(F.transform("c", lambda x: F.log((x["target"] + smooth) / (F.col("targets") + extra)) - F.log((x["raw"] + smooth) / (F.col("raws") + extra))).alias("ratios"))


def rules(docs: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base counts, base_failed, ratio and kept of every row."""
    model = log_ratios(docs.select("doc_id", "text"), trusted, buckets).scalar()
    rows = with_grams(with_base(docs.select("doc_id", "text"))).drop("text")
    # every column of this step is used once by the next, so that the subquery is read in place and no row carries it
    rows = rows.withColumns({"grams": F.concat("tokens", "pairs"), "n_grams": F.size("tokens") + F.size("pairs"), "ratios": model})
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get("ratios", bucket(g, buckets)))
    rows = rows.withColumn("ratio", F.coalesce(F.try_divide(total, "n_grams"), F.lit(0.0))).drop("tokens", "pairs", "grams", "n_grams", "ratios")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = rules(table(spark, sf_dir, "documents"), labels.where(F.col("quality") == 1))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


QUERIES = {"op3_quality_rules": op3_quality_rules}
