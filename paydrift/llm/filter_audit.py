"""Interaction audit of five document filters over every order in which they can be applied.

A document is judged once by all filters; what it fails is a mask of five bits. Documents become cells, one for each part
and mask, with their weights, so everything after that is at most 32 rows a part. Each cell is folded across the array
of orders: ``transform`` walks the orders, ``aggregate`` the steps of one, and 120 orders of five steps give 600 weighted
structs. The cells of a part are merged by elementwise sums.

Copies are found by the SHA-256 of the whole text. Rows with one id and text are counted before they are joined with
their label, rows of one text, part and label before they meet the other copies, so that a hot text, source or id is a
few rows when it is shuffled. Nothing is broadcast but the array of orders, which is a constant.

Null texts are empty. An empty text fails A only, and E if a smaller id has one too. Null languages are the part ''. A
null doc_id has no label, is never a copy of another and makes none. Rows that repeat an id and its text are counted each
and are no copies of one another, as no id is smaller. Several labels of one id: good or toxic if one of them says so.
Long texts are judged whole. Tables without rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
COPY = 1 << FILTERS.index("E")

_ARRAY = "array(" + ", ".join("array(" + ", ".join(str(FILTERS.index(x)) for x in o) + ")" for o in ORDERS) + ")"
_STEP = "named_struct('filter', {filter}, " + ", ".join(f"'{c}', {{{c}}}" for c in COUNTS) + ")"
_TYPE = "array<struct<filter: int, " + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"
#: A cell ``c`` folded across the orders ``o``: ``alive`` says whether its documents have passed all steps so far.
_FOLD = "flatten(transform(orders, o -> aggregate(o, named_struct('alive', true, 'steps', cast(array() AS " + _TYPE + ")), (acc, f) -> named_struct('alive', acc.alive AND getbit(c.mask, f) = 0, 'steps', array_append(acc.steps, " + _STEP.format(
    filter="f",
    kept="if(acc.alive AND getbit(c.mask, f) = 0, c.n, 0L)",
    removed="if(acc.alive AND getbit(c.mask, f) = 1, c.n, 0L)",
    redundant="if(NOT acc.alive AND getbit(c.mask, f) = 1, c.n, 0L)",
    unique_fails="if(getbit(c.mask, f) = 1 AND bit_count(c.mask) = 1, c.n, 0L)",
    good_lost="if(acc.alive AND getbit(c.mask, f) = 1, c.good, 0L)",
    toxic_lost="if(acc.alive AND getbit(c.mask, f) = 1, c.toxic, 0L)") + ")), acc -> acc.steps)))"
_ZEROS = f"array_repeat({_STEP.format(filter='0', **dict.fromkeys(COUNTS, '0L'))}, {len(ORDERS) * len(FILTERS)})"
_MERGED = f"aggregate(cells, {_ZEROS}, (total, c) -> zip_with(total, {_FOLD}, (x, y) -> " + _STEP.format(filter="y.filter", **{c: f"x.{c} + y.{c}" for c in COUNTS}) + "))"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, copy_of (digest of the text) and the mask of the filters A to D of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("copy_of"), "text", words_of(F.col("text")).alias("words"))
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    n = F.size("words")
    fails = [n < LEAST_WORDS, F.lit(100) * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
             F.lit(100).cast("long") * capitals > MOST_CAPITALS * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    return rows.select("doc_id", "part", "copy_of", sum(((f.cast("int") * (1 << i)) for i, f in enumerate(fails)), F.lit(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: all documents of a part that fail the same filters, and how many are labelled good or toxic."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = judged(docs).groupBy("doc_id", "copy_of", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    named = F.col("doc_id").isNotNull()
    same = rows.groupBy("copy_of", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    first = same.groupBy("copy_of").agg(F.min("least.doc_id").alias("first"))
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("nameless")
    sides = F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - own).alias("n")))
    both = same.join(first, "copy_of").select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "good", "toxic", "side.mask", "side.n").where("n > 0")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step with the counts of its filter there, and the filter's removals over all orders."""
    merged = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).withColumn("orders", F.expr(_ARRAY)).withColumn("steps", F.expr(_MERGED))
    summed = F.expr("transform(array(0, 1, 2, 3, 4), k -> aggregate(filter(steps, x -> x.filter = k), 0L, (total, x) -> total + x.removed))")
    rows = merged.select("part", summed.alias("sums"), F.posexplode("steps").alias("place", "step_"))
    names = F.split(F.lit(",".join(ORDERS)), ",")
    return rows.select("part", F.get(names, F.expr("int(place div 5)")).alias("filter_order"), (F.col("place") % 5 + 1).alias("step"), *[F.col(f"step_.{c}").alias(c) for c in COUNTS],
                       F.get("sums", F.col("step_.filter")).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {"op11_filter_audit": """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, s.step, filter_order[s.step] AS letter, filter_order[1:s.step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step) s),
r AS (SELECT part, filter_order, step, letter, n, good, bad, fails, contains(fails, letter) AS fail, len(translate(earlier, fails, '')) = step - 1 AS alive FROM c, s),
g AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (alive AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (alive AND fail), 0) AS removed, coalesce(sum(n) FILTER (fail AND NOT alive), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(good) FILTER (alive AND fail), 0) AS good_lost, coalesce(sum(bad) FILTER (alive AND fail), 0) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g"""}
