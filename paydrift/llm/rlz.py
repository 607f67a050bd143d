"""Substring dedup by relative Lempel-Ziv parsing.

All segments filed in one bucket are a reference block (see ``passages``); every segment is factored against the
block's index of earlier documents. The parse takes the longest factor at its place: the index tells where the window
there begins in the reference, and the factor is the match grown from it word by word. A factor of ``width`` words or
more is a duplicate span; shorter ones hold no window and are passed over a word at a time. The windows that
straddle a factor's end are looked up too, so no match is lost to the greedy cut.

Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Null texts have none. A window is removed only for a
document with a smaller id, so repeated rows of one id keep their words; null doc_ids neither remove nor lose
words. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passages import HOT, Scheme, deduplicated, removed_count
from .texts import table

WIDTH = 13
SCHEME = Scheme(WIDTH, 5, True)


def parse(own: list[bytes], index: dict[bytes, tuple[int, int]], reference: list[list[bytes]], width: int) -> int:
    """Bit i: the window from word i on occurs in the reference."""
    mask, i, last = 0, 0, len(own) - width
    while i <= last:
        found = index.get(b" ".join(own[i:i + width]))
        if found is None:
            i += 1
            continue
        there, at = reference[found[0]], found[1]
        end = i + width
        at += width
        while end < len(own) and at < len(there) and there[at] == own[end]:
            end += 1
            at += 1
        for k in range(i, end - width + 1):
            mask |= 1 << k
        # the factor ends here; the next window is the first that reaches over its end
        i = end - width + 1
    return mask


def factor(width: int):
    """The bucket's method: contents come in the order of their documents, each is parsed and then indexed."""
    def method(bodies: list[bytes], docs: list[int]) -> list[int]:
        index: dict[bytes, tuple[int, int]] = {}
        reference: list[list[bytes]] = []
        masks: list[int] = []
        for body, doc in zip(bodies, docs):
            # documents of one id are not earlier than each other: index them when the id has passed
            while len(reference) < len(masks) and docs[len(reference)] < doc:
                r = len(reference)
                earlier = bodies[r].split(b" ")
                for k in range(len(earlier) - width + 1):
                    index.setdefault(b" ".join(earlier[k:k + width]), (r, k))
                reference.append(earlier)
            masks.append(parse(body.split(b" "), index, reference, width))
        return masks

    return method


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = 5, hot: int = HOT) -> DataFrame:
    """doc_id, n (words), spans of removed words, kept (UTF-8, words joined by one space)."""
    return deduplicated(docs, Scheme(width, gram, True), factor(width), hot)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_words"), removed_count().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
m AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, i + o AS j FROM win JOIN m USING (k), range(13) AS r(o) WHERE m.d < win.doc_id),
x AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT x.doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed, string_agg(x.x, ' ' ORDER BY x.j) FILTER (g.j IS NULL) AS kept
      FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""}
