"""Documents with every odd case, and whole small tables, for the operators' tests."""

import random
import re

import duckdb
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; documents may have columns of these names.
CLASHES = ["chunk", "bucket", "n_tokens", "ids", "decoded", "score", "label", "spans", "kept", "pii_spans", "f_length", "component_id", "held_out", "u", "v", "root", "t", "ratio"]


def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared, base = prose(60), prose(120)
    near = base.split(" ")
    near[50] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "one two three"), (6, "One two THREE"), (7, base), (8, base), (9, " ".join(near)), (10, prose(40) + " " + shared + " " + prose(30)),
            (11, shared + "\n" + prose(50)), (12, "same " * 4000), (13, prose(30_000)), (14, "é" * 5000), (15, "a" * 70_000), (16, base), (16, base), (17, prose(3)), (18, "tail  double  spaces\n\nand <|endoftext|> here"),
            (19, "dup line here now\nother\ndup line here now\n" + prose(25)), (20, shared + "  " + shared)]
    return rows + [(None, base), (None, None), (None, "one two three")]


def odd(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("hot")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def none(spark):
    return odd(spark).where("false")


def documents(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(table, columns, sf=SMALL):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{table}.parquet' ORDER BY 1").fetchall()
