"""Neighbouring months by windows, masks beside their rows, daily windows without the months they do not reach."""

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (plans load in order)
from paydrift.operators import anomaly as an
from paydrift.operators import summary as sm
from paydrift.plans.cascade import sides
from paydrift.plans.worklist import month_after


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sides_of_neighbouring_months(spark):
    p = spark.createDataFrame([(1, 5, 7, 1), (1, 6, 8, 2), (1, 8, 8, 1), (2, 5, None, 3), (2, 6, 7, 1), (None, 5, 7, 1), (3, None, 7, 1)], "person int, mi int, org int, k int")
    out = sides(p)
    names = ("base", "in_new", "in_other", "out_left", "out_other", "temp_left", "single_pay", "raw_rows", "here")
    got = {(r["person"], r["org"], r["mi"], r["here"]): {n for n in names if r[n]} for r in out.collect() if r["org"] is not None}
    assert got == {(1, 7, 5, 1): {"in_new", "single_pay", "raw_rows", "here"}, (1, 7, 6, 0): {"base", "out_other"}, (1, 8, 6, 1): {"in_other", "raw_rows", "here"}, (1, 8, 7, 0): {"base", "out_left", "temp_left"},
                   (1, 8, 8, 1): {"in_new", "single_pay", "raw_rows", "here"}, (1, 8, 9, 0): {"base", "out_left"}, (2, 7, 6, 1): {"in_new", "single_pay", "raw_rows", "here"}, (2, 7, 7, 0): {"base", "out_left"}}
    assert "Join" not in plan(out)


def test_month_after_repeats_what_stands_twice(spark):
    out = month_after(spark.createDataFrame([(1, 5, 4), (1, 6, 1), (2, 5, 3), (2, 5, 3), (2, 6, 2), (2, 6, 2), (3, None, 9)], "org int, mi int, fl int"))
    got = sorted((r["org"], r["mi"] or 0, r["prev"], r["fl"]) for r in out.collect())
    assert got == sorted([(1, 6, 4, 1), (1, 7, 1, 0), *[(2, 6, 3, 2)] * 4, *[(2, 7, 2, 0)] * 2, (3, 0, 9, 0)])
    assert "Join" not in plan(out)


def test_masks_stand_beside_their_rows_without_self_joins(spark):
    masks = spark.createDataFrame([(1, 1, 0, 3, 1, 2), (1, 1, 1, 4, 4, 0), (1, 2, 0, 8, 8, 0), (2, 3, 0, 1, 1, 0), (None, 1, 0, 16, 16, 0), (2, None, 0, 32, 32, 0)], "person int, org int, unit int, b_any bigint, b_p bigint, b_n bigint")
    orgs = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "org int, hold string")
    out = sm._annotated(masks, orgs)
    got = {(r["person"], r["org"], r["unit"]): (r["pr_any"], r["pr_p"], r["po_p"], r["ph_p"], r["org_p"]) for r in out.collect()}
    assert got == {(1, 1, 0): (15, 13, 5, 13, 21), (1, 1, 1): (15, 13, 5, 13, 21), (1, 2, 0): (15, 13, 8, 13, 8), (2, 3, 0): (33, 33, 1, None, 1)}
    assert plan(out).count("Join") == 2


def test_daily_windows_read_their_months_only(spark):
    lines = spark.createDataFrame([(m, f"2000-01-{d:02d}", 1, 1, 0, "N", 10) for m in (1, 2, 3, 4, 5, 6) for d in (3, 20)], "mi int, day string, person int, org int, unit int, code string, amt int")
    lines = lines.select("mi", F.to_date("day").alias("day"), "person", "org", "unit", "code", F.col("amt").cast("decimal(18,2)").alias("amt"), F.lit(True).alias("is_pf"), F.lit(True).alias("is_fot"), F.lit(False).alias("is_fixed"))
    out = an.daily_windows(lines, (3, 6), 5, None, ("N",))
    assert {r["w"]: int(r["pf_amt"]) for r in out.collect()} == {0: 20, 1: 20, 2: 20, 3: 20}
    assert "IN (2,3,5,6)" in plan(out).replace(" IN(", " IN (").replace(", ", ",") or "INSET 2,3,5,6" in plan(out).replace(", ", ",")
