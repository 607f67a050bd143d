"""Outflow beside the pipeline: rows of either side, segment by fallback, quantities counted once."""

from paydrift.operators import worklist as wl


def test_rows_of_either_side_and_segment_by_fallback(spark):
    net = spark.createDataFrame([(1, 10, "retail", 5, 4, 1, 3), (1, 10, "retail", 6, 2, 2, 0), (1, 11, " ", 5, 3, 0, 3), (1, 12, None, 6, 1, 0, 1), (1, 13, None, 9, 9, 0, 9), (2, 14, None, 5, 2, 0, 2)],
                                "unit int, org int, seg string, mi int, outflow_qty int, ret int, kept int")
    pipe = spark.createDataFrame([(1, 10, 5, 1, 4, 3.0, "corp"), (1, 11, 2, 0, 2, 1.0, "corp"), (1, 11, 3, 1, 2, 2.0, None), (1, 15, 7, 7, 0, 7.0, "")],
                                 "unit int, org int, plan int, fact int, rest int, expected double, seg_deal string")
    seg_of = spark.createDataFrame([(12, "public"), (12, "agro"), (15, "trade")], "org int, seg string")
    got = {r["org"]: r for r in wl.outflow_with_pipeline(net, pipe, seg_of, 5, 6).collect()}
    assert {o: (r["seg"], r["seg_source"]) for o, r in got.items()} == {10: ("retail", "outflow"), 11: ("corp", "deal"), 12: ("public", "directory"), 14: (None, None), 15: ("trade", "directory")}
    assert (got[10]["out_qty"], got[10]["kept"], got[10]["out_months"], got[10]["expected"]) == (6, 3, [5], 3.0)
    assert (got[11]["plan"], got[11]["fact"], got[11]["rest"], got[11]["expected"]) == (5, 1, 4, 3.0)
    assert (got[15]["out_qty"], got[15]["out_months"], got[15]["plan"]) == (0, [], 7)


def test_empty_sides(spark):
    net = spark.createDataFrame([], "unit int, org int, seg string, mi int, outflow_qty int, ret int, kept int")
    pipe = spark.createDataFrame([], "unit int, org int, plan int, fact int, rest int, expected double, seg_deal string")
    assert wl.outflow_with_pipeline(net, pipe, spark.createDataFrame([], "org int, seg string"), 5, 6).isEmpty()
