"""Pairs of a heavy person's places: exact counts, and no key of the join with more than a block on a side."""

from pyspark.sql import functions as F

from paydrift.operators import moves as mv
from paydrift.operators.pairs import paired


def sides(spark, n, m):
    """Person 1 left n places and has m, some of both twice; persons 2 to 40 have one or two."""
    left = [(1, i) for i in range(n)] + [(1, 7)] + [(p, p % 5) for p in range(2, 41)]
    right = [(1, 10_000 + i) for i in range(m)] + [(1, 10_003)] + [(p, 10_000 + p % 3) for p in range(2, 41)] + [(2, 10_001), (99, 5)]
    return spark.createDataFrame(left, "person int, a int"), spark.createDataFrame(right, "person int, b int")


def test_pairs_equal_a_plain_join(spark):
    left, right = sides(spark, 90, 70)
    want = sorted(map(tuple, left.join(right, "person").select("person", "a", "b").collect()))
    for block in (512, 16, 3):
        assert sorted(map(tuple, paired(left, right, ["person"], block).select("person", "a", "b").collect())) == want
    assert paired(left.where("false"), right, ["person"]).count() == 0


def test_a_person_with_5000_places_is_many_small_keys(spark):
    left, right = sides(spark, 5000, 300)
    x = paired(left, right, ["person"], 128)
    # the other persons' places are among the heavy one's
    assert x.groupBy("a", "b").count().agg(F.sum("count"), F.count("*")).first() == (5001 * 301 + 39 + 1, 5000 * 300)
    # rows by key of the join, taken before the join's keys are dropped
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "_a" in plan and "_b" in plan
    heavy = left.withColumn("k", F.pmod(F.xxhash64("a"), F.lit(-(-5001 // 128)))).where("person = 1").groupBy("k").count().agg(F.max("count")).first()[0]
    assert heavy < 2 * 128


def test_successors_of_a_heavy_person(spark):
    rows = [(0, 1, f"o{i}", 1.0) for i in range(700)] + [(1, 1, f"n{i}", 1.0) for i in range(600)] + [(0, p, "A", 1.0) for p in range(2, 6)] + [(1, p, "B", 1.0) for p in range(2, 6)]
    rec = spark.createDataFrame(rows, "mi int, person int, org string, pf_amt double").withColumns({"unit": F.lit(1), "seg": F.lit("s"), "region": F.lit(0), "sum_pf": F.col("pf_amt")})
    got = mv.successor_orgs(rec, 0, 1, 1, 0.0)
    assert got.count() == 700 * 600 + 1 and got.where("org_from = 'A'").select("org_to", "n_moved", "n_left").collect() == [("B", 4, 4)]
