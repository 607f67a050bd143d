"""Wide masks against plain sets of periods, for words and lags that meet in the middle of a word."""

import random

from pyspark.sql import functions as F

from paydrift.functions import masks as mk
from paydrift.functions import wide_masks as wm

LAST = 150


def brute_row(p, n, any_, at, lag):
    def some(s, lo, hi):
        return any(i in s for i in range(max(lo, 0), hi + 1))

    flips = sum((i in n) != (i - 1 in n) for i in range(max(at - 11, 0), at + 1) if i in any_ and i - 1 in any_)
    return (at in p, some(p, at - 7, at + 3), "lt3" if not some(p, at - 12, at - 3) else "12p" if at - 12 in p else "3_12",
            not some(p, at - 12, at - 1) and at + 1 not in p and at + 2 not in p, at >= 11 and flips >= 3,
            sorted(i for i in p if i - lag not in p and i >= lag), sorted(i for i in range(LAST + 1) if i not in p and i - lag in p), sum(at - 7 <= i <= at + 3 for i in p))


def test_words_equal_sets(spark):
    rng, k, rows, want = random.Random(5), wm.words_for(LAST), [], []
    for key in range(60):
        density = rng.choice((.05, .5, .95))
        any_ = {i for i in range(LAST + 1) if rng.random() < density} | {rng.randrange(LAST + 1)}
        p = {i for i in any_ if rng.random() < .6}
        n = any_ - p if key % 2 else {i for i in any_ - p if rng.random() < .5}
        rows += [(key, i, i in p, i in n) for i in any_]
        want.append((any_, p, n))
    m = spark.createDataFrame(rows, "key int, mi int, p boolean, n boolean").groupBy("key").agg(
        k.build_mask(F.lit(True), F.col("mi")).alias("a"), k.build_mask(F.col("p"), F.col("mi")).alias("p"), k.build_mask(F.col("n"), F.col("mi")).alias("n"))
    assert wm.of(m, "p").n == 3 and wm.of(m.select(F.lit(1).alias("p")), "p") is mk
    for at, lag in ((0, 1), (11, 12), (58, 1), (60, 12), (65, 60), (119, 61), (121, 3), (150, 12)):
        x = m.select("key", k.has_bit(F.col("p"), F.lit(at)), k.any_in(F.col("p"), F.lit(at - 7), F.lit(at + 3)), k.tenure_band(F.col("p"), F.lit(at)), k.one_time(F.col("p"), F.lit(at)),
                     k.flapping(F.col("a"), F.col("n"), F.lit(at)), k.bit_positions(k.appeared(F.col("p"), lag), LAST), k.bit_positions(k.vanished(F.col("p"), lag, LAST), LAST), k.count_in(F.col("p"), F.lit(at - 7), F.lit(at + 3)))
        for r in x.collect():
            any_, p, n = want[r[0]]
            assert tuple(r)[1:] == brute_row(p, n, any_, at, lag), (r[0], at, lag)


def test_words_fold_and_refuse_periods_without_a_bit(spark):
    k = wm.words_for(70)
    d = spark.createDataFrame([(1, 3), (1, 69), (2, 69), (2, 60)], "key int, mi int")
    each = d.groupBy("key", "mi").agg(k.build_mask(F.lit(True), F.col("mi")).alias("b"))
    assert [r[0] for r in each.agg(k.fold("b").alias("b")).select(k.bit_positions(F.col("b"), 70)).collect()] == [[3, 60, 69]]
    for bad in (120, -1):
        try:
            spark.createDataFrame([(1, bad)], "key int, mi int").groupBy("key").agg(k.build_mask(F.lit(True), F.col("mi")).alias("b")).collect()
        except Exception as e:  # noqa: BLE001 - the engine's own error type
            assert "period outside 0..119" in str(e)
        else:
            raise AssertionError(bad)
