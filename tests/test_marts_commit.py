"""Two writers of one mart: the one that was overtaken is refused, other periods and owners are not in its way."""

import pytest
from pyspark.sql import functions as F

from paydrift.sources import marts


def rows(spark, v):
    return spark.createDataFrame([(v, f"row {v}")], "v int, name string")


def held(spark, path):
    return sorted((str(r["period"]), r["owner"], r["v"]) for r in marts.read_mart(spark, path).select("period", "owner", F.col("name").alias("n"), F.regexp_extract("name", r"\d+", 0).cast("int").alias("v")).collect())


def test_the_overtaken_writer_of_a_period_is_refused(spark, tmp_path):
    p = str(tmp_path / "m")
    marts.mart_replace_period(rows(spark, 1), p, "2024-01", "o1")
    seen = marts.last_step(spark, p)
    # both writers start from the same step; the second to commit is late
    marts.mart_replace_period(rows(spark, 2), p, "2024-01", "o1", seen)
    with pytest.raises(marts.GateError):
        marts.mart_replace_period(rows(spark, 3), p, "2024-01", "o1", seen)
    assert held(spark, p) == [("2024-01", "o1", 2)]
    # another owner and another period derived from the same step are taken
    marts.mart_replace_period(rows(spark, 4), p, "2024-01", "o2", seen)
    marts.mart_replace_period(rows(spark, 5), p, "2024-02", "o1", seen)
    assert held(spark, p) == [("2024-01", "o1", 2), ("2024-01", "o2", 4), ("2024-02", "o1", 5)]
    marts.mart_replace_period(rows(spark, 6), p, "2024-01", "o1")
    assert held(spark, p)[0] == ("2024-01", "o1", 6)
    steps = [r["step"] for r in marts.commits(spark, p).collect()]
    assert sorted(steps) == list(range(1, len(steps) + 1))


def test_interleaved_writers_one_commits_while_the_other_writes(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "m")
    marts.mart_replace_period(rows(spark, 1), p, "a", "o")
    create = marts.claim

    def overtaken(*args):
        monkeypatch.setattr(marts, "claim", create)
        marts.mart_replace_period(rows(spark, 2), p, "a", "o")
        return create(*args)

    monkeypatch.setattr(marts, "claim", overtaken)
    with pytest.raises(marts.GateError):
        marts.mart_replace_period(rows(spark, 3), p, "a", "o")
    assert held(spark, p) == [("a", "o", 2)]


def test_old_versions_go_only_when_asked(spark, tmp_path):
    p = str(tmp_path / "m")
    for v in (1, 2, 3):
        marts.mart_replace_period(rows(spark, v), p, "a", "o")
    marts.mart_replace_period(rows(spark, 4), p, "b", "o")
    assert spark.read.parquet(f"{p}/rows").count() == 4
    assert marts.remove_old_versions(spark, p) == 2 and spark.read.parquet(f"{p}/rows").count() == 2
    assert held(spark, p) == [("a", "o", 3), ("b", "o", 4)] and marts.remove_old_versions(spark, p) == 0


def test_one_publisher_of_a_run(spark, tmp_path):
    p = str(tmp_path / "s")
    assert not marts.mart_swap({"t": rows(spark, 1)}, p, 7, lambda w: False)
    assert marts.mart_swap({"t": rows(spark, 1)}, p, 7, lambda w: True)
    with pytest.raises(marts.GateError):
        marts.mart_swap({"t": rows(spark, 2)}, p, 7, lambda w: True)
    assert marts.read_current(spark, p, "t").first()["v"] == 1 and marts.mart_swap({"t": rows(spark, 3)}, p, 8, lambda w: True)
