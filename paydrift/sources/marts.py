"""Marts on plain Parquet: idempotent period replace, versioned swap, generations, caches, gates, CSV."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A check before writing failed; the mart is left as it was."""


def read_or_none(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# --------------------------------------------------------------------- gates

def source_gate(checks: Sequence[tuple[str, DataFrame, Column | None, str | None]]) -> DataFrame:
    """One row per required source: has rows for the period, and the latest date it does have.

    ``checks`` lists (name, frame, filter of the period, date column); every source is read once.
    """
    rows = []
    for pos, (name, df, cond, date_col) in enumerate(checks, 1):
        hit = F.count_if(F.coalesce(cond, F.lit(False))) if cond is not None else F.count(F.lit(1))
        last = F.max(F.col(date_col)).cast("string") if date_col else F.lit(None).cast("string")
        rows.append(df.agg(hit.alias("n"), last.alias("last_date")).select(
            F.lit(pos).alias("pos"), F.lit(name).alias("source"), (F.col("n") > 0).alias("ok"), "last_date"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def first_missing(gate: DataFrame) -> DataFrame:
    """The first source, in the given order, without rows; no row when everything is there."""
    return gate.where(~F.col("ok")).orderBy("pos").limit(1).select("source", "last_date")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stage_gate(df: DataFrame, keys: Sequence[str]) -> None:
    """Stop before the mart is touched when a stage is empty or a key repeats."""
    if df.isEmpty():
        raise GateError("stage is empty")
    if not duplicate_keys(df, keys).isEmpty():
        raise GateError(f"duplicate keys {list(keys)}")


def newer_run_guard(spark: SparkSession, path: str, period, run_id: int, run_col: str = "run_id") -> None:
    """Refuse to overwrite a period that was written from a newer summary."""
    if read_or_none(spark, f"{path}/log") is not None:
        last = read_mart(spark, path).where(F.col("period").cast("string") == str(period)).agg(F.max(run_col)).first()[0]
        if last is not None and last > run_id:
            raise GateError(f"period {period} holds run {last}, newer than {run_id}")


# -------------------------------------------------------------------- writes

def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a file that must not exist yet: of all writers that try, one succeeds."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """step, content of every commit of a mart, or none."""
    files = read_or_none(spark, f"{path}/commits", "text")
    return None if files is None else files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).cast("long").alias("step"), F.col("value").alias("content"))


def last_step(spark: SparkSession, path: str) -> int:
    c = commits(spark, path)
    return 0 if c is None else c.agg(F.max("step")).first()[0] or 0


def mart_replace_period(df: DataFrame, path: str, period, owner: str, seen: int | None = None) -> None:
    """Replace exactly one owner's rows of one period; a name that stopped firing disappears.

    The rows are written beside the old ones as a version of their own. Only then the writer takes the next step, a file that
    only one writer can create, and one appended log row names the version; so a write that fails on the way leaves the
    period as it was, and readers never see a part of one. ``seen`` is the step the rows were derived from, by default the
    last one before the write. When another writer has replaced the same period and owner since, this one is refused; when
    it has replaced another, the next free step is taken.
    """
    spark, version = df.sparkSession, uuid4().hex
    seen = last_step(spark, path) if seen is None else seen
    df.write.parquet(f"{path}/rows/period={period}/owner={owner}/v=r{version}")
    own, step = json.dumps([str(period), owner]), seen + 1
    while True:
        since = commits(spark, path)
        if since is not None and not since.where((F.col("step") > seen) & (F.col("content") == own)).isEmpty():
            raise GateError(f"period {period} of {owner} was replaced since step {seen}")
        if claim(spark, f"{path}/commits/{step:012d}", own):
            break
        step += 1
    # steps taken between the look and the claim are found now, so that of two writers of one period one is refused; a step
    # whose content is not there yet may be the same period
    n, same = commits(spark, path).where((F.col("step") > seen) & (F.col("step") < step)).agg(F.count(F.lit(1)), F.count_if(F.col("content") == own)).first()
    if same or n < step - seen - 1:
        raise GateError(f"period {period} of {owner} was replaced since step {seen}")
    spark.createDataFrame([(str(period), owner, f"r{version}", step)], "p string, o string, v string, step long").coalesce(1).write.mode("append").parquet(f"{path}/log")


def remove_old_versions(spark: SparkSession, path: str) -> int:
    """Deletes row versions that no reader of the latest log would read; call it when no reader of older ones is left."""
    log = spark.read.parquet(f"{path}/log")
    latest = log.groupBy("p", "o").agg(F.max_by("v", "step").alias("v"))
    old = log.join(latest, ["p", "o", "v"], "left_anti").collect()
    jvm = spark._jvm
    gone = 0
    for r in old:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/period={r['p']}/owner={r['o']}/v={r['v']}")
        gone += bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
    return gone


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every period and owner's latest version."""
    latest = spark.read.parquet(f"{path}/log").groupBy("p", "o").agg(F.max_by("v", "step").alias("v"))
    rows = spark.read.parquet(f"{path}/rows").withColumns({"p": F.col("period").cast("string"), "o": F.col("owner").cast("string")})
    return rows.join(latest, ["p", "o", "v"], "left_semi").drop("p", "o", "v")


def mart_swap(frames: dict[str, DataFrame], path: str, run_id: int, checks: Callable[[dict[str, DataFrame]], bool]) -> bool:
    """Publish several tables together, and only when the checks on the written rows pass.

    Tables go to ``v=<run_id>/``; one appended manifest row then names the version. Readers follow the
    newest manifest row, so a failed run leaves the old version current and the new one aside.
    """
    spark = next(iter(frames.values())).sparkSession
    mark = f"{path}/claims/{run_id}"
    if not claim(spark, mark, str(run_id)):
        raise GateError(f"run {run_id} was published or is being published by another writer")
    good = False
    try:
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{path}/v={run_id}/{name}")
        written = {n: spark.read.parquet(f"{path}/v={run_id}/{n}") for n in frames}
        good = bool(checks(written))
    finally:
        if not good:  # the run may be tried again
            target = spark._jvm.org.apache.hadoop.fs.Path(mark)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, False)
    if not good:
        return False
    spark.createDataFrame([(run_id,)], "run_id bigint").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def current_version(spark: SparkSession, path: str) -> int | None:
    m = read_or_none(spark, f"{path}/manifest")
    return None if m is None else m.agg(F.max("run_id")).first()[0]


def read_current(spark: SparkSession, path: str, name: str) -> DataFrame:
    v = current_version(spark, path)
    if v is None:
        raise GateError(f"no published version in {path}")
    return spark.read.parquet(f"{path}/v={v}/{name}")


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Append-only tables (generations by run and level, the run journal)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def generation_load(spark: SparkSession, path: str, measures: Sequence[str], run_id: int | None = None) -> DataFrame:
    """A chosen or the latest generation; measures an old generation did not have are NULL."""
    g = spark.read.option("mergeSchema", True).parquet(path)
    run = F.lit(run_id) if run_id is not None else g.agg(F.max("run_id")).scalar()
    out = g.where(F.col("run_id") == run)
    return out.withColumns({m: F.lit(None).cast("double") for m in measures if m not in g.columns})


def period_cache(spark: SparkSession, path: str, wanted: Sequence, version: str, compute: Callable[[list], DataFrame], period: str = "mi") -> DataFrame:
    """Compute only the periods not yet cached under this definition version.

    The list of periods is short by nature; each missing one gets its own directory, rewritten whole,
    so a run that died half way is simply repeated.
    """
    base = f"{path}/version={version}"
    done = read_or_none(spark, base)
    have = {r[0] for r in done.select(period).distinct().collect()} if done is not None else set()
    missing = [p for p in wanted if p not in have]
    if missing:
        (compute(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(base))
    return spark.read.parquet(base).where(F.col(period).isin(list(wanted)))


def csv_sink(frames: dict[str, DataFrame], folder: str, sep: str = ",") -> None:
    """Result tables as CSV folders with a header; Spark writes them in parallel."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).option("sep", sep).csv(f"{folder}/{name}")


# ----------------------------------------------------------------- work sets

class WorkSet:
    """Ordered named stages, each built from earlier ones, written once and dropped together.

    ``stage=True`` writes the frame to the shared folder, so later stages read files, not lineage.
    """

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix, self.frames = spark, prefix, {}

    def add(self, name: str, build: Callable[[dict[str, DataFrame]], DataFrame], stage: bool = False) -> DataFrame:
        from ..session import stage_table
        df = build(self.frames)
        if stage:
            df = stage_table(df, f"{self.prefix}/{name}")
        df.createOrReplaceTempView(f"{self.prefix}_{name}")
        self.frames[name] = df
        return df

    def drop(self) -> None:
        for name in self.frames:
            self.spark.catalog.dropTempView(f"{self.prefix}_{name}")
        self.frames.clear()
