"""The corpus pipeline: documents pass through the stages in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paydrift.llm import pipeline_stages
from paydrift.llm.texts import table, work_table

STAGES = pipeline_stages.STAGES
#: The classifier's fitted densities, byte-pair encoding and tree scores have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return docs
