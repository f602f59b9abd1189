"""A corpus pipeline of the training-data operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stored, table
from tidemark.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The stages learn models and take graph components, which SQL cannot state; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
