"""Rows dealt to tasks by their number."""

from pyspark.sql import functions as F

from tidemark.operators import skew
from tidemark.plans import catalog


def test_tasks_of_a_merchants_days_are_even(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    out = catalog.queries()["agg_16_merchant_daily_risk"](spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    parts = out.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()
    assert lines // 100 <= out.rdd.getNumPartitions() and max(n for _, n in parts) < 300
    assert out.count() == len({tuple(r) for r in out.select("merchant_id", "day").collect()}) > 0
