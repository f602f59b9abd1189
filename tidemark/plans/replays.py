"""Queries of stores kept as streams: each replayed to its end over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..operators.lineage import scratch
from ..sources.views import view
from ..streaming import stateful
from .derived import DERIVED, query


@query("st_06_suppression_stream", DERIVED["st_06_suppression"][1])
def st_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression with each account's last changes as state."""
    alerts = view(spark, sf_dir, "alert")
    marks = alerts.filter("status in ('investigating', 'resolved')").select("account_id", (F.col("created_us") + 1_800_000_000).alias("at"), F.lit(None).cast("bigint").alias("alert_id"), F.lit(0).alias("is_alert"))
    events = alerts.select("account_id", F.col("created_us").alias("at"), "alert_id", F.lit(1).alias("is_alert")).union(marks).withColumn("ts", F.timestamp_micros("at"))
    return stateful.replayed(events, lambda s: stateful.suppressed(s, minutes=7200), scratch(spark))


@query("st_04_rule_velocity_stream", "SELECT transaction_id, COUNT(CASE WHEN amount <= 500 THEN 1 END) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 2 AS many FROM risk_txn")
def st_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More small transactions of an account within a day than allowed, with its times as state."""
    rows = view(spark, sf_dir, "risk_txn").select("transaction_id", "account_id", F.col("us").alias("at"), F.timestamp_micros("us").alias("ts"), F.col("amount").cast("double").alias("amount"))
    return stateful.replayed(rows, lambda s: stateful.rule_velocity(s, "account_id", 2, 86_400, 500.0), scratch(spark))


_WAITS = "CASE severity WHEN 'critical' THEN [5, 15, 30, 60] WHEN 'high' THEN [15, 30, 60] WHEN 'medium' THEN [60, 120] END"


@query("st_08_escalation_stream", f"""
    WITH a AS (SELECT alert_id, severity, created_us, CASE WHEN alert_id % 3 = 0 THEN created_us + (alert_id % 100) * 60000000 END AS ack, {_WAITS} AS waits FROM alert),
    mark AS (SELECT MAX(GREATEST(created_us, COALESCE(ack, 0))) // 1000 * 1000 - 300000000 AS until_us FROM a),
    b AS (SELECT a.*, until_us, list_transform(range(1, len(waits) + 1), lambda k: created_us + list_sum(waits[1:k]) * 60000000) AS ends FROM a CROSS JOIN mark WHERE waits IS NOT NULL),
    steps AS (SELECT alert_id, severity, len(waits) AS n, unnest(range(1, len(waits) + 1)) AS passed, unnest(ends) AS at_us, ack, until_us FROM b),
    due AS (SELECT * FROM steps WHERE at_us <= CASE WHEN ack IS NOT NULL THEN ack ELSE until_us END),
    gone AS (SELECT alert_id, MAX(passed) AS passed FROM due GROUP BY alert_id),
    told AS (SELECT alert_id, severity, 1 AS level, 'pending' AS state, created_us AS at_us FROM b
      UNION ALL SELECT alert_id, severity, LEAST(passed + 1, n), CASE WHEN passed = n THEN 'timed_out' ELSE 'escalated' END, at_us FROM due
      UNION ALL SELECT b.alert_id, severity, COALESCE(g.passed, 0) + 1, 'acknowledged', ack FROM b LEFT JOIN gone g USING (alert_id) WHERE ack IS NOT NULL AND COALESCE(g.passed, 0) < len(waits))
    SELECT alert_id, CASE severity WHEN 'critical' THEN 'critical_fraud' WHEN 'high' THEN 'high_severity' ELSE 'medium_severity' END AS policy, CAST(level AS INTEGER) AS level, state, CAST(at_us AS BIGINT) AS at_us FROM told""")
def st_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every alert's escalation, by timers up to the last watermark."""
    alerts = view(spark, sf_dir, "alert").select("alert_id", "severity", F.col("created_us").alias("at"), F.lit(0).alias("is_ack"))
    acks = alerts.filter("alert_id % 3 = 0").select("alert_id", "severity", (F.col("at") + F.col("alert_id") % 100 * 60_000_000).alias("at"), F.lit(1).alias("is_ack"))
    events = alerts.union(acks).withColumn("ts", F.timestamp_micros("at"))
    return stateful.replayed(events, lambda s: stateful.escalations(s, lifecycle.POLICIES), scratch(spark)).withColumnRenamed("at", "at_us")


@query("st_11_device_stream", f"SELECT * FROM ({DERIVED['stg_08_device'][1]}) d WHERE known IS NOT NULL")
def st_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices' histories as state."""
    rows = view(spark, sf_dir, "risk_txn").select("transaction_id", "customer_id", F.col("us").alias("at"), F.timestamp_micros("us").alias("ts"), F.when(F.col("transaction_id") % 31 != 0, F.col("device_id")).alias("device_id"))
    out = stateful.replayed(rows, stateful.devices, scratch(spark))
    return out.select("transaction_id", "known", "is_new", F.round("age_days", 6).alias("age_days"), "accounts", F.round("trust", 6).alias("trust"), F.round("risk", 6).alias("risk"))
