"""Queries of the warehouse after two batches, the second one loaded into tables that the first one filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layers
from ..operators.lineage import scratch
from ..sources.views import view
from .derived import query

DAY = 20240115


def warehouse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two thirds of the transactions as the first batch, the rest as the second; each eleventh lacks its account."""
    txns = view(spark, sf_dir, "txn").withColumn("batch", F.when(F.col("transaction_id") % 3 != 0, 1).otherwise(2))
    fields = F.struct(
        "transaction_id", F.when(F.col("transaction_id") % 11 != 0, F.col("account_id")).alias("account_id"), "customer_id", "merchant_id", "amount", "channel", "country",
        F.when(F.col("customer_id") % 4 != 0, F.concat(F.lit("c"), (F.col("customer_id") % 4).cast("string"))).alias("city"), F.when(F.col("amount") >= 90, "flagged").otherwise(F.col("status")).alias("status"), F.col("ts").cast("string").alias("ts"),
    )
    raw = txns.select(F.parse_json(F.to_json(fields)).alias("raw_data"), "batch")
    profiles = txns.groupBy("batch", "customer_id").agg(F.when(F.count("*") > 2, "high").otherwise("low").alias("tier"), F.max("amount").cast("decimal(15,2)").alias("largest"))
    scores = view(spark, sf_dir, "latest_score")
    alerts = view(spark, sf_dir, "alert").select("transaction_id", "severity", F.col("status").alias("alert_status"))
    tables = layers.empty(spark)
    for batch in (1, 2):
        tables = layers.load(tables, raw, profiles.filter(F.col("batch") == batch), scores, alerts, batch, DAY)
        tables = layers.kept(tables, scratch(spark)) if batch == 1 else tables
    return tables


_LAYERS = """
    WITH b AS (SELECT *, CASE WHEN transaction_id % 3 <> 0 THEN 1 ELSE 2 END AS batch FROM txn),
    p AS (SELECT batch, customer_id, CASE WHEN COUNT(*) > 2 THEN 'high' ELSE 'low' END AS tier, MAX(amount) AS largest, COUNT(*) FILTER (WHERE transaction_id % 11 <> 0) AS staged FROM b GROUP BY batch, customer_id),
    one AS (SELECT * FROM p WHERE batch = 1 AND staged > 0), two AS (SELECT * FROM p WHERE batch = 2 AND staged > 0),
    moved AS (SELECT two.* FROM two LEFT JOIN one USING (customer_id) WHERE one.customer_id IS NULL OR one.tier <> two.tier OR one.largest <> two.largest),
    customers AS (SELECT customer_id, tier, largest, 1 AS valid_from, customer_id NOT IN (SELECT customer_id FROM moved) AS is_current FROM one UNION ALL SELECT customer_id, tier, largest, 2, TRUE FROM moved),
    facts AS (SELECT b.transaction_id, CAST(strftime(b.ts, '%Y%m%d') AS INTEGER) AS date_key, left(sha256(CAST(b.customer_id AS VARCHAR) || '|' || CAST(CASE WHEN b.batch = 2 AND moved.customer_id IS NOT NULL THEN 2 ELSE 1 END AS VARCHAR)), 16) AS customer_key,
                     left(sha256(CAST(b.merchant_id AS VARCHAR)), 16) AS merchant_key, left(sha256(b.country || '|' || CASE WHEN b.customer_id % 4 <> 0 THEN 'c' || CAST(b.customer_id % 4 AS VARCHAR) ELSE '' END), 16) AS place_key,
                     b.amount, s.score, COALESCE(a.status = 'resolved', FALSE) AS is_fraud, b.amount >= 90 AS is_flagged, a.severity, b.batch
              FROM b LEFT JOIN moved ON moved.customer_id = b.customer_id LEFT JOIN latest_score s ON s.transaction_id = b.transaction_id LEFT JOIN alert a ON a.transaction_id = b.transaction_id WHERE b.transaction_id % 11 <> 0)
"""


@query("stg_16_facts", _LAYERS + "SELECT transaction_id, date_key, customer_key, merchant_key, place_key, CAST(amount AS DOUBLE) AS amount, score, is_fraud, is_flagged, severity, batch FROM facts")
def stg_16_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts, with the keys of the members that were current when they were loaded."""
    return warehouse(spark, sf_dir)["facts"].withColumn("amount", F.col("amount").cast("double"))


@query("stg_16_customers", _LAYERS + f"SELECT customer_id, tier, CAST(largest AS DOUBLE) AS largest, valid_from, CASE WHEN is_current THEN {layers.FOREVER} ELSE 2 END AS valid_to, is_current FROM customers")
def stg_16_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of customers after both batches."""
    return warehouse(spark, sf_dir)["customers"].withColumn("largest", F.col("largest").cast("double"))


@query("stg_16_members", _LAYERS + """
    SELECT 'merchant' AS dimension, CAST(merchant_id AS VARCHAR) AS member, COUNT(DISTINCT batch) AS n FROM b WHERE transaction_id % 11 <> 0 GROUP BY merchant_id
    UNION ALL SELECT DISTINCT 'place', country || '/' || CASE WHEN customer_id % 4 <> 0 THEN 'c' || CAST(customer_id % 4 AS VARCHAR) ELSE '' END, 0 FROM b WHERE transaction_id % 11 <> 0""")
def stg_16_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants with the batches that had them, and places."""
    tables = warehouse(spark, sf_dir)
    merchants = tables["merchants"].select(F.lit("merchant").alias("dimension"), F.col("merchant_id").cast("string").alias("member"), F.col("n").cast("bigint").alias("n"))
    return merchants.union(tables["places"].select(F.lit("place"), F.concat_ws("/", "country", "city"), F.lit(0).cast("bigint")))


@query("stg_16_daily", _LAYERS + f"""
    SELECT {DAY} AS date_key, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) FILTER (WHERE is_fraud) AS n_fraud, CAST(COALESCE(SUM(amount) FILTER (WHERE is_fraud), 0) AS DOUBLE) AS fraud_total, ROUND(AVG(CASE WHEN is_fraud THEN 1e0 ELSE 0e0 END), 9) AS fraud_rate, ROUND(AVG(score), 9) AS mean_score,
           ROUND(MEDIAN(score), 9) AS median_score, COUNT(*) FILTER (WHERE score >= 0.8) AS n_high, COUNT(*) FILTER (WHERE score >= 0.95) AS n_critical, COUNT(*) FILTER (WHERE is_flagged) AS n_flagged, COUNT(DISTINCT customer_key) FILTER (WHERE is_flagged) AS customers_flagged
    FROM facts WHERE date_key = {DAY} HAVING COUNT(*) > 0""")
def stg_16_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's summary, made anew by the second batch."""
    out = warehouse(spark, sf_dir)["daily"].withColumns({c: F.col(c).cast("double") for c in ("total", "fraud_total")})
    return out.withColumns({c: F.round(c, 9) for c in ("fraud_rate", "mean_score", "median_score")})
