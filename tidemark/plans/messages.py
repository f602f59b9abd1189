"""Queries of messages in Avro's binary form, of merges with named columns and of types found in texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources import avro, files
from ..sources.views import view
from .derived import query

_OLD = {"type": "record", "name": "Txn", "fields": [
    {"name": "transaction_id", "type": "long"}, {"name": "amount", "type": {"type": "bytes", "logicalType": "decimal", "precision": 15, "scale": 2}}, {"name": "status", "type": {"type": "enum", "name": "Status", "symbols": ["approved", "declined"]}},
    {"name": "mcc_slot", "type": ["null", "long"], "default": None}, {"name": "place", "type": {"type": "array", "items": "double"}}, {"name": "left_out", "type": "string"},
]}
_NEW = {"type": "record", "name": "Txn", "fields": [*[f for f in _OLD["fields"] if f["name"] != "left_out"], {"name": "channel", "type": ["string", "null"], "default": "none"}]}


@query("src_11_avro_messages", """
    SELECT transaction_id AS key, CASE WHEN broken THEN NULL ELSE transaction_id END AS transaction_id, CASE WHEN NOT broken THEN CAST(amount AS DOUBLE) END AS amount, CASE WHEN NOT broken THEN status END AS status, CASE WHEN NOT broken THEN mcc_slot END AS mcc_slot, CASE WHEN NOT broken THEN lat END AS lat, CASE WHEN NOT broken THEN lon END AS lon,
      CASE WHEN NOT broken THEN CASE WHEN transaction_id % 2 = 0 THEN 'none' WHEN transaction_id % 5 = 0 THEN NULL ELSE channel END END AS channel, broken FROM (SELECT *, transaction_id % 13 = 4 OR transaction_id % 17 = 5 AS broken FROM txn) t""")
def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written by two schemas, read by the newer one; broken ones and those of unknown schemas are told."""
    i = F.col("transaction_id")
    txns = view(spark, sf_dir, "txn")
    common = ["transaction_id", F.col("amount").cast("decimal(15,2)").alias("amount"), "status", "mcc_slot", F.array("lat", "lon").alias("place")]
    old = avro.encoded(txns.filter(i % 2 == 0).select(i.alias("key"), F.struct(*common, F.lit("x").alias("left_out")).alias("value")), "value", json.dumps(_OLD), 1)
    new = avro.encoded(txns.filter(i % 2 == 1).select(i.alias("key"), F.struct(*common, F.when(i % 5 > 0, F.col("channel")).alias("channel")).alias("value")), "value", json.dumps(_NEW), 2)
    key, value = F.col("key"), F.col("value")
    hurt = F.when(key % 13 == 4, F.substring(value, F.lit(1), F.length(value) - 1)).when(key % 17 == 5, F.concat(F.unhex(F.lit("0000000009")), value)).otherwise(value)
    out = avro.decoded(old.union(new).withColumn("value", hurt), "value", json.dumps(_NEW), {1: json.dumps(_OLD), 2: json.dumps(_NEW)})
    r = F.col("record")
    return out.select("key", r["transaction_id"].alias("transaction_id"), r["amount"].cast("double").alias("amount"), r["status"].alias("status"), r["mcc_slot"].alias("mcc_slot"), F.get(r["place"], F.lit(0)).alias("lat"), F.get(r["place"], F.lit(1)).alias("lon"), r["channel"].alias("channel"), F.col("error").isNotNull().alias("broken"))


@query("snk_09_merge_into", """
    WITH t AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 > 0), s AS (SELECT c_custkey AS id, UPPER(c_name) AS name, c_acctbal + 1 AS balance, 'new' AS segment FROM customer WHERE c_custkey % 2 = 0)
    SELECT t.id, t.name, CASE WHEN s.id IS NULL THEN t.balance ELSE s.balance END AS balance, t.segment FROM t LEFT JOIN s ON t.id = s.id UNION ALL SELECT s.id, s.name, NULL, s.segment FROM s LEFT JOIN t ON t.id = s.id WHERE t.id IS NULL""")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that updates one column and inserts three."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    source = customers.filter("id % 2 = 0").select("id", F.upper("name").alias("name"), (F.col("balance") + 1).alias("balance"), F.lit("new").alias("segment"))
    return merge.merge_into(customers.filter("id % 3 > 0"), source, ["id"], ["balance"], ["id", "name", "segment"], customers.columns)


_TEXTS = ("transaction_amount", "transaction_timestamp", "transaction_currency", "account_id", "mcc", "flag", "share")
_FIRST = " UNION ALL ".join(f"""SELECT '{c}' AS field, COALESCE((SELECT kind FROM (SELECT transaction_id, CASE WHEN regexp_full_match({c}, '[ ]*[+-]?[0-9]+[ ]*') THEN 'int64' WHEN regexp_full_match({c}, '[ ]*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[ ]*') THEN 'float64' WHEN LOWER({c}) IN ('true', 'false') THEN 'bool' END AS kind FROM texts) k WHERE kind IS NOT NULL ORDER BY transaction_id LIMIT 1), 'string') AS type,
  (SELECT COUNT(*) FROM texts WHERE {c} <> '') AS filled""" for c in _TEXTS)


@query("src_08_text_types", f"WITH texts AS (SELECT *, CASE WHEN transaction_id % 3 = 0 THEN 'True' WHEN transaction_id % 3 = 1 THEN 'no' END AS flag, CASE WHEN transaction_id % 2 = 0 THEN '' ELSE '1.5e' || CAST(transaction_id % 3 AS VARCHAR) END AS share FROM raw_txn) {_FIRST}")
def src_08_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of columns that came as text."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "raw_txn").withColumns({"flag": F.when(i % 3 == 0, "True").when(i % 3 == 1, "no"), "share": F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("1.5e"), (i % 3).cast("string")))})
    return files.detected_text_types(rows, list(_TEXTS), "transaction_id")
