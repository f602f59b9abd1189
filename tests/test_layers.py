import json

from pyspark.sql import functions as F

from tidemark.operators import layers


def _raw(spark, rows):
    return spark.createDataFrame([(json.dumps(r), b) for r, b in rows], "j string, batch int").select(F.parse_json("j").alias("raw_data"), "batch")


def _tx(i, customer, amount, **more):
    return {"transaction_id": i, "account_id": 1, "customer_id": customer, "merchant_id": 7, "amount": amount, "channel": "pos", "country": "US", "city": None, "status": "approved", "ts": "2024-01-15 10:00:00"} | more


def test_batches_on_filled_tables(spark):
    raw = _raw(spark, [(_tx(1, 1, 5.25), 1), (_tx(2, 2, 8, status="flagged"), 1), (_tx(None, 1, 5), 1), (_tx(3, 1, "many"), 1), (_tx(4, 1, None), 1), (_tx(1, 1, 5.25), 1), (_tx(5, 1, 9, merchant_id=None, ts="soon"), 2), (_tx(6, 3, 1, country=None), 2), (_tx(2, 2, 8), 2)])
    profiles = lambda *r: spark.createDataFrame(list(r), "customer_id long, tier string, largest double").withColumn("largest", F.col("largest").cast("decimal(15,2)"))
    scores = spark.createDataFrame([(1, 0.5), (2, 0.97)], "transaction_id long, score double")
    alerts = spark.createDataFrame([(2, "high", "resolved")], "transaction_id long, severity string, alert_status string")
    first = layers.load(layers.empty(spark), raw, profiles((1, "low", 5.0), (2, "low", 8.0), (9, "low", 1.0)), scores, alerts, 1, 20240115)
    assert [tuple(r)[:5] for r in first["daily"].collect()] == [(20240115, 2, first["daily"].first()["total"], 1, first["daily"].first()["fraud_total"])]
    assert first["daily"].first()["median_score"] == 0.735 and first["daily"].first()["customers_flagged"] == 1
    second = layers.load(first, raw, profiles((1, "high", 9.0), (2, "high", 8.0), (3, "low", 1.0)), scores, alerts, 2, 20240115)
    assert sorted((r["customer_id"], r["tier"], r["valid_from"], r["is_current"]) for r in second["customers"].collect()) == [(1, "high", 2, True), (1, "low", 1, False), (2, "low", 1, True), (3, "low", 2, True)]
    facts = {r["transaction_id"]: r for r in second["facts"].collect()}
    assert sorted(facts) == [1, 2, 5, 6] and second["facts"].count() == 4
    assert facts[1]["customer_key"] != facts[5]["customer_key"] and facts[5]["merchant_key"] is None and facts[5]["date_key"] is None and facts[6]["place_key"] is None
    assert facts[2]["is_fraud"] and facts[2]["is_flagged"] and not facts[1]["is_fraud"]
    assert [tuple(r) for r in second["merchants"].collect()] == [(7, 2)] and [tuple(r) for r in second["places"].collect()] == [("US", "")]
    assert second["daily"].count() == 1 and second["daily"].first()["n"] == 3


def test_a_batch_loaded_again_and_one_without_rows(spark):
    raw = _raw(spark, [(_tx(1, 1, 5), 1)])
    profiles = spark.createDataFrame([(1, "low", 5.0)], "customer_id long, tier string, largest double").withColumn("largest", F.col("largest").cast("decimal(15,2)"))
    scores, alerts = spark.createDataFrame([], "transaction_id long, score double"), spark.createDataFrame([], "transaction_id long, severity string, alert_status string")
    once = layers.load(layers.empty(spark), raw, profiles, scores, alerts, 1, 20240115)
    for again in (layers.load(once, raw, profiles, scores, alerts, 1, 20240115), layers.load(once, raw, profiles, scores, alerts, 5, 20240101)):
        assert {k: sorted(map(tuple, df.collect()), key=str) for k, df in again.items()} == {k: sorted(map(tuple, df.collect()), key=str) for k, df in once.items()}


def test_raw_data_is_read_once_a_row(spark):
    """However many fields are needed, a row's JSON is parsed once when it is staged."""
    raw = spark.range(9).select(F.parse_json(F.to_json(F.struct(F.col("id").alias("transaction_id"), F.lit(1).alias("account_id"), F.lit(2.5).alias("amount")))).alias("raw_data"), F.lit(1).alias("batch"))
    rows = layers.staged(raw, 1)
    assert rows.count() == 9
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
