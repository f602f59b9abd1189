"""Queries over whole stages: records through all steps, streams replayed to their end, models, generated data, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, explain, merge, models, validate
from ..operators.lineage import scratch
from ..sources import generate
from ..sources import reference as ref
from ..sources.views import view
from ..streaming import microbatch, velocity
from .derived import query


@query("stg_01_records", """
    SELECT 'enriched' AS outcome, COUNT(*) AS n FROM raw_txn WHERE transaction_id % 20 <> 19 AND m % 6 <> 4 AND m % 9 <> 4
    UNION ALL SELECT 'duplicate', COUNT(*) FILTER (WHERE transaction_id % 20 = 19) FROM raw_txn
    UNION ALL SELECT 'amount', COUNT(*) FILTER (WHERE transaction_id % 20 <> 19 AND m % 6 = 4) FROM raw_txn
    UNION ALL SELECT 'country', COUNT(*) FILTER (WHERE transaction_id % 20 <> 19 AND m % 6 <> 4 AND m % 9 = 4) FROM raw_txn""")
def stg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cleaned, checked stage by stage and normalised: one plan, with the good rows and the dead letters counted."""
    rows = clean.cleaned(view(spark, sf_dir, "raw_txn").drop("m", "amount"), ["transaction_id"])
    good, dead = validate.routed(rows, {"duplicate": (F.col("is_duplicate"), "skip"), "amount": (F.col("transaction_amount").try_cast("double").isNull(), "skip"), "country": (F.col("geo_country").isNull(), "skip")})
    done = clean.normalised(good.withColumn("merchant_category_code", F.col("mcc")))
    return done.select(F.lit("enriched").alias("outcome")).union(dead.select("failed_stage")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("stg_16_warehouse", """
    SELECT 'fact' AS step, COUNT(*) AS n FROM txn UNION ALL SELECT 'merchants', COUNT(DISTINCT merchant_id) FROM txn UNION ALL SELECT 'customers', COUNT(DISTINCT customer_id) FROM txn UNION ALL SELECT 'reports', COUNT(DISTINCT CAST(ts AS DATE)) FROM txn""")
def stg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch taken from raw rows to staging, dimensions, facts and a report, with the rows of each step."""
    raw = view(spark, sf_dir, "txn")
    staged = merge.upsert(raw.limit(0).select("transaction_id", "customer_id", "merchant_id", "amount", "ts"), raw.select("transaction_id", "customer_id", "merchant_id", "amount", "ts"), ["transaction_id"])
    merchants = merge.upsert_dimension(spark.createDataFrame([], "merchant_id bigint, n int"), staged, ["merchant_id"], "n")
    customers = merge.scd2(spark.createDataFrame([], "customer_id bigint, tier string, valid_from int, valid_to int, is_current boolean"), staged.select("customer_id").distinct().withColumn("tier", F.lit("standard")), "customer_id", ["tier"], F.lit(1))
    fact = merge.missing(staged, spark.createDataFrame([], "transaction_id bigint"), ["transaction_id"]).join(merchants.select("merchant_id"), "merchant_id", "left")
    reports = fact.groupBy(F.to_date("ts").alias("day")).agg(F.sum("amount").alias("total"))
    parts = {"fact": fact, "merchants": merchants, "customers": customers.filter("is_current"), "reports": reports}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for name, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of a transaction's columns."""
    source = velocity.read_stream(spark, f"{sf_dir}/events.parque[t]", _EVENTS)  # a pattern, as the table may be one file
    return source.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"), "event_type")


@query("st_01_microbatches", "SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value < 1) AS dead FROM events GROUP BY event_type")
def st_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's batches processed to two tables, each written once however often a batch is tried again."""
    good, dead = microbatch.drained(_stream(spark, sf_dir), F.when(F.col("amount") < 1, "too small"), scratch(spark))
    rows = good.select("event_type", F.lit(0).alias("d")).union(dead.select("event_type", F.lit(1)))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("d").cast("bigint").alias("dead"))


@query("st_02_velocity_state", "SELECT event_id AS transaction_id, COUNT(*) OVER w AS n, ROUND(SUM(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
def st_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last day, kept as state and read as rows come."""
    path = scratch(spark)
    microbatch.finished(velocity.keyed_velocity(_stream(spark, sf_dir).drop("event_type"), 86_400), f"{path}/rows", f"{path}/marks")
    return spark.read.parquet(f"{path}/rows").select("transaction_id", "n", F.round("total", 6).alias("total"))


@query("st_05_first_of_key", "SELECT DISTINCT event_id AS transaction_id FROM events")
def st_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each transaction of a stream that tells some twice."""
    path = scratch(spark)
    stream = _stream(spark, sf_dir)
    twice = stream.select(F.explode(F.when(F.col("transaction_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"), "*")
    microbatch.finished(velocity.deduplicated(twice.drop("copy")), f"{path}/rows", f"{path}/marks")
    return spark.read.parquet(f"{path}/rows").select("transaction_id")


@query("src_19_generated")
def src_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated transactions with planted patterns: the share and the amounts of each."""
    rows = generate.transactions(spark, 20_000, fraud_rate=0.08, seed=11)
    return rows.groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 2).alias("mean"))



@query("src_18_reference_tables", "SELECT * FROM (VALUES ('card', 15), ('channel', 27), ('country', 110), ('country_risk', 40), ('currency', 17), ('mcc', 134), ('mcc_risk', 46), ('rate', 20), ('type', 24)) AS t(name, n)")
def src_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference tables as frames, by their sizes."""
    tables = {"rate": ref.RATES, "currency": ref.CURRENCY_ALIASES, "country": ref.COUNTRY_ALIASES, "type": ref.TYPE_ALIASES, "channel": ref.CHANNEL_ALIASES, "card": ref.CARD_ALIASES, "mcc": ref.MCC_NAMES, "country_risk": ref.COUNTRY_RISK, "mcc_risk": ref.MCC_RISK}
    rows = None
    for name, table in tables.items():
        one = ref.as_frame(spark, table).select(F.lit(name).alias("name"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("name").agg(F.count("*").cast("int").alias("n"))


INPUTS = ["amount", "lat", "lon", "mcc_slot"]


@query("udf_05_anomaly")
def udf_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction's strangeness by an isolation forest."""
    txns = view(spark, sf_dir, "txn")
    return models.score_forest(txns, "transaction_id", INPUTS, models.fit_forest(txns, "transaction_id", INPUTS))


def _risk_model(spark: SparkSession, sf_dir: str) -> tuple[models.RiskModel, DataFrame]:
    """A model trained on the first part of the time and calibrated on the second, and the rows of the rest."""
    rows = view(spark, sf_dir, "risk_txn").withColumn("label", ((F.col("amount") > 5000) & (F.col("status") == "declined") | (F.col("transaction_id") % 97 == 0)).cast("int"))
    part = F.when(F.col("us") < 1_705_000_000_000_000, "train").when(F.col("us") < 1_705_600_000_000_000, "calibrate").otherwise("test")
    marked = rows.withColumn("part", part)
    model = models.RiskModel(["amount", "lat", "lon", "merchant_id"]).fit(marked.filter("part = 'train'"), marked.filter("part = 'calibrate'"))
    return model, marked.filter("part = 'test'")


@query("udf_06_risk_model")
def udf_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees trained on the first part of the time, calibrated on the second, applied to the rest."""
    model, rows = _risk_model(spark, sf_dir)
    return model.predict(rows).select("transaction_id", F.round("risk", 6).alias("risk"))


@query("udf_06_explanation")
def udf_06_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each input adds to the margin of every row that the model is applied to."""
    model, rows = _risk_model(spark, sf_dir)
    out = explain.explained(rows, "transaction_id", model.inputs, model.model)
    return out.select("transaction_id", F.round("base", 6).alias("base"), F.round("margin", 6).alias("margin"), F.posexplode("reasons").alias("place", "reason")).select("transaction_id", "base", "margin", "place", "reason.feature", F.round("reason.contribution", 6).alias("contribution"), "reason.value", "reason.direction")


@query("udf_08_registry", "SELECT * FROM (VALUES ('a', '1', 'archived', 30), ('a', '2', 'production', 40), ('a', '3', 'archived', 40), ('b', '1', 'production', 5)) AS t(model, version, status, changed)")
def udf_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions promoted, which archives the ones before, and rolled back."""
    registry = spark.createDataFrame([("a", "1", "production", 10), ("a", "2", "staging", 11), ("a", "3", "staging", 12), ("b", "1", "production", 5)], "model string, version string, status string, changed int")
    registry = models.promoted(registry, "a", "2", F.lit(30))
    return models.rolled_back(models.promoted(registry, "a", "3", F.lit(35)), "a", F.lit(40))


@query("snk_18_fan_out", "SELECT 'all' AS sink, COUNT(*) AS n FROM events UNION ALL SELECT 'purchases', COUNT(*) FILTER (WHERE event_type = 'purchase') FROM events UNION ALL SELECT 'customers', COUNT(DISTINCT user_id) FROM events")
def snk_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's batches written to three tables at once."""
    shapes = {"all": lambda b: b, "purchases": lambda b: b.filter("event_type = 'purchase'"), "customers": lambda b: b.select("customer_id").distinct()}
    out = microbatch.fan_out(_stream(spark, sf_dir), shapes, scratch(spark))
    counts = [(df.distinct() if name == "customers" else df).agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n") for name, df in out.items()]
    return counts[0].union(counts[1]).union(counts[2])
