"""A batch's way through the layers of a warehouse: raw variants, staging, dimensions, facts, the day's summary.

Tables are DataFrames keyed by name in a dict; a load takes the tables as they are and returns them as they are after it.
Keys of dimensions are digests of what names a member, so that tasks need no common counter and a merchant's or place's key
needs no look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merge, ranks
from .lineage import scratch

#: Staged columns: name -> type of the raw field.
STAGED = {
    "transaction_id": "bigint", "account_id": "bigint", "customer_id": "bigint", "merchant_id": "bigint", "amount": "decimal(15,2)", "channel": "string",
    "country": "string", "city": "string", "status": "string", "ts": "string",
}
#: Fields without which a raw row isn't staged.
NEEDED = ("transaction_id", "account_id", "amount")
FOREVER = 2**53
EMPTY = {
    "staging": ", ".join(f"{c} {'timestamp_ntz' if c == 'ts' else t}" for c, t in STAGED.items()) + ", batch int",
    "customers": "customer_id bigint, tier string, largest decimal(15,2), valid_from bigint, valid_to bigint, is_current boolean",
    "merchants": "merchant_id bigint, n int",
    "places": "country string, city string",
    "facts": "transaction_id bigint, date_key int, customer_key string, merchant_key string, place_key string, amount decimal(15,2), score double, is_fraud boolean, is_flagged boolean, severity string, batch int",
    "daily": "date_key int, n bigint, total decimal(25,2), n_fraud bigint, fraud_total decimal(25,2), fraud_rate double, mean_score double, median_score double, n_high bigint, n_critical bigint, n_flagged bigint, customers_flagged bigint",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """The warehouse before its first batch."""
    return {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()}


def key_of(*parts: Column) -> Column:
    """A member's key; null if its first part is."""
    return F.when(parts[0].isNotNull(), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def staged(raw: DataFrame, batch: int) -> DataFrame:
    """Typed rows of a batch of ``raw`` (``raw_data`` variant, ``batch``). Rows that lack a field of ``NEEDED``, or have it in
    another type, are left out; other fields of a wrong type are null. A transaction that comes again stays once."""
    fields = F.struct(*[F.try_variant_get("raw_data", f"$.{c}", t).alias(c) for c, t in STAGED.items()])
    # rows that a generator makes: a filter on a field stays behind them, where pushed below it would read the raw data anew for each
    rows = raw.filter(F.col("batch") == batch).select(F.inline(F.array(fields)), F.col("batch").cast("int").alias("batch"))
    rows = rows.withColumn("ts", F.expr("try_to_timestamp(ts)").cast("timestamp_ntz")).dropna(subset=list(NEEDED))
    return rows.dropDuplicates(["transaction_id"])


def summary(facts: DataFrame, date_key: int) -> DataFrame:
    """The row of a day; no row if the day has no facts. The median is taken by ranges of scores, never in one task."""
    day = facts.filter(F.col("date_key") == date_key)
    fraud, flagged = F.col("is_fraud"), F.col("is_flagged")
    one = day.agg(
        F.count("*").alias("n"), F.sum("amount").cast("decimal(25,2)").alias("total"), F.count_if(fraud).alias("n_fraud"), F.coalesce(F.sum(F.when(fraud, F.col("amount"))), F.lit(0)).cast("decimal(25,2)").alias("fraud_total"),
        F.try_divide(F.count_if(fraud).cast("double"), F.count("*")).alias("fraud_rate"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= 0.8).alias("n_high"), F.count_if(F.col("score") >= 0.95).alias("n_critical"),
        F.count_if(flagged).alias("n_flagged"), F.count_distinct(F.when(flagged, F.col("customer_key"))).alias("customers_flagged"),
    ).filter("n > 0")
    median = ranks.percentiles(day, "score", {"median_score": 0.5})
    both = one.join(F.broadcast(median), how="left")  # one row each
    return both.select(F.lit(date_key).alias("date_key"), "n", "total", "n_fraud", "fraud_total", "fraud_rate", "mean_score", "median_score", "n_high", "n_critical", "n_flagged", "customers_flagged")


def kept(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables written below ``path`` and read back, so that the next batch starts from files, not from this one's plan."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}


def _stored(df: DataFrame) -> DataFrame:
    return kept({"rows": df}, scratch(df.sparkSession))["rows"]


def load(tables: dict[str, DataFrame], raw: DataFrame, profiles: DataFrame, scores: DataFrame, alerts: DataFrame, batch: int, date_key: int) -> dict[str, DataFrame]:
    """The warehouse after ``batch``, with the summary of the day ``date_key`` made anew.

    ``profiles`` (customer_id, tier, largest), ``scores`` (transaction_id, score) and ``alerts`` (transaction_id, severity,
    alert_status) have a row for each key. Transactions that staging has are not loaded again, so a batch that broke off can
    be loaded again; for merchants' counts and customers' versions only a batch with new transactions counts. Customers
    whose tier or largest amount changed get a version from this batch on; a fact takes the version that is current then.
    The batch's new rows and their facts are each made and stored once; the summary and its median read the stored facts."""
    new = _stored(merge.missing(staged(raw, batch), tables["staging"], ["transaction_id"]))  # stored once, as all layers read it
    seen = _stored(profiles.join(new.select("customer_id").distinct(), "customer_id", "left_semi"))
    customers = merge.scd2(tables["customers"], seen, "customer_id", ["tier", "largest"], F.lit(batch).cast("bigint"))
    customers = customers.withColumn("valid_to", F.coalesce("valid_to", F.lit(FOREVER)))
    merchants = merge.upsert_dimension(tables["merchants"], new, ["merchant_id"], "n")
    places = merge.insert_new_null_safe(tables["places"], new.filter("country is not null").withColumn("city", F.coalesce("city", F.lit(""))), ["country", "city"])
    current = customers.filter("is_current").select("customer_id", key_of(F.col("customer_id"), F.col("valid_from")).alias("customer_key"))
    rows = new.join(current, "customer_id", "left").join(scores.select("transaction_id", "score"), "transaction_id", "left").join(alerts.select("transaction_id", "severity", "alert_status"), "transaction_id", "left")
    facts = _stored(rows.select(
        "transaction_id", F.date_format("ts", "yyyyMMdd").cast("int").alias("date_key"), "customer_key", key_of(F.col("merchant_id")).alias("merchant_key"), key_of(F.col("country"), F.col("city")).alias("place_key"), "amount", "score",
        F.coalesce(F.col("alert_status") == "resolved", F.lit(False)).alias("is_fraud"), F.coalesce(F.col("status") == "flagged", F.lit(False)).alias("is_flagged"), "severity", "batch",
    ))
    facts = tables["facts"].unionByName(facts)
    daily = tables["daily"].filter(F.col("date_key") != date_key).unionByName(summary(facts, date_key))
    return {"staging": tables["staging"].unionByName(new), "customers": customers, "merchants": merchants, "places": places, "facts": facts, "daily": daily}
