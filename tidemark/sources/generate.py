"""Generated transactions, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of generated fraud.
PATTERNS = ("high_amount", "rapid", "far_away", "card_testing", "night")
START_US = 1_767_225_600_000_000


def _draw(name: str, seed: int) -> Column:
    """0 to 1, the same for an id, a name and a seed wherever it is computed."""
    return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(1_000_003)) / 1_000_003


def transactions(spark: SparkSession, n: int, fraud_rate: float = 0.05, customers: int = 100, seed: int = 1) -> DataFrame:
    """``n`` transactions of which about ``fraud_rate`` follow one of ``PATTERNS``; ``pattern`` is ``none`` for the others.

    Each row follows from its id and the seed alone, so any part can be made again anywhere."""
    return columns(spark.range(n), fraud_rate, customers, seed)


def columns(ids: DataFrame, fraud_rate: float, customers: int, seed: int) -> DataFrame:
    """The same from any frame with an ``id``."""
    draw = lambda name: _draw(name, seed)
    pattern = F.when(draw("is_fraud") < fraud_rate, F.element_at(F.array(*map(F.lit, PATTERNS)), (F.floor(draw("pattern") * len(PATTERNS)) + 1).cast("int"))).otherwise("none")
    rows = ids.withColumns({"pattern": pattern, "customer_id": F.floor(draw("customer") * customers).cast("bigint"), "us": F.lit(START_US) + F.col("id") * 1_000_000})
    is_ = lambda p: F.col("pattern") == p
    usual = 5 + 195 * draw("amount")
    amount = F.when(is_("high_amount"), 5000 + 4999 * draw("amount")).when(is_("card_testing"), 0.5 + 4 * draw("amount")).when(is_("night"), 2000 + 1000 * draw("amount")).otherwise(usual)
    hour = F.when(is_("night"), F.floor(draw("hour") * 5)).otherwise(6 + F.floor(draw("hour") * 18))
    us = F.when(is_("rapid"), F.col("us") - F.col("id") % 60 * 1_000_000).otherwise(F.col("us") - F.col("us") % 86_400_000_000 + hour.cast("bigint") * 3_600_000_000 + F.col("id") % 3600 * 1_000_000)
    return rows.withColumns({"us": us, "amount": F.round(amount, 2), "country": F.when(is_("far_away"), "NG").otherwise("US"), "is_fraud": F.col("pattern") != "none"}).withColumnRenamed("id", "transaction_id")


def transaction_stream(spark: SparkSession, rate: int = 10, fraud_rate: float = 0.05, customers: int = 100, seed: int = 1) -> DataFrame:
    """``rate`` generated transactions a second, without end."""
    ids = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("id"))
    return columns(ids, fraud_rate, customers, seed)
