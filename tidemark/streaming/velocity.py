"""Streaming counterparts of the velocity operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "transaction_id long, customer_id long, ts timestamp, amount double"


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Transactions as parquet files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def deduplicated(stream: DataFrame, late: str = "5 minutes") -> DataFrame:
    """First of each transaction within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["transaction_id"])


def sliding(stream: DataFrame, span: str = "1 hour", slide: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """Count and sum for each customer in sliding windows; a window is final once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", span, slide).alias("w"), "customer_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total")).select("w.start", "w.end", "customer_id", "n", "total")


def keyed_velocity(stream: DataFrame, seconds: int = 3600, late: str = "5 minutes") -> DataFrame:
    """For each transaction, its customer's count and sum over the ``seconds`` before it, itself included.

    Rows that come late see only what happened before them, and rows that came before them are not told again. A
    customer's state is the times and amounts within the span and the delay behind its newest transaction; it ends once
    the watermark has passed the span, so it is bounded by the traffic of that time."""
    span = seconds * 1_000_000

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, amounts = state.get if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values(["ts", "transaction_id"])
        at = [x.value // 1000 for x in new["ts"]]
        # all rows in time order; of equal times, those held and those that came first in order
        held = sorted([(t, 0, i, a, None) for i, (t, a) in enumerate(zip(times, amounts, strict=True))] + [(t, 1, i, a, x) for i, (t, a, x) in enumerate(zip(at, new["amount"], new["transaction_id"], strict=True))], key=lambda r: r[:3])
        out, start, total = [], 0, 0.0
        for n, (t, _, _, amount, transaction) in enumerate(held):
            total += amount
            while t - held[start][0] > span:
                total -= held[start][3]
                start += 1
            if transaction is not None:
                out.append((transaction, key[0], n + 1 - start, total))
        newest = held[-1][0]
        # rows that come late, but before the watermark, may still look back from before the newest
        kept = [(r[0], r[3]) for r in held if r[0] >= newest - span - delay]
        state.update(([t for t, _ in kept], [a for _, a in kept]))
        state.setTimeoutTimestamp(max((newest + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["transaction_id", "customer_id", "n", "total"])

    delay = int(pd.Timedelta(late).total_seconds() * 1_000_000)
    return stream.withWatermark("ts", late).groupBy("customer_id").applyInPandasWithState(update, "transaction_id long, customer_id long, n long, total double", "times array<long>, amounts array<double>", "append", GroupStateTimeout.EventTimeTimeout)
