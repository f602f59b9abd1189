"""Streams taken batch by batch to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame


def finished(stream: DataFrame, path: str, marks: str, mode: str = "append") -> None:
    """Write all that is there now to a parquet table, with progress kept under ``marks``; return when it is done."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", marks).format("parquet").option("path", path).start().awaitTermination()


def drained(stream: DataFrame, reason: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """All batches that are there now, processed: rows without a ``reason`` and the others with it, as two tables.

    A batch writes to folders of its own number in place of what an earlier try left, and progress is kept after it, so
    rows are neither lost nor doubled when a batch is tried again."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.withColumn("reason", reason).persist()
        held.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        held.filter("reason is not null").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        held.unpersist()

    stream.writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", f"{path}/marks").start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.parquet(f"{path}/good").drop("batch"), spark.read.parquet(f"{path}/dead").drop("batch")


def fan_out(stream: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], path: str, after: Callable[[int, int], None] | None = None) -> dict[str, DataFrame]:
    """Every batch written to several tables, each from its own view of the batch, which is computed once.

    A batch that is tried again replaces what it had written. ``after`` is told each batch's number and rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, shape in tables.items():
            shape(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        if after is not None:
            after(number, batch.count())
        batch.unpersist()

    stream.writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", f"{path}/marks").start().awaitTermination()
    return {name: stream.sparkSession.read.parquet(f"{path}/{name}").drop("batch") for name in tables}
