"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in ``OFTEN`` of all rows counts as frequent, so there are fewer than ``OFTEN`` such keys.
OFTEN = 10_000
#: Keys of at most so many rows are never set apart.
SELDOM = 1_000
#: Rows of one Arrow batch handed to Python; bounds a worker's memory when documents are long.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Limit Arrow batches, so that batches of very long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir``, which a cluster must set; a temporary one only where
    driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: later stages neither recompute it nor depend on
    the executors that made it. The files go when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, whose ``n`` counts the rows of each key; ``keys`` must be cheap to read again.

    Rows of frequent keys meet a broadcast of these keys, of which there are fewer than ``OFTEN``, and stay where they
    are; only the others are shuffled, so no task gathers the rows of one key."""
    least = max(SELDOM, (keys.agg(F.sum("n")).first()[0] or 0) // OFTEN)
    few = keys.filter(F.col("n") > F.lit(least))
    if few.isEmpty():
        return rows.join(keys, on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keys.filter(F.col("n") <= F.lit(least)), on)
    return rows.join(F.broadcast(few), on).select(*rest.columns).union(rest)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of ``docs``; any other columns are left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Join small batches until they hold about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def written(df: DataFrame) -> str:
    """Write ``df`` as parquet in a fresh shared folder, which goes with ``removed`` or when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made and that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
