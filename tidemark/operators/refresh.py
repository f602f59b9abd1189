"""Aggregates kept as tables and refreshed from what is new: partial sums, extremes and distinct values, merged by key.

A table is cut into buckets of keys. Every bucket holds, in its rows, the time up to which it was refreshed, so a refresh
that broke off can be run again: buckets that it had written take nothing twice, the others all they lack. Rows that come
later with a time before that are not seen, as with any load by watermark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


@dataclass(frozen=True)
class Aggregate:
    """What a table keeps for each of ``keys``: ``sums`` and ``maxima`` of expressions, counts of ``distinct`` columns' values
    (null doesn't count). ``at`` is the source's time in microseconds."""

    keys: tuple[str, ...]
    at: str
    sums: dict[str, Column]
    maxima: dict[str, Column] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)
    buckets: int = 16


def _exists(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _merged(folder: str, new: DataFrame, by: list[str], aggregates: list[Column], touched: list[int], now: int) -> None:
    """Put ``new`` into the touched buckets of the table at ``folder``; the others' files stay as they are."""
    spark = new.sparkSession
    if _exists(spark, folder):
        new = spark.read.parquet(folder).filter(F.col("bucket").isin(touched)).drop("until_us").unionByName(new, allowMissingColumns=True)
    once = new.groupBy("bucket", *by).agg(*aggregates) if aggregates else new.select("bucket", *by).distinct()
    rows = cut(once.withColumn("until_us", F.lit(now).cast("bigint")))  # its own files are read
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def refreshed(folder: str, source: DataFrame, what: Aggregate, now: int) -> list[int]:
    """Bring the table at ``folder`` up to ``now`` and return the buckets that were rewritten.

    Only rows of ``source`` after a bucket's time are read into it. Deltas are aggregated in each task before they are
    shuffled; the times of buckets, a bounded number, are all that is broadcast. Without new rows nothing is written."""
    spark = source.sparkSession
    bucket = F.pmod(F.xxhash64(*what.keys), F.lit(what.buckets)).cast("int").alias("bucket")
    rows = source.filter(F.col(what.at) <= now).select("*", bucket)
    if _exists(spark, f"{folder}/sums"):
        marks = spark.read.parquet(f"{folder}/sums").groupBy("bucket").agg(F.max("until_us").alias("__until"))
        marks = cut(marks)
        least = marks.agg(F.count("*"), F.min("__until")).first()
        if least[0] == what.buckets:
            rows = rows.filter(F.col(what.at) > least[1])  # reaches the scan
        rows = rows.join(F.broadcast(marks), "bucket", "left").filter(F.col("__until").isNull() | (F.col(what.at) > F.col("__until"))).drop("__until")
    delta = cut(rows.groupBy("bucket", *what.keys).agg(*[F.sum(c).alias(n) for n, c in what.sums.items()], *[F.max(c).alias(n) for n, c in what.maxima.items()]))
    touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())
    if touched:
        for name, column in what.distinct.items():  # before the sums, whose times tell that all is done
            pairs = rows.filter(F.col(column).isNotNull()).select("bucket", *what.keys, F.col(column).alias("value")).distinct()
            _merged(f"{folder}/{name}", pairs, [*what.keys, "value"], [], touched, now)
        _merged(f"{folder}/sums", delta, list(what.keys), [*[F.sum(n).alias(n) for n in what.sums], *[F.max(n).alias(n) for n in what.maxima]], touched, now)
    return touched


def current(spark, folder: str, what: Aggregate) -> DataFrame:
    """The table as of its last refresh: keys, sums, maxima and counts of distinct values."""
    out = spark.read.parquet(f"{folder}/sums").select(*what.keys, *what.sums, *what.maxima)
    for name in what.distinct:
        keys = [F.col(k).alias(f"__{k}") for k in what.keys]
        counts = spark.read.parquet(f"{folder}/{name}").groupBy(*keys).agg(F.count("*").alias(name))
        same = F.lit(True)
        for k in what.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.join(counts, same, "left").withColumn(name, F.coalesce(name, F.lit(0))).drop(*[f"__{k}" for k in what.keys])
    return out


def due(spark, folder: str, now: int, lag_us: int) -> bool:
    """Whether the table was never refreshed or is older than its target lag."""
    if not _exists(spark, f"{folder}/sums"):
        return True
    until = spark.read.parquet(f"{folder}/sums").agg(F.max("until_us")).first()[0]
    return until is None or now - until >= lag_us
