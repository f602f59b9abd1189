"""Replayed streams give what batches give."""

import random

from pyspark.sql import functions as F

from tidemark.operators import frames
from tidemark.streaming import velocity

START = 1_767_225_600_000_000


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_keyed_velocity_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((START + rng.randrange(4 * 3600) * 1_000_000, i, rng.randrange(3), float(rng.randrange(100))) for i in range(120))
    df = spark.createDataFrame([(i, c, us, a) for us, i, c, a in rows], "transaction_id long, customer_id long, us long, amount double")
    path = str(tmp_path / "in")
    df.withColumn("ts", F.timestamp_micros("us")).select("transaction_id", "customer_id", "ts", "amount").coalesce(1).write.parquet(path)
    out = velocity.keyed_velocity(velocity.read_stream(spark, path))
    _drain(out.writeStream.outputMode("append").format("memory").queryName("kv").option("checkpointLocation", str(tmp_path / "c1")).start())
    got = {r["transaction_id"]: (r["n"], r["total"]) for r in spark.table("kv").collect()}
    hist = frames.history("customer_id", "us", 3600)
    want = {r["transaction_id"]: (r["n"], r["total"]) for r in df.select("transaction_id", F.count("*").over(hist).alias("n"), F.sum("amount").over(hist).alias("total")).collect()}
    assert len(got) == 120
    same_time = {us for us, *_ in rows if [r[0] for r in rows].count(us) > 1}
    for us, i, *_ in rows:
        if us not in same_time:
            assert got[i] == want[i]


def test_dedup_and_sliding(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, 1, START, 1.0), (1, 1, START, 1.0), (2, 1, START + 60_000_000, 2.0), (3, 1, START + 7200_000_000, 4.0)]
    df = spark.createDataFrame(rows, "transaction_id long, customer_id long, us long, amount double").withColumn("ts", F.timestamp_micros("us"))
    df.select("transaction_id", "customer_id", "ts", "amount").coalesce(1).write.parquet(path)
    _drain(velocity.deduplicated(velocity.read_stream(spark, path)).writeStream.outputMode("append").format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert sorted(r["transaction_id"] for r in spark.table("dd").collect()) == [1, 2, 3]
    _drain(velocity.sliding(velocity.read_stream(spark, path)).writeStream.outputMode("append").format("memory").queryName("sl").option("checkpointLocation", str(tmp_path / "c2")).start())
    final = spark.table("sl").collect()
    assert final and all(r["n"] in (2, 3) for r in final)


def test_late_rows_see_only_what_was_before(spark, tmp_path):
    """A row that comes after a later one counts what lies before it, and the state of newer rows stays."""
    path = tmp_path / "in"
    first, second = [(1, 1, START, 1.0), (2, 1, START + 240_000_000, 2.0)], [(3, 1, START + 120_000_000, 4.0), (4, 1, START + 250_000_000, 8.0)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "transaction_id long, customer_id long, us long, amount double").withColumn("ts", F.timestamp_micros("us")).select("transaction_id", "customer_id", "ts", "amount").coalesce(1).write.parquet(str(path / f"part{n}"))
    source = spark.readStream.schema(velocity.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    _drain(velocity.keyed_velocity(source).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start())
    got = {r["transaction_id"]: (r["n"], r["total"]) for r in spark.table("late").collect()}
    assert got == {1: (1, 1.0), 2: (2, 3.0), 3: (2, 5.0), 4: (4, 15.0)}
