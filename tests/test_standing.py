import random

from pyspark.sql import functions as F

from tidemark.operators import standing


def _brute(rows):
    want = {}
    for i, k, us, v in rows:
        past = [(u, j, x) for j, k2, u, x in rows if k2 == k and (u, j) < (us, i)]
        want[i] = None if not past else sum(x is not None and v is not None and x <= v for _, _, x in past) / len(past)
    return want


def _rows(n, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 5, 5, 5, rng.randrange(100), rng.randrange(10_000)])
    return [(i, rng.choice(["hot"] * 12 + [None, None, "a", "b"]), rng.randrange(n), value()) for i in range(n)]


def test_shares_of_earlier_values_with_and_without_frequent_keys(spark):
    rows = _rows(700, 3)
    df = spark.createDataFrame(rows, "id int, k string, us long, v long").repartition(4)
    for parts, seldom in ((256, 100_000), (16, 20), (3, 1)):
        got = {r["id"]: r["share"] for r in standing.share_not_above(df, "k", "v", "us", "id", parts=parts, seldom=seldom).collect()}
        assert got == _brute(rows), (parts, seldom)
    assert standing.share_not_above(df.limit(0), "k", "v", "us", "id").count() == 0


def test_one_value_and_one_instant(spark):
    for rows in ([(i, "k", i, 7) for i in range(100)], [(i, "k", 1, i % 9) for i in range(100)], [(i, "k", i, None) for i in range(100)]):
        df = spark.createDataFrame(rows, "id int, k string, us long, v long")
        got = {r["id"]: r["share"] for r in standing.share_not_above(df, "k", "v", "us", "id", parts=8, seldom=1).collect()}
        assert got == _brute(rows)


def test_no_task_holds_a_frequent_key(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 4 else "x", i, 5 if i % 3 else rng.randrange(10_000)) for i in range(8000)]
    df = spark.createDataFrame(rows, "id int, k string, us long, v long")
    blocks = standing.dealt(df, "k", "v", ("us", "id"), parts=16, seldom=1).groupBy("__key", "__cell", "__level", "__block").count()
    assert blocks.agg({"count": "max"}).first()[0] <= 2 * 8000 / 16
    got = standing.share_not_above(df, "k", "v", "us", "id", parts=16, seldom=1)
    assert got.columns == ["id", "k", "us", "v", "share"] and got.count() == 8000


def test_tasks_follow_the_rows(spark, monkeypatch):
    """More rows are dealt to more tasks, which Spark doesn't join to a few large ones."""
    monkeypatch.setattr(standing, "A_TASK", 500)
    rows = spark.range(2000).select((F.col("id") % 5).alias("k"), (F.col("id") * 7919 % 1000).alias("v"), F.col("id").alias("t"))
    out = standing.share_not_above(rows, "k", "v", "t")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r["t"]):
        earlier = seen.setdefault(r["k"], [])
        assert r["share"] == (sum(v <= r["v"] for v in earlier) / len(earlier) if earlier else None)
        earlier.append(r["v"])
