"""Limits against taking rows one by one."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission
from tidemark.operators.lineage import cut

S = 1_000_000


def one_by_one(rows, most, seconds, storm=None):
    """rows: (id, key, at, counts)"""
    sent, until, out = defaultdict(list), {}, {}
    for i, key, at, counts in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [t for t in sent[key] if at - t < seconds * S]
        if at < until.get(key, at):
            out[i] = "storm"
        elif len(near) >= most:
            out[i] = "full"
        elif storm and len(near) >= storm[0]:
            out[i], until[key] = "storm", at + storm[1] * S
        else:
            out[i] = None
            if counts:
                sent[key].append(at)
    return out


@pytest.mark.parametrize(("most", "seconds", "storm"), [(3, 60, None), (1, 10, None), (50, 60, (8, 300)), (5, 60, (20, 30)), (4, 100, (3, 10))])
def test_limited(spark, most, seconds, storm):
    rng = random.Random(most)
    rows = []
    for k in ("a", "b", None):
        at = 0
        for _ in range(250):
            at += rng.choice([0, 0, 1, 2, 5, 5, 30, 700 if rng.random() < 0.2 else 1]) * S
            rows.append((len(rows), k, at - 500 * S, rng.random() < 0.9))
    rows += [(len(rows) + j, "hot", j * S // 2, True) for j in range(800)] + [(5000, "alone", 3, True), (5001, "tie", 7, True), (5002, "tie", 7, True)]
    df = spark.createDataFrame(rows, "id long, k string, at long, counts boolean").repartition(3)
    got = admission.limited(df, ["k"], "at", "id", most, seconds, F.col("counts"), storm).collect()
    assert {r["id"]: r["why"] for r in got} == one_by_one(rows, most, seconds, storm) and len(got) == len(rows)


def throttle(alerts, limits, storm):
    total, by, until, out = [], defaultdict(list), -1, {}
    for i, account, rule, at in sorted(alerts, key=lambda r: (r[3], r[0])):
        near = lambda times, span: sum(at - t < span * S for t in times)
        n = near(total, limits["total"][1])
        if at < until:
            out[i] = "storm"
        elif n >= limits["total"][0]:
            out[i] = "total"
        elif storm and n >= storm[0]:
            out[i], until = "storm", at + storm[1] * S
        elif near(by["a", account], limits["account"][1]) >= limits["account"][0]:
            out[i] = "account"
        elif rule and near(by["r", rule], limits["rule"][1]) >= limits["rule"][0]:
            out[i] = "rule"
        else:
            out[i] = None
            total.append(at)
            by["a", account].append(at)
            by["r", rule].append(at)
    return out


@pytest.mark.parametrize(("limits", "storm"), [
    ({"account": (3, 100), "rule": (4, 60), "total": (6, 20)}, None), ({"account": (5, 100), "rule": (9, 60), "total": (12, 20)}, (7, 90)), ({"account": (3, 50), "rule": (50, 60), "total": (100, 60)}, (200, 300)),
])
def test_three_limits_together(spark, limits, storm):
    rng = random.Random(9)
    alerts, at = [], 0
    for i in range(500):
        at += rng.choice([0, 1, 2, 4, 9, 60 if rng.random() < 0.05 else 3]) * S
        alerts.append((i, rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.choice(["x", "x", "y", None]), at))
    df = spark.createDataFrame(alerts, "alert_id long, account_id long, rule_id string, created_us long")
    got = admission.throttled(df, cut, limits, storm).collect()
    assert {r["alert_id"]: r["reason"] for r in got} == throttle(alerts, limits, storm) and len(got) == len(alerts)


def test_passes_dont_follow_the_time(spark):
    """A day of an account that is always full takes as many passes as an hour."""
    passes = []
    for hours in (1, 24):
        df = spark.range(hours * 120).select(F.col("id").alias("alert_id"), F.lit(1).alias("account_id"), F.lit(None).cast("string").alias("rule_id"), (F.col("id") * 30 * S).alias("created_us"))
        seen = []
        out = admission.throttled(df, lambda x: seen.append(1) or cut(x), {"account": (5, 3600), "rule": (50, 3600), "total": (100, 60)}, (200, 300))
        assert out.filter("reason is null").count() == 5 * hours
        passes.append(len(seen))
    assert passes[0] == passes[1] <= 6


def test_one_fold_where_all_limits_meet(spark):
    """Three limits that are full in the same alerts all the time don't take passes: the alerts are stored once."""
    rng = random.Random(3)
    alerts = [(i, rng.randrange(40), rng.choice(["x", "y", "z", None]), i * S // 4) for i in range(3000)]
    df = spark.createDataFrame(alerts, "alert_id long, account_id long, rule_id string, created_us long")
    limits, seen = {"account": (3, 90), "rule": (9, 60), "total": (12, 20)}, []
    got = admission.throttled(df, lambda x: seen.append(1) or cut(x), limits, (11, 7)).collect()
    assert {r["alert_id"]: r["reason"] for r in got} == throttle(alerts, limits, (11, 7)) and len(got) == len(alerts)
    assert len(seen) == 1


def test_a_crowded_key_takes_linear_time(spark):
    """Rows of one key that all look back at one another: no frame is counted anew for each row."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") * 1000).alias("at"))
    began = time.time()
    out = admission.limited(df, ["k"], "at", "id", 5, 3600)
    assert out.filter("why is null").agg(F.max("id"), F.count("*")).first() == (4, 5)
    assert time.time() - began < 30
