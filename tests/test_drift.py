"""The Kolmogorov series against plain sums."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks


def series(x):
    if x <= 0.04:
        return 1.0
    if x < 0.5:
        return 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 60))
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 400))


def test_p_values(spark):
    cases = [(d, a, b) for d in (0.0, 0.001, 0.02, 0.05, 0.1, 0.3, 0.9, 1.0) for a, b in ((5, 7), (200, 150), (10_000, 90_000))]
    rows = spark.createDataFrame([*cases, (None, 1, 1)], "d double, a long, b long").select("d", "a", "b", ranks.ks_p_value(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows[:-1]:
        assert r["p"] == pytest.approx(series(r["d"] * math.sqrt(r["a"] * r["b"] / (r["a"] + r["b"]))), abs=1e-9)
    assert rows[-1]["p"] is None


def test_distance(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, False)], "x double, base boolean")
    got = ranks.ks(rows, "x", F.col("base")).first()
    assert got["ks"] == pytest.approx(2 / 3) and (got["a"], got["b"]) == (2, 3)
    assert ranks.ks(rows.filter("base"), "x", F.col("base")).first()["ks"] is None


def test_contamination(spark):
    import random

    import numpy as np

    from tidemark.operators import models

    rng = random.Random(3)
    rows = [(round(rng.gauss(0.3, 0.2), 2), None) for _ in range(300)] + [(round(rng.gauss(-0.2, 0.2), 2), True) for _ in range(20)]
    shares = [0.01, 0.05, 0.06, 0.2]
    got = models.contamination_scores(spark.createDataFrame(rows, "anomaly double, fraud boolean"), "fraud", shares).collect()
    x, y = np.array([r[0] for r in rows]), np.array([bool(r[1]) for r in rows])
    want = []
    for c in shares:
        flagged = x < np.percentile(x, 100 * c)
        want.append(2 * (flagged & y).sum() / (flagged.sum() + y.sum()))
    assert [r["f1"] for r in got] == pytest.approx(want) and [r["best"] for r in got] == [k == int(np.argmax(want)) for k in range(4)]
    assert not any(r["best"] for r in models.contamination_scores(spark.createDataFrame([(0.1, False)], "anomaly double, fraud boolean"), "fraud", shares).collect())
