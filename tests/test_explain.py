"""Shares of a margin against enumerating all orders, and over MLlib's own trees."""

import random
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import explain, models
from tidemark.operators.explain import Node

rng = random.Random(8)


def grown(depth, rows):
    if depth == 0 or rng.random() < 0.15:
        return Node(rows, rng.uniform(-1, 1))
    left = rng.randrange(1, int(rows))
    return Node(rows, 0.0, rng.randrange(4), rng.choice([-0.5, 0.0, 0.3]), grown(depth - 1, left) if left > 2 else Node(left, rng.uniform(-1, 1)), grown(depth - 1, rows - left) if rows - left > 2 else Node(rows - left, rng.uniform(-1, 1)))


def expected(node, x, known):
    if node.left is None:
        return node.value
    if node.input in known:
        return expected(node.left if x[node.input] <= node.cut else node.right, x, known)
    return (node.left.rows * expected(node.left, x, known) + node.right.rows * expected(node.right, x, known)) / node.rows


def shares(node, x, d=4):
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        out.append(sum((expected(node, x, {*s, i}) - expected(node, x, set(s))) / (d * comb(d - 1, k)) for k in range(d) for s in combinations(rest, k)))
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_shares_are_those_of_all_orders(depth):
    x = np.array([[rng.choice([-1, -0.5, -0.2, 0, 0.1, 0.3, 2]) for _ in range(4)] for _ in range(12)])
    for _ in range(5):
        tree = grown(depth, 1000)
        base, got = explain.attributions(explain.leaves_of(tree), x)
        assert np.allclose(got, [shares(tree, row) for row in x]) and np.isclose(base, expected(tree, x[0], set()))
        assert np.allclose(base + got.sum(axis=1), [expected(tree, row, set(range(4))) for row in x])


def test_shares_add_up_to_the_models_margin(spark):
    rows = spark.range(1500).select("id", (F.col("id") % 97).alias("a"), (F.col("id") * 7 % 31).alias("b"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("c"), F.lit(1).alias("d"))
    rows = rows.withColumn("label", ((F.col("a") > 60) & (F.col("b") > 10) | (F.col("id") % 41 == 0)).cast("int"))
    model = models.RiskModel(["a", "b", "c", "d"], trees=4, depth=4).fit(rows)
    out = explain.explained(rows, "id", model.inputs, model.model, most=3).join(model.predict(rows).select("id", "raw"), "id").collect()
    assert len(out) == 1500 and len({r["margin"] for r in out}) > 2
    for r in out:
        assert 1 / (1 + np.exp(-2 * r["margin"])) == pytest.approx(r["raw"], abs=1e-9)
        sizes = [abs(x["contribution"]) for x in r["reasons"]]
        assert len(sizes) == 3 and sizes == sorted(sizes, reverse=True) and all((x["contribution"] > 0) == (x["direction"] == "increases_risk") for x in r["reasons"])
        assert r["base"] + sum(x["contribution"] for x in r["reasons"]) == pytest.approx(r["margin"], abs=1e-9)  # d splits nothing
    assert explain.explained(rows.limit(0), "id", model.inputs, model.model).count() == 0
