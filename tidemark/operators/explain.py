"""Why a model of trees gives a row its score: each input's share of the margin.

A tree is the sum of its leaves. On the way to a leaf an input is either held to an interval, which a row meets or not,
or unknown, and then the way is taken with the share of training rows that took it. An input's share is the mean, over
all orders in which inputs become known, of what knowing it changes. For one leaf this is a polynomial in the inputs on
its way, so all rows of a batch are told at once, in time that grows with leaves and the square of the depth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """``value``, and for each input on the way: its number, the interval (low, high] and the share of rows that met it."""

    value: float
    inputs: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


@dataclass(frozen=True)
class Node:
    """A node: rows that came to it, and either ``value`` or a split (left if the input is at most ``cut``)."""

    rows: float
    value: float = 0.0
    input: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def leaves_of(root: Node, weight: float = 1.0) -> list[Leaf]:
    """The leaves of a tree with their ways."""
    out: list[Leaf] = []
    stack: list[tuple[Node, dict[int, tuple[float, float, float]]]] = [(root, {})]
    while stack:
        node, way = stack.pop()
        if node.left is None or node.right is None:
            out.append(Leaf(node.value * weight, tuple(way), *(tuple(w[k] for w in way.values()) for k in range(3))))
            continue
        low, high, share = way.get(node.input, (-np.inf, np.inf, 1.0))
        for child, a, b in ((node.left, low, min(high, node.cut)), (node.right, max(low, node.cut), high)):
            stack.append((child, way | {node.input: (a, b, share * child.rows / node.rows if node.rows else 0.0)}))
    return out


def attributions(leaves: list[Leaf], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The value when nothing is known, and each row's and input's share; they add up to the row's value."""
    base, out = 0.0, np.zeros(x.shape)
    for leaf in leaves:
        d, share = len(leaf.inputs), np.array(leaf.share)
        base += leaf.value * float(np.prod(share))
        met = [((x[:, j] > low) & (x[:, j] <= high)).astype(float) for j, low, high in zip(leaf.inputs, leaf.low, leaf.high, strict=True)]
        weights = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        for i, j in enumerate(leaf.inputs):
            terms = [np.ones(len(x))]  # by the number of other inputs that are known
            for k in range(d):
                if k != i:
                    unknown, known = [t * share[k] for t in terms], [t * met[k] for t in terms]
                    terms = [a + b for a, b in zip([*unknown, 0.0], [0.0, *known], strict=True)]
            out[:, j] += leaf.value * (met[i] - share[i]) * sum(w * t for w, t in zip(weights, terms, strict=True))
    return base, out


def nodes_of(model) -> list[tuple[Node, float]]:
    """The trees of an MLlib ensemble with their weights; as many nodes as its parameters allow come to the driver."""

    def read(node) -> Node:
        rows = float(node.impurityStats().count())
        if node.getClass().getSimpleName() == "LeafNode":
            return Node(rows, float(node.prediction()))
        split = node.split()
        return Node(rows, 0.0, int(split.featureIndex()), float(split.threshold()), read(node.leftChild()), read(node.rightChild()))

    return [(read(tree._call_java("rootNode")), float(w)) for tree, w in zip(model.trees, model.treeWeights, strict=True)]


def explained(rows: DataFrame, key: str, inputs: list[str], model, most: int = 10) -> DataFrame:
    """``key``, ``base``, ``margin`` and ``reasons``: the ``most`` inputs with the largest shares of the margin either way.

    A reason has ``feature``, ``contribution``, ``value`` and ``direction`` (``increases_risk`` or ``decreases_risk``), largest
    first, equal ones in the order of ``inputs``. ``base`` and all contributions add up to ``margin``, the ensemble's sum before it
    becomes a probability. Missing inputs count as 0; splits must be on numbers. Rows stay where they are."""
    leaves = [leaf for root, weight in nodes_of(model) for leaf in leaves_of(root, weight)]
    shared = rows.sparkSession.sparkContext.broadcast(leaves)  # at most trees * 2^depth
    kind = rows.schema[key].dataType.simpleString()
    reason = pa.struct([("feature", pa.string()), ("contribution", pa.float64()), ("value", pa.float64()), ("direction", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"__{j}").to_numpy(zero_copy_only=False) for j in range(len(inputs))]).astype(float)
            base, shares = attributions(shared.value, x)
            order = np.argsort(-np.abs(shares), axis=1, kind="stable")[:, :most]
            told = [[{"feature": inputs[j], "contribution": float(s[j]), "value": float(v[j]), "direction": "increases_risk" if s[j] > 0 else "decreases_risk"} for j in o] for o, s, v in zip(order, shares, x, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(x), base)), pa.array(base + shares.sum(axis=1)), pa.array(told, pa.list_(reason))], [key, "base", "margin", "reasons"])

    wanted = rows.select(key, *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(f"__{j}") for j, c in enumerate(inputs)])
    return wanted.mapInArrow(run, f"{key} {kind}, base double, margin double, reasons array<struct<feature string, contribution double, value double, direction string>>")
