"""Ranks, running totals and percentiles over whole tables, by ranges of values: no task sorts or holds them all.

Rows are first counted by value. The values are cut into ``PARTS`` ranges at approximate quantiles, so that ranges are
about equally large; the ranges' totals are few rows, and each range is ordered by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def part_of(counts: DataFrame, value: str, parts: int = PARTS) -> Column:
    """The range that a value is in, 0 to ``parts`` - 1; only the ranges' ends reach the driver."""
    ends = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("ends")).first()["ends"] or []
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(ends))]) if ends else F.array().cast("array<double>")
    return F.size(F.filter(bounds, lambda b: b < F.col(value)))


def running(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``counts`` (a row for each value, and ``by``) with ``upto_x``, the total of x up to and with the value, and ``all_x``."""
    by = by or []
    placed = counts.withColumn("__part", part_of(counts, value))
    order = F.col("__part").desc() if descending else F.col("__part")
    totals = placed.groupBy(*by, "__part").agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    before, whole = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # PARTS rows each
    totals = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__before_{x}") for x in sums], *[F.sum(f"__{x}").over(whole).alias(f"all_{x}") for x in sums])
    w = Window.partitionBy(*by, "__part").orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(totals) if not by else totals, [*by, "__part"])  # PARTS rows in all without groups
    return joined.withColumns({f"upto_{x}": F.col(f"__before_{x}") + F.sum(x).over(w) for x in sums}).drop("__part", *[f"__before_{x}" for x in sums])


def percentiles(rows: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Interpolated percentiles of ``value`` (double; nulls don't count), a column for each name, by group."""
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = running(counts, value, ["n"], by)
    picked = []
    for name, p in fractions.items():
        at = F.lit(p) * (F.col("all_n") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((F.col("upto_n") - F.col("n") <= index) & (index < F.col("upto_n")), F.col(value))).alias(f"__{side}_{name}"))
    out = placed.groupBy(*by).agg(F.max("all_n").alias("__n"), *picked)

    def one(name: str, p: float) -> Column:
        at = F.lit(p) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*by, *[one(name, p).alias(name) for name, p in fractions.items()])


def nearest_rank(rows: DataFrame, value: str, percent: int, name: str) -> DataFrame:
    """The least value that more than ``percent`` per cent of the rows, rounded down to whole rows, don't exceed."""
    placed = running(rows.groupBy(value).agg(F.count("*").alias("n")), value, ["n"])
    return placed.agg(F.min(F.when(F.col("upto_n") > F.floor(F.col("all_n") * percent / 100), F.col(value))).alias(name))


def by_label(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``p`` and ``n``: rows of label 1 and 0 for each score, and group."""
    return rows.groupBy(*(by or []), "score").agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"))


def roc(rows: DataFrame) -> DataFrame:
    """``score``, ``tpr``, ``fpr``, ``prec`` for each score as a threshold."""
    placed = running(by_label(rows), "score", ["p", "n"], descending=True)
    tp, fp = F.col("upto_p"), F.col("upto_n")
    return placed.select("score", F.round(tp / F.col("all_p"), 9).alias("tpr"), F.round(fp / F.col("all_n"), 9).alias("fpr"), F.round(tp / (tp + fp), 9).alias("prec"))


def auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``p``, ``n``, ``auc`` (ties count half) and ``average_precision``, by group; null without both labels."""
    by = by or []
    placed = running(by_label(rows, by), "score", ["p", "n"], by, descending=True)
    area = F.sum(F.col("n") * (2 * F.col("upto_p") - F.col("p"))).cast("double") / 2
    precision = F.sum(F.col("p").cast("double") * F.col("upto_p") / (F.col("upto_p") + F.col("upto_n")))
    out = placed.groupBy(*by).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), area.alias("__area"), precision.alias("__precision"))
    return out.select(*by, "p", "n", F.try_divide("__area", F.col("p").cast("double") * F.col("n")).alias("auc"), F.try_divide("__precision", "p").alias("average_precision"))


def ks(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """``ks``: the largest distance of two samples' distributions, and ``a`` and ``b``, their rows; ``first`` is true for rows of
    the first one."""
    counts = rows.groupBy(value).agg(F.count(F.when(first, 1)).alias("a"), F.count(F.when(~first, 1)).alias("b"))
    placed = running(counts, value, ["a", "b"])
    distance = F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))
    return placed.agg(F.max(distance).alias("ks"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def ks_p_value(distance: Column, a: Column, b: Column, terms: int = 20) -> Column:
    """The chance of a distance at least as large between two large samples of ``a`` and ``b`` rows from one distribution.

    Kolmogorov's series, in the form that converges fast: alternating for large distances, else its transform."""
    x = distance * F.sqrt(a.cast("double") * b / (a + b))
    large = sum(((2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1)), F.lit(0.0))
    small = 1.0 - F.try_divide(F.lit(math.sqrt(2 * math.pi)), x) * sum((F.exp(-((2 * k - 1) * math.pi) ** 2 / (8.0 * x * x)) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(x >= 1.0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), large))).when(x > 0.04, F.least(F.lit(1.0), F.greatest(F.lit(0.0), small))).when(x.isNotNull(), 1.0)
