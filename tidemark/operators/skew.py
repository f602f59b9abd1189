"""Joins whose keys may be very frequent, and rows dealt to tasks of even size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in ``OFTEN`` of all rows is frequent, so there are fewer than ``OFTEN`` such keys.
OFTEN = 10_000
#: Keys of at most so many rows never are.
SELDOM = 10_000
#: Rows of one task where rows are dealt by keys.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, number: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in so many parts that each has about ``TASK_ROWS`` of a ``number`` of rows, so that what a task sorts
    or groups doesn't grow with their number. Two sides dealt by the same number are joined by these keys where they lie."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-number // TASK_ROWS)), *keys)


def join_frequent(rows: DataFrame, values: DataFrame | Callable[[DataFrame], DataFrame], counts: DataFrame, on: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``values`` (one row a key), given ``counts`` with the number ``n`` of rows of each key.

    ``values`` may be what makes them from rows of ``counts``, so that each key's is made once. Rows of frequent keys meet
    a broadcast of these keys' values, of which there are fewer than ``OFTEN``, and stay where they are; only the others are
    shuffled, so no task gathers the rows of one key. ``on`` must not be null."""
    made = values if callable(values) else lambda _: values
    least = max(SELDOM, (counts.agg(F.sum("n")).first()[0] or 0) // OFTEN)
    many = counts.filter(F.col("n") > F.lit(least))
    few = many.select(*on)
    if few.isEmpty():
        return rows.join(made(counts), on, "left")
    often = F.broadcast(few.join(made(many), on, "left"))
    rest = rows.join(F.broadcast(few), on, "left_anti").join(made(counts.filter(F.col("n") <= F.lit(least))), on, "left")
    return rows.join(often, on).select(*rest.columns).union(rest)
