"""All queries by name, with the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import spark_sql, with_views
from . import alerting, composite, layered, limits, messages, monitoring, places, ranked, records, scoring, warehouse  # noqa: F401  they register their queries
from . import replays  # noqa: F401, I001  after those whose oracles it shares
from .derived import DERIVED
from .reports import REPORTS


def _report(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark_sql(spark, sf_dir, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> function of (spark, sf_dir)."""
    return {name: partial(_report, text=text) for name, text in REPORTS.items()} | {name: f for name, (f, _) in DERIVED.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL over the same tables."""
    texts = REPORTS | {name: text for name, (_, text) in DERIVED.items() if text is not None}
    return {name: with_views(text, "duckdb") for name, text in texts.items()}
