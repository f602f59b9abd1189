"""Distances and risk formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
#: Breach thresholds, warning and critical, by metric: fixed values.
BREACHES = {
    "n_1m": (3, 5),
    "n_5m": (8, 15),
    "n_1h": (20, 50),
    "n_24h": (100, 200),
    "sum_1m": (1000.0, 5000.0),
    "sum_5m": (3000.0, 10000.0),
    "sum_1h": (10000.0, 50000.0),
    "sum_24h": (50000.0, 100000.0),
    "merchants_1h": (5, 10),
    "merchants_24h": (15, 30),
}
#: Ensemble presets: weights of rules, anomaly and model, and the cuts of medium, high and critical.
ENSEMBLES = {"online": ((0.3, 0.3, 0.4), (0.3, 0.6, 0.85)), "batch": ((0.30, 0.25, 0.45), (0.5, 0.8, 0.95))}


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_MILES) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def graded(score: Column, cuts: tuple[float, float, float]) -> Column:
    """low, medium, high or critical."""
    medium, high, critical = cuts
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def ensemble(rules: Column, anomaly: Column, model: Column, weights: tuple[float, float, float]) -> Column:
    """Weighted mean of the scores that are there; 0 if none is. Scores are clipped to 0..1."""
    pairs = list(zip((rules, anomaly, model), weights, strict=True))
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in pairs), F.lit(0.0))
    value = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in pairs), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(value, total), F.lit(0.0))))


def noisy_or(confidences: Column) -> Column:
    """1 - the product of (1 - p) over an array, to 4 places."""
    return F.round(1 - F.aggregate(confidences, F.lit(1.0), lambda a, p: a * (1 - p)), 4)


def raised(severities: Column, per_tier: int = 2, most: int = 3) -> Column:
    """Highest of an array of tiers 0..3, one more for each ``per_tier`` further matches (0: never), at most ``most``; null
    if empty."""
    more = F.floor((F.size(severities) - 1) / per_tier).cast("int") if per_tier else F.lit(0)
    return F.when(F.size(severities) > 0, F.least(F.lit(most), F.array_max(severities) + more))


def breaches(thresholds: dict[str, tuple[float, float]] = BREACHES) -> Column:
    """Array of metric and level for every threshold that a metric's column reaches; critical outranks warning."""
    found = [F.when(F.col(m) >= c, F.struct(F.lit(m).alias("metric"), F.lit("critical").alias("level"))).when(F.col(m) >= w, F.struct(F.lit(m).alias("metric"), F.lit("warning").alias("level"))) for m, (w, c) in thresholds.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def breach_risk(found: Column) -> Column:
    """0.3 for each critical breach and 0.1 for each warning, at most 1."""
    return F.least(F.lit(1.0), F.aggregate(found, F.lit(0.0), lambda a, x: a + F.when(x["level"] == "critical", 0.3).otherwise(0.1)))
