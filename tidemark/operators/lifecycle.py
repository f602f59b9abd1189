"""Life of an alert: how it is built, told, suppressed, throttled and escalated."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Severities in order: fixed values.
SEVERITIES = ("low", "medium", "high", "critical")
#: Channels by severity: fixed values; anything else goes to the dashboard.
CHANNELS = {"low": ("email",), "medium": ("email", "dashboard"), "high": ("email", "dashboard", "sms"), "critical": ("email", "dashboard", "sms", "webhook")}
#: Type and description by the method that weighs most: fixed values.
TYPES = {"rule_engine": "rule_based", "anomaly_detection": "anomaly", "ml_model": "ml_score"}
DESCRIPTIONS = {"rule_based": "Rule-based detection", "anomaly": "Anomaly detection", "ml_score": "ML model prediction", "ensemble": "Ensemble scoring"}
#: Escalation policies in order: id, severities, minutes of each level: fixed values.
POLICIES: tuple[dict[str, Any], ...] = (
    {"id": "critical_fraud", "severities": ("critical",), "timeouts": (5, 15, 30, 60), "enabled": True},
    {"id": "high_severity", "severities": ("high",), "timeouts": (15, 30, 60), "enabled": True},
    {"id": "medium_severity", "severities": ("medium",), "timeouts": (60, 120), "enabled": True},
)
#: Limits: how many within how many seconds; alerts in a minute that set off a storm, and the seconds it lasts: fixed values.
THROTTLES = {"account": (5, 3600), "rule": (50, 3600), "total": (100, 60)}
STORM = (200, 300)


def rank_of(severity: Column) -> Column:
    """0 to 3; null for anything else."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1
    return F.when(place >= 0, place)


def channels_of(severity: Column) -> Column:
    """An array of the channels that an alert goes to."""
    out = None
    for name, channels in CHANNELS.items():
        value = F.array(*map(F.lit, channels))
        out = F.when(severity == name, value) if out is None else out.when(severity == name, value)
    return out.otherwise(F.array(F.lit("dashboard")))


def type_of(methods: Column) -> Column:
    """From the method with the largest weighted score of those that worked (the first of equals); ``ensemble`` if none is
    over 0 or it is another one. ``methods`` is an array of ``method``, ``weighted`` and ``success``."""
    best = F.array_max(F.transform(methods, lambda x: F.when(x["success"], x["weighted"]).otherwise(0.0)))
    first = F.get(F.filter(methods, lambda x: x["success"] & (x["weighted"] == best) & (x["weighted"] > 0)), F.lit(0))["method"]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), first), F.lit("ensemble"))


def severity_of(score: Column, classification: Column) -> Column:
    """The classification if it is a severity, else by score."""
    return F.when(classification.isin(*SEVERITIES), classification).when(score >= 0.95, "critical").when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def description(kind: Column, severity: Column, score: Column, amount: Column, currency: Column, merchant: Column, channel: Column) -> Column:
    """One line of text; missing values have their defaults."""
    start = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair]), kind), F.lit("Detection"))
    text = lambda c, default: F.coalesce(c, F.lit(default))
    return F.format_string("%s triggered [%s] - Risk score: %.4f | Amount: %.2f %s | Merchant: %s | Channel: %s", start, F.upper(severity), score, F.coalesce(amount.cast("double"), F.lit(0.0)), text(currency, "USD"), text(merchant, "Unknown"), text(channel, "unknown"))


def alert_key(account: Column, rule: Column, kind: Column) -> Column:
    """32 hex digits that name an alert's account, rule and type."""
    return F.substring(F.sha2(F.concat_ws(":", account.cast("string"), F.coalesce(rule, F.lit("none")), kind), 256), 1, 32)


def channel_open(severity: Column, least: str, enabled: Column) -> Column:
    """Whether a user's channel takes alerts of a severity."""
    return enabled & (rank_of(severity) >= SEVERITIES.index(least))


def quiet(hour: Column, start: Column, end: Column) -> Column:
    """Whether an hour is within the quiet ones, which may run over midnight; never if an end is missing."""
    within = F.when(start <= end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))
    return F.when(start.isNotNull() & end.isNotNull(), within).otherwise(False)


def with_policy(alerts: DataFrame, policies: tuple[dict[str, Any], ...] = POLICIES) -> DataFrame:
    """``policy``: of the enabled policies for an alert's severity the first in order; null if there is none."""
    spark = alerts.sparkSession
    rows = [(n, p["id"], s) for n, p in enumerate(policies) if p["enabled"] for s in p["severities"]]
    table = spark.createDataFrame(rows, "place int, policy string, of string").groupBy("of").agg(F.min_by("policy", "place").alias("policy"))
    return alerts.join(F.broadcast(table), alerts["severity"] == F.col("of"), "left").drop("of")  # a row for each severity


def escalated(alerts: DataFrame, as_of: Column, policies: tuple[dict[str, Any], ...] = POLICIES) -> DataFrame:
    """``policy``, ``level`` (from 1), ``state`` and ``next_us`` of each alert's escalation at ``as_of`` (microseconds).

    A level is reached when the one before has waited its minutes without an acknowledgement (``acknowledged_us``); after
    the last one the escalation is timed out and has no next time. No policy: all null."""
    rows = with_policy(alerts, policies)
    waits = F.create_map(*[x for p in policies for x in (F.lit(p["id"]), F.array(*[F.lit(m * 60 * SECOND) for m in p["timeouts"]]))])
    waits = F.try_element_at(waits, F.col("policy"))
    ends = F.transform(waits, lambda _, i: F.col("created_us") + F.aggregate(F.slice(waits, F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    until = F.least(as_of, F.coalesce("acknowledged_us", as_of))
    passed = F.size(F.filter(ends, lambda e: e <= until))
    rows = rows.withColumns({"__ends": ends, "__passed": F.when(F.col("policy").isNotNull(), passed)})
    over, acked = F.col("__passed") >= F.size("__ends"), F.coalesce(F.col("acknowledged_us") <= as_of, F.lit(False))
    state = F.when(F.col("policy").isNull(), F.lit(None)).when(over, "timed_out").when(acked, "acknowledged").when(F.col("__passed") > 0, "escalated").otherwise("pending")
    level = F.least(F.col("__passed") + 1, F.size("__ends"))
    return rows.withColumns({"level": F.when(F.col("policy").isNotNull(), level), "state": state, "next_us": F.when(state.isin("pending", "escalated"), F.get("__ends", F.col("__passed")))}).drop("__ends", "__passed")


def auto_resolved(alerts: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Open alerts that nobody looked at for ``hours`` become resolved."""
    old = (F.col("status") == "open") & (as_of - F.col("created_us") >= hours * 3600 * SECOND)
    return alerts.withColumns({"status": F.when(old, "resolved").otherwise(F.col("status")), "auto_resolved": old})


def suppressed(alerts: DataFrame, minutes: int = 120) -> DataFrame:
    """``suppressed``: whether an alert of the account became investigated or resolved within ``minutes`` before.

    ``alerts`` has ``account_id``, ``created_us``, ``changed_us`` (of the status) and ``status``."""
    marks = alerts.filter(F.col("status").isin("investigating", "resolved") & F.col("changed_us").isNotNull()).select("account_id", F.col("changed_us").alias("at"), F.lit(None).cast("bigint").alias("alert_id"), F.lit(0).alias("is_alert"))
    events = alerts.select("account_id", F.col("created_us").alias("at"), "alert_id", F.lit(1).alias("is_alert")).union(marks)
    w = Window.partitionBy("account_id").orderBy("at", "is_alert").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("is_alert") == 0, F.col("at"))).over(w)
    hit = F.coalesce(F.col("at") - last <= minutes * 60 * SECOND, F.lit(False))
    return events.withColumn("suppressed", hit).filter("is_alert = 1").select("alert_id", "account_id", "suppressed")


def on_call(ts_us: Column, start_us: int, members: list[str], hours: int) -> Column:
    """Who is on duty: members take turns of ``hours`` from ``start_us`` on."""
    turn = F.floor((ts_us - start_us) / (hours * 3600 * SECOND)) % len(members)
    return F.element_at(F.array(*map(F.lit, members)), (turn + 1).cast("int"))


def candidates(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Scores that an alert is ``recommended`` for, and that reach ``threshold`` if one is given."""
    kept = scores.filter("recommended")
    return kept if threshold is None else kept.filter(F.col("score") >= threshold)


def with_context(alerts: DataFrame, txns: DataFrame, n: int = 10) -> DataFrame:
    """``alert_id``, ``total`` and ``average`` of its account's earlier transactions, and the ``recent`` ids, newest first.

    Alerts and transactions are put in one order by account, so that each alert reads running values, and the last ``n``
    from a frame of ``n`` rows: nothing is paired. Alerts without earlier transactions don't come back."""
    alerts = alerts.select("account_id", F.col("created_us").alias("us"), "alert_id", F.lit(None).cast("bigint").alias("transaction_id"), F.lit(None).cast("double").alias("amount"))
    events = txns.select("account_id", "us", F.lit(None).cast("bigint").alias("alert_id"), "transaction_id", F.col("amount").cast("double").alias("amount")).union(alerts)
    # an alert stands before transactions of its instant
    order = Window.partitionBy("account_id").orderBy("us", F.col("alert_id").isNull(), "transaction_id", "alert_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = events.withColumns({"total": F.count("transaction_id").over(so_far), "average": F.avg("amount").over(so_far)})
    last = Window.partitionBy("account_id").orderBy("total").rangeBetween(-n + 1, 0)
    recent = F.collect_list(F.when(F.col("transaction_id").isNotNull(), F.struct("total", "transaction_id"))).over(last)
    placed = placed.withColumn("recent", recent).filter("alert_id is not null and total > 0")
    newest = F.reverse(F.array_sort("recent"))
    return placed.select("alert_id", "total", F.round("average", 6).alias("average"), F.array_join(F.transform(newest, lambda x: x["transaction_id"].cast("string")), ",").alias("recent"))
