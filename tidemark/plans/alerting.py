"""Queries over the life of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..sources.views import view
from .derived import query

_NOW = "(SELECT MAX(created_us) AS now_us FROM alert)"


def _now(alerts: DataFrame) -> int:
    return alerts.agg(F.max("created_us").alias("now")).first()["now"] or 0


@query("stg_14_alert", """
    WITH s AS (SELECT t.transaction_id, t.amount, t.channel, t.account_id, l.score, CASE WHEN t.transaction_id % 3 = 0 THEN NULL ELSE l.score END AS r, CASE WHEN t.transaction_id % 4 = 0 THEN NULL ELSE CAST((t.transaction_id * 43) % 100 AS DOUBLE) / 100 END AS m, CASE WHEN t.transaction_id % 5 = 0 THEN 'unsure' WHEN l.score >= 0.85e0 THEN 'critical' WHEN l.score >= 0.6e0 THEN 'high' ELSE 'medium' END AS class, CASE WHEN t.transaction_id % 4 <> 0 THEN 'rule' || CAST(t.transaction_id % 13 AS VARCHAR) END AS rule_id
      FROM txn t JOIN latest_score l ON t.transaction_id = l.transaction_id WHERE l.score >= 0.5),
    k AS (SELECT s.*, CASE WHEN COALESCE(r * 0.3e0, 0) > 0 AND COALESCE(r * 0.3e0, 0) >= COALESCE(m * 0.4e0, 0) THEN 'rule_based' WHEN COALESCE(m * 0.4e0, 0) > 0 THEN 'ml_score' ELSE 'ensemble' END AS kind,
        CASE WHEN class <> 'unsure' THEN class WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.8 THEN 'high' ELSE 'medium' END AS severity FROM s)
    SELECT transaction_id, kind, severity, array_to_string(CASE severity WHEN 'critical' THEN ['email', 'dashboard', 'sms', 'webhook'] WHEN 'high' THEN ['email', 'dashboard', 'sms'] ELSE ['email', 'dashboard'] END, ',') AS channels,
      CASE kind WHEN 'rule_based' THEN 'Rule-based detection' WHEN 'ml_score' THEN 'ML model prediction' ELSE 'Ensemble scoring' END || ' triggered [' || upper(severity) || '] - Risk score: ' || printf('%.4f', score) || ' | Amount: ' || printf('%.2f', CAST(amount AS DOUBLE)) || ' USD | Merchant: Unknown | Channel: ' || channel AS description,
      left(sha256(CAST(account_id AS VARCHAR) || ':' || COALESCE(rule_id, 'none') || ':' || kind), 32) AS key FROM k""")
def stg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts built from scores: type, severity, channels, description, key."""
    i = F.col("transaction_id")
    scored = view(spark, sf_dir, "txn").join(view(spark, sf_dir, "latest_score").select("transaction_id", "score"), "transaction_id").filter("score >= 0.5")
    one = lambda name, c, w: F.struct(F.lit(name).alias("method"), F.coalesce(c * w, F.lit(0.0)).alias("weighted"), c.isNotNull().alias("success"))
    methods = F.array(one("rule_engine", F.when(i % 3 != 0, F.col("score")), 0.3), one("ml_model", F.when(i % 4 != 0, (i * 43) % 100 / 100), 0.4))
    klass = F.when(i % 5 == 0, "unsure").when(F.col("score") >= 0.85, "critical").when(F.col("score") >= 0.6, "high").otherwise("medium")
    rows = scored.select("transaction_id", "amount", "channel", "score", "account_id", lifecycle.type_of(methods).alias("kind"), lifecycle.severity_of(F.col("score"), klass).alias("severity"), F.when(i % 4 != 0, F.concat(F.lit("rule"), (i % 13).cast("string"))).alias("rule_id"))
    text = lifecycle.description(F.col("kind"), F.col("severity"), F.col("score"), F.col("amount"), F.lit(None), F.lit(None), F.col("channel"))
    return rows.select("transaction_id", "kind", "severity", F.array_join(lifecycle.channels_of(F.col("severity")), ",").alias("channels"), text.alias("description"), lifecycle.alert_key(F.col("account_id"), F.col("rule_id"), F.col("kind")).alias("key"))


@query("prj_09_alert_details", """
    SELECT alert_id, to_json({'scoring': {'final_score': score, 'risk_classification': severity}, 'transaction': {'account': account_id, 'customer': customer_id}}) AS details FROM alert""")
def prj_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested details of an alert as JSON."""
    scoring = F.struct(F.col("score").alias("final_score"), F.col("severity").alias("risk_classification"))
    of = F.struct(F.col("account_id").alias("account"), F.col("customer_id").alias("customer"))
    return view(spark, sf_dir, "alert").select("alert_id", F.to_json(F.struct(scoring.alias("scoring"), of.alias("transaction"))).alias("details"))


@query("stg_15_context", """
    WITH t AS (SELECT a.alert_id, t.transaction_id, ROW_NUMBER() OVER (PARTITION BY a.alert_id ORDER BY t.us DESC, t.transaction_id DESC) AS rn, COUNT(*) OVER (PARTITION BY a.alert_id) AS n, AVG(CAST(t.amount AS DOUBLE)) OVER (PARTITION BY a.alert_id) AS mean FROM alert a JOIN txn t ON t.account_id = a.account_id AND t.us < a.created_us AND a.alert_id % 50 = 0)
    SELECT alert_id, MAX(n) AS total, ROUND(MAX(mean), 6) AS average, string_agg(CAST(transaction_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 10) AS recent FROM t GROUP BY alert_id""")
def stg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and the ten last transactions of an alert's account before it."""
    return lifecycle.with_context(view(spark, sf_dir, "alert").filter("alert_id % 50 = 0"), view(spark, sf_dir, "txn"))


@query("flt_29_notification_gate", """
    SELECT alert_id, alert_id % 5 <> 0 AND severity IN ('high', 'critical') AS email, severity = 'critical' AS sms, (us // 3600000000) % 24 >= 22 OR (us // 3600000000) % 24 < 6 AS quiet_night, alert_id % 7 <> 0 AND (us // 3600000000) % 24 BETWEEN 9 AND 16 AS quiet_day FROM (SELECT *, created_us AS us FROM alert) a""")
def flt_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels open to a severity, and quiet hours over midnight and by day."""
    i, severity, hour = F.col("alert_id"), F.col("severity"), F.expr("created_us div 3600000000 % 24")
    end = F.when(i % 7 != 0, F.lit(17))
    return view(spark, sf_dir, "alert").select("alert_id", lifecycle.channel_open(severity, "high", i % 5 != 0).alias("email"), lifecycle.channel_open(severity, "critical", F.lit(True)).alias("sms"), lifecycle.quiet(hour, F.lit(22), F.lit(6)).alias("quiet_night"), lifecycle.quiet(hour, F.lit(9), end).alias("quiet_day"))


@query("flt_33_candidates", "SELECT transaction_id FROM latest_score WHERE score >= 0.6 AND transaction_id % 9 <> 0")
def flt_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that alerts are made of: recommended ones, over the threshold."""
    rows = view(spark, sf_dir, "latest_score").withColumn("recommended", F.col("transaction_id") % 9 != 0)
    return lifecycle.candidates(rows, 0.6).select("transaction_id")


_LEVELS = "CASE severity WHEN 'critical' THEN [5, 15, 30, 60] WHEN 'high' THEN [15, 30, 60] WHEN 'medium' THEN [60, 120] END"


@query("st_08_escalation", f"""
    WITH a AS (SELECT alert_id, severity, created_us, CASE WHEN alert_id % 3 = 0 THEN created_us + (alert_id % 100) * 60000000 END AS ack, CASE WHEN now_us - created_us > 86400000000 THEN created_us + (alert_id % 240) * 60000000 ELSE now_us END AS as_of, {_LEVELS} AS waits FROM alert CROSS JOIN {_NOW} n),
    b AS (SELECT a.*, list_transform(range(1, len(waits) + 1), lambda k: created_us + list_sum(waits[1:k]) * 60000000) AS ends FROM a),
    c AS (SELECT b.*, len(list_filter(ends, lambda e: e <= LEAST(as_of, COALESCE(ack, as_of)))) AS passed FROM b)
    SELECT alert_id, CASE severity WHEN 'critical' THEN 'critical_fraud' WHEN 'high' THEN 'high_severity' WHEN 'medium' THEN 'medium_severity' END AS policy, LEAST(passed + 1, len(waits)) AS level,
      CASE WHEN waits IS NULL THEN NULL WHEN passed >= len(waits) THEN 'timed_out' WHEN ack <= as_of THEN 'acknowledged' WHEN passed > 0 THEN 'escalated' ELSE 'pending' END AS state, CAST(CASE WHEN passed < len(waits) AND (ack IS NULL OR ack > as_of) THEN ends[passed + 1] END AS BIGINT) AS next_us FROM c""")
def st_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that unacknowledged alerts have risen to."""
    alerts = view(spark, sf_dir, "alert")
    i, minute = F.col("alert_id"), 60_000_000
    now = F.lit(_now(alerts))
    rows = alerts.withColumn("acknowledged_us", F.when(i % 3 == 0, F.col("created_us") + i % 100 * minute))
    as_of = F.when(now - F.col("created_us") > 86_400_000_000, F.col("created_us") + i % 240 * minute).otherwise(now)
    return lifecycle.escalated(rows, as_of).select("alert_id", "policy", "level", "state", "next_us")


@query("jn_20_first_policy", "SELECT alert_id, CASE severity WHEN 'critical' THEN 'b' WHEN 'high' THEN 'b' WHEN 'medium' THEN 'c' END AS policy FROM alert")
def jn_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first enabled policy for a severity, in order."""
    policies = ({"id": "a", "severities": ("critical",), "timeouts": (5,), "enabled": False}, {"id": "b", "severities": ("critical", "high"), "timeouts": (5,), "enabled": True}, {"id": "c", "severities": ("high", "medium"), "timeouts": (9,), "enabled": True})
    return lifecycle.with_policy(view(spark, sf_dir, "alert"), policies).select("alert_id", "policy")


@query("st_17_auto_resolve", f"SELECT alert_id, status = 'open' AND now_us - created_us >= 604800000000 AS auto_resolved, CASE WHEN status = 'open' AND now_us - created_us >= 604800000000 THEN 'resolved' ELSE status END AS status FROM alert CROSS JOIN {_NOW} n")
def st_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open alerts older than a week resolve themselves."""
    alerts = view(spark, sf_dir, "alert")
    return lifecycle.auto_resolved(alerts, F.lit(_now(alerts))).select("alert_id", "auto_resolved", "status")


@query("st_06_suppression", """
    SELECT a.alert_id, a.account_id, EXISTS (SELECT 1 FROM alert b WHERE b.account_id = a.account_id AND b.status IN ('investigating', 'resolved') AND b.created_us + 1800000000 <= a.created_us AND a.created_us - (b.created_us + 1800000000) <= 432000000000) AS suppressed FROM alert a""")
def st_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of accounts whose alerts are being looked at, or just were; the pause is widened for sparse data."""
    rows = view(spark, sf_dir, "alert").withColumn("changed_us", F.col("created_us") + 1_800_000_000)
    return lifecycle.suppressed(rows, minutes=7200)


@query("fn_d07_on_call", "SELECT alert_id, CASE (created_us - 1704067200000000) // 43200000000 % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' ELSE 'cem' END AS who FROM alert")
def fn_d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is on duty when an alert comes."""
    return view(spark, sf_dir, "alert").select("alert_id", lifecycle.on_call(F.col("created_us"), 1_704_067_200_000_000, ["ann", "bob", "cem"], 12).alias("who"))


@query("agg_52_status_counts", """
    SELECT 'severity' AS kind, severity AS value, COUNT(*) AS n FROM alert GROUP BY severity UNION ALL SELECT 'status', status, COUNT(*) FROM alert GROUP BY status UNION ALL SELECT 'total', 'all', COUNT(*) FROM alert""")
def agg_52(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by severity and by status, and in all, in one pass."""
    rows = view(spark, sf_dir, "alert").select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("severity", F.col("severity")), ("status", F.col("status")), ("total", F.lit("all")))])))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
