"""Queries of monitoring, look-ups and paging: one SQL text for Spark and the oracle where both read it, else a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import drift
from ..operators import rules, validate
from ..sources.views import view
from .derived import _MATCHES, _SHORT, query
from .reports import REPORTS

_LABELLED = "SELECT doc_id, label, score, segment, period FROM scored_label WHERE label IS NOT NULL"

SHARED: dict[str, str] = {
    "agg_02_several_fields": "SELECT account_id, COUNT(amount) AS n_amount, CAST(SUM(amount) AS DOUBLE) AS sum_amount, ROUND(AVG(lat), 6) AS mean_lat, MIN(lat) AS least_lat, MAX(lat) AS most_lat, ROUND(STDDEV_SAMP(lon), 6) AS sd_lon FROM txn GROUP BY account_id",
    "win_15_importance_rank": "SELECT feature, ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS place, importance FROM (SELECT channel AS feature, ROUND(AVG(ABS(lat)), 6) AS importance FROM txn GROUP BY channel) f",
    "srt_02_export_cap": "SELECT transaction_id FROM txn ORDER BY us DESC, transaction_id LIMIT 50000",
    "srt_08_open_by_severity": "SELECT alert_id, severity FROM alert WHERE status = 'open' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_us, alert_id",
    "srt_09_newest_quarantined": "SELECT transaction_id, us FROM txn WHERE mcc_slot IS NULL ORDER BY us DESC, transaction_id LIMIT 100",
    "srt_12_registry_order": "SELECT model, changed FROM (SELECT channel AS model, COALESCE(MAX(CASE WHEN channel = 'pos' THEN us END), MAX(CASE WHEN status = 'declined' THEN us END), MIN(us)) AS changed FROM txn GROUP BY channel) r ORDER BY changed DESC, model",
    "flt_25_optional_filters": "SELECT transaction_id FROM txn WHERE status = 'declined' AND (CAST(NULL AS VARCHAR(9)) IS NULL OR channel = CAST(NULL AS VARCHAR(9))) AND amount >= 20",
    "prj_11_tenant": "SELECT transaction_id, 'default' AS tenant_id FROM txn",
    "prj_15_alert_detail": "SELECT a.alert_id, a.severity, a.status, t.amount, t.channel, s.score, s.model_version, CASE WHEN a.resolved_us IS NOT NULL THEN (a.resolved_us - a.created_us) / 3.6e9 END AS hours_open FROM alert a JOIN txn t ON a.transaction_id = t.transaction_id JOIN latest_score s ON a.transaction_id = s.transaction_id LEFT JOIN rule_table r ON a.rule_id = r.rule_id",
    "prj_16_predicted_label": "SELECT doc_id, label, score >= 0.5 AS predicted FROM scored_label WHERE label IS NOT NULL",
    "prj_18_dataset_lookback": "SELECT day, channel, COUNT(*) AS n, SUM(amount) AS total FROM fact WHERE us >= (SELECT MAX(us) FROM fact) - 7776000000000 GROUP BY day, channel",
    "snk_16_target_lag": "SELECT transaction_type, n, CAST(now_us - newest <= 3600000000 AS BOOLEAN) AS fresh FROM (SELECT transaction_type, COUNT(*) AS n, MAX(us) AS newest FROM txn GROUP BY transaction_type) g CROSS JOIN (SELECT MAX(us) AS now_us FROM txn) ends",
    "agg_60_consumer_lag": "SELECT topic, SUM(GREATEST(high - committed, 0)) AS lag FROM (SELECT channel AS topic, account_id % 4 AS part, MAX(transaction_id) AS high, MAX(transaction_id) - MIN(transaction_id) % 50 AS committed FROM txn GROUP BY channel, account_id % 4) p GROUP BY topic",
    "agg_04_running_stats": """
        SELECT transaction_id, COUNT(*) OVER w AS n, ROUND(AVG(CAST(amount AS DOUBLE)) OVER w + 1e-9, 6) AS mean, ROUND(COALESCE(VAR_SAMP(CAST(amount AS DOUBLE)) OVER w, 0) + 1e-9, 4) AS variance
        FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)""",
    "prj_04_last_profile": "SELECT customer_id, transaction_id AS last_transaction, channel AS last_channel, amount AS last_amount FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY us DESC, transaction_id DESC) AS rn FROM txn t) r WHERE rn = 1",
    "prj_02_defaults": "SELECT transaction_id, COALESCE(mcc_slot, -1) AS mcc_slot, COALESCE(NULLIF(country, 'US'), 'domestic') AS origin FROM txn",
}
REPORTS.update(SHARED)


@query("agg_32_feature_importance", """
    SELECT k AS feature, ROUND(AVG(ABS(CAST(v AS DOUBLE))), 9) AS mean_abs, COUNT(*) AS n FROM (
      SELECT 'amount' AS k, CAST(CAST(amount AS DOUBLE) AS VARCHAR) AS v FROM txn UNION ALL SELECT 'lat', CAST(lat AS VARCHAR) FROM txn WHERE transaction_id % 3 = 0 UNION ALL SELECT 'mcc', CAST(mcc_slot AS VARCHAR) FROM txn WHERE mcc_slot IS NOT NULL) f GROUP BY k HAVING COUNT(*) >= 3""")
def agg_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size of each feature's contribution from JSON objects; values that are no plain number don't count."""
    i = F.col("transaction_id")
    body = F.to_json(F.map_filter(F.create_map(F.lit("amount"), F.col("amount").cast("double").cast("string"), F.lit("lat"), F.when(i % 3 == 0, F.col("lat").cast("string")), F.lit("mcc"), F.col("mcc_slot").cast("string"), F.lit("note"), F.lit("n/a")), lambda k, v: v.isNotNull()))
    return drift.feature_importance(view(spark, sf_dir, "txn").select(body.alias("contributions")), "contributions").select("feature", F.round("mean_abs", 9).alias("mean_abs"), "n")


_PSI = """
    WITH v AS (SELECT CASE WHEN us < 1705276800000000 THEN 'base' ELSE 'now' END AS period, 'amount' AS feature, CAST(amount AS DOUBLE) AS x FROM txn UNION ALL SELECT CASE WHEN us < 1705276800000000 THEN 'base' ELSE 'now' END, 'lat', lat + CASE WHEN us < 1705276800000000 THEN 0 ELSE 40 END FROM txn),
    e AS (SELECT feature, MIN(x) AS lo, MAX(x) AS hi FROM v WHERE period = 'base' GROUP BY feature),
    b AS (SELECT v.feature, period, LEAST(CAST(FLOOR((x - lo) / (hi - lo) * {n}) AS INTEGER), {n} - 1) AS bin FROM v JOIN e ON v.feature = e.feature WHERE x BETWEEN lo AND hi),
    c AS (SELECT e.feature, g.bin, (hi - lo) / {n} AS width, COUNT(*) FILTER (WHERE b.period = 'base') AS nb, COUNT(*) FILTER (WHERE b.period = 'now') AS nn FROM e CROSS JOIN range({n}) AS g(bin) LEFT JOIN b ON b.feature = e.feature AND b.bin = g.bin GROUP BY e.feature, g.bin, hi, lo),
    d AS (SELECT feature, nb / SUM(nb) OVER w / width + 1e-8 AS pb, nn / SUM(nn) OVER w / width + 1e-8 AS pn FROM c WINDOW w AS (PARTITION BY feature)),
    s AS (SELECT feature, pb / SUM(pb) OVER (PARTITION BY feature) AS pb, pn / SUM(pn) OVER (PARTITION BY feature) AS pn FROM d),
    psi AS (SELECT feature, SUM((pn - pb) * LN(pn / pb)) AS psi FROM s GROUP BY feature)
"""


@query("agg_42_feature_psi", _PSI.format(n=20) + "SELECT feature, ROUND(psi, 6) AS psi, psi > 0.1 AS drifted FROM psi")
def agg_42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each feature in twenty bins over the range of its baseline."""
    return drift.feature_psi(_features(spark, sf_dir)).select("feature", F.round("psi", 6).alias("psi"), (F.col("psi") > 0.1).alias("drifted"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.col("us") >= 1705276800000000
    rows = view(spark, sf_dir, "txn").select(F.when(now, "now").otherwise("base").alias("period"), F.inline(F.array(F.struct(F.lit("amount").alias("feature"), F.col("amount").cast("double").alias("x")), F.struct(F.lit("lat").alias("feature"), (F.col("lat") + F.when(now, 40).otherwise(0)).alias("x")))))
    return rows


@query("agg_56_drift_alerts", _PSI.format(n=20) + "SELECT 'feature_drift_' || feature AS metric, CASE WHEN psi > 0.5 THEN 'critical' ELSE 'warning' END AS severity, ROUND(psi, 6) AS value FROM psi WHERE psi > 0.1")
def agg_56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts for features that drifted."""
    return drift.drift_alerts(drift.feature_psi(_features(spark, sf_dir))).select("metric", "severity", F.round("value", 6).alias("value"))


@query("agg_55_degradation_alerts", f"""
    WITH l AS ({_LABELLED}), r AS (SELECT label, score, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM l),
    a AS (SELECT (SUM(rk) FILTER (WHERE label = 1) - COUNT(*) FILTER (WHERE label = 1) * (COUNT(*) FILTER (WHERE label = 1) + 1) / 2e0) / NULLIF(COUNT(*) FILTER (WHERE label = 1) * COUNT(*) FILTER (WHERE label = 0), 0) AS auc FROM r),
    p AS (SELECT quantile_cont(latency_ms, 0.95) AS p95 FROM txn_score)
    SELECT 'roc_auc' AS metric, CASE WHEN auc < 0.65 THEN 'critical' ELSE 'warning' END AS severity, ROUND(auc, 6) AS value FROM a WHERE auc < 0.75
    UNION ALL SELECT 'p95_latency_ms', 'warning', ROUND(p95, 6) FROM p WHERE p95 > 150""")
def agg_55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts for a model whose discrimination or latency got worse; the latency's limit is lowered to the data."""
    out = drift.degradation_alerts(view(spark, sf_dir, "scored_label").filter("label is not null"), view(spark, sf_dir, "txn_score").select("latency_ms"), latency_p95=150.0)
    return out.select("metric", "severity", F.round("value", 6).alias("value"))


_RULE_TOTALS = ", ".join(f"COUNT(*) FILTER (WHERE {s} AND is_fraud) AS tp_{s}" for s in _SHORT)


@query("agg_61_backtest_totals", _MATCHES + ", labelled AS (SELECT m.*, s.score >= 0.9 AS is_fraud, " + " OR ".join(_SHORT) + " AS any_rule FROM matches m JOIN latest_score s ON m.transaction_id = s.transaction_id) SELECT COUNT(*) AS n, ROUND(COUNT(*) FILTER (WHERE any_rule AND is_fraud) / CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE), 9) AS detection_rate, ROUND(COUNT(*) FILTER (WHERE any_rule AND NOT is_fraud) / CAST(COUNT(*) FILTER (WHERE NOT is_fraud) AS DOUBLE), 9) AS false_positive_rate FROM labelled")
def agg_61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of frauds that any rule finds, and of other transactions that any rule takes for one."""
    labels = view(spark, sf_dir, "latest_score").select("transaction_id", (F.col("score") >= 0.9).alias("is_fraud"))
    return rules.backtest_totals(rules.fraud_matches(view(spark, sf_dir, "risk_txn")), labels)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns = view(spark, sf_dir, "txn")
    tests = {"big": F.col("amount") > 90, "night": F.hour("ts") < 5, "abroad": F.col("country") != "US"}
    return txns.select("transaction_id", "us", "account_id", F.inline(F.array(*[F.struct(F.lit(k).alias("rule_id"), t.alias("matched")) for k, t in tests.items()])))


_HITS = "SELECT transaction_id, us, account_id, 'big' AS rule_id, amount > 90 AS matched FROM txn UNION ALL SELECT transaction_id, us, account_id, 'night', EXTRACT(HOUR FROM ts) < 5 FROM txn UNION ALL SELECT transaction_id, us, account_id, 'abroad', country <> 'US' FROM txn"


@query("br_audit", f"SELECT rule_id, COUNT(*) AS evaluated, COUNT(*) FILTER (WHERE matched) AS triggered, ROUND(COUNT(*) FILTER (WHERE matched) / CAST(COUNT(*) AS DOUBLE), 9) AS trigger_rate, COUNT(DISTINCT CASE WHEN matched THEN transaction_id END) AS transactions FROM ({_HITS}) h GROUP BY rule_id")
def br_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule was evaluated and matched."""
    return rules.rule_audit(_hits(spark, sf_dir))


@query("agg_58_last_audits", f"SELECT rule_id, place, transaction_id FROM (SELECT rule_id, transaction_id, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY us DESC, transaction_id DESC) AS place FROM ({_HITS}) h WHERE matched) r WHERE place <= 20")
def agg_58(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last matches of each rule."""
    return rules.last_audits(_hits(spark, sf_dir), "rule_id", 20).select("rule_id", "place", "transaction_id")


_W = "PARTITION BY account_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"


@query("br_velocity", f"SELECT transaction_id, COUNT(*) OVER ({_W.format(86400000000)}) > 4 AS many, COUNT(CASE WHEN amount <= 5 THEN 1 END) OVER ({_W.format(86400000000)}) > 1 AS many_small FROM risk_txn")
def br_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More transactions of an account within a day than allowed, of any or of small amounts."""
    rows = rules.velocity_rule(view(spark, sf_dir, "risk_txn"), "many", max_count=4, seconds=86_400)
    return rules.velocity_rule(rows, "many_small", max_count=1, seconds=86_400, amount_threshold=5.0).select("transaction_id", "many", "many_small")


@query("br_cumulative", f"SELECT transaction_id, SUM(amount) OVER ({_W.format(86400000000)}) > 20000 AS much FROM risk_txn")
def br_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of an account within a day over a sum."""
    return rules.cumulative_rule(view(spark, sf_dir, "risk_txn"), "much", max_amount=20_000.0).select("transaction_id", "much")


@query("br_cardinality", "SELECT transaction_id, COUNT(DISTINCT merchant_id) OVER (PARTITION BY device_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 2 AS various, FALSE AS travel FROM risk_txn")
def br_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More merchants on a device within a day than allowed; the travel rule never matches."""
    return rules.cardinality_rule(view(spark, sf_dir, "risk_txn"), "various", "device_id", "merchant_id", 2, 86_400).select("transaction_id", "various", rules.geo_velocity_rule().alias("travel"))


@query("br_crud_decision", "SELECT transaction_id, CASE WHEN amount > 80 THEN 'block' WHEN country = 'NG' THEN 'flag' ELSE 'allow' END AS decision FROM txn")
def br_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule set with rules added, changed, switched off and removed."""
    big = {"id": "BIG", "action": "block", "severity": 3, "priority": 1, "when": {"field": "amount", "operator": "gt", "value": 95}}
    now = rules.RuleSet(rules.BUSINESS_RULES).remove("BR-BLOCK").enable("BR-ROUND", False).put(big).put(big | {"when": big["when"] | {"value": 80}})
    return rules.business_decision(view(spark, sf_dir, "txn"), now.active).select("transaction_id", "decision")


@query("flt_22_time_window", """
    SELECT transaction_id, EXTRACT(ISODOW FROM ts) IN (1, 2) AS on_days, NOT (EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) BETWEEN 540 AND 1020) AS outside, NOT ((EXTRACT(HOUR FROM ts + INTERVAL 330 MINUTE) * 60 + EXTRACT(MINUTE FROM ts + INTERVAL 330 MINUTE)) BETWEEN 540 AND 1020) AS outside_there, CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS scheduled FROM txn""")
def flt_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, hours in and out of a zone, and a schedule."""
    ts = F.col("ts")
    return view(spark, sf_dir, "txn").select("transaction_id", rules.in_time_window(ts, ["Monday", "tuesday"]).alias("on_days"), rules.in_time_window(ts, None, ("09:00", "17:00")).alias("outside"), rules.in_time_window(ts, None, ("09:00", "17:00"), "Asia/Kolkata").alias("outside_there"), rules.schedule_active(ts, None, "2024-01-05", "2024-01-20").alias("scheduled"))


@query("flt_20_all_operators", """
    SELECT transaction_id, mcc_slot IS NULL AS is_null, mcc_slot IS NOT NULL AS is_not_null, channel = 'pos' AS equals, channel <> 'pos' AS not_equals, amount > 50 AS gt, amount < 50 AS lt, amount >= 50 AS ge, amount <= 50 AS le, country IN ('NG', 'JP') AS is_in, country NOT IN ('NG', 'JP') AS not_in, channel LIKE '%o%' AS has, channel LIKE 'on%' AS starts, channel LIKE '%ne' AS ends, COALESCE(mcc_slot % 3 = 1, FALSE) AS modulo, regexp_matches(country, '^[A-F]') AS regex FROM txn""")
def flt_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator of the predicate language; nulls make a test false."""
    specs = {"is_null": ("mcc_slot", "is_null", None), "is_not_null": ("mcc_slot", "is_not_null", None), "equals": ("channel", "equals", "pos"), "not_equals": ("channel", "not_equals", "pos"), "gt": ("amount", "gt", 50), "lt": ("amount", "lt", 50), "ge": ("amount", "ge", 50), "le": ("amount", "le", 50), "is_in": ("country", "in", ["NG", "JP"]), "not_in": ("country", "not_in", ["NG", "JP"]), "has": ("channel", "contains", "o"), "starts": ("channel", "starts_with", "on"), "ends": ("channel", "ends_with", "ne"), "modulo": ("mcc_slot", "modulo_equals", [3, 1]), "regex": ("country", "regex_match", "^[A-F]")}
    return view(spark, sf_dir, "txn").select("transaction_id", *[rules.condition({"field": f, "operator": o, "value": v}).alias(n) for n, (f, o, v) in specs.items()])


@query("flt_24_where_builder", "SELECT transaction_id FROM txn WHERE channel = 'pos' AND amount >= 20 AND us <= 1705276800000000")
def flt_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions from an allowed list of columns and comparisons."""
    where = rules.where_from({"channel": ("=", "pos"), "amount": (">=", 20), "us": ("<=", 1705276800000000), "country": ("=", None)}, {"channel", "amount", "us", "country"})
    return view(spark, sf_dir, "txn").filter(where).select("transaction_id")


@query("flt_28_map_regex", "SELECT event_id FROM events WHERE regexp_matches(props->>'$.k', '^[0-9]*5$')")
def flt_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose map has a value of a form under a key."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.from_json("props", "map<string,string>")["k"].rlike("^[0-9]*5$")).select("event_id")


@query("flt_32_feature_quality", """
    SELECT transaction_id, CASE WHEN mcc_slot IS NULL THEN 1 ELSE 0 END AS missing, CASE WHEN lat < -60 OR lat > 60 THEN 1 ELSE 0 END + CASE WHEN mcc_slot > 7 THEN 1 ELSE 0 END AS out_of_range, CASE WHEN transaction_id % 8 = 0 THEN 1 ELSE 0 END AS mistyped, CASE WHEN mcc_slot IS NULL THEN 0.5e0 ELSE 0e0 END <= 0.2e0 AS accepted FROM txn""")
def flt_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, mistyped and out-of-range features, and whether the set may be used."""
    rows = view(spark, sf_dir, "txn").withColumns({"lat": F.when(F.col("transaction_id") % 8 == 0, "x").otherwise(F.col("lat").cast("string")), "number": F.col("lat")})
    out = validate.feature_quality(rows.drop("lat").withColumnRenamed("number", "lat"), ["lat", "mcc_slot"], {"lat": (-60, 60), "mcc_slot": (0, 7)})
    mistyped = F.when(F.col("transaction_id") % 8 == 0, "x").otherwise("1.5").try_cast("double").isNull().cast("int")
    return out.select("transaction_id", "missing", "out_of_range", mistyped.alias("mistyped"), "accepted")


@query("prj_17_model_matrix", "SELECT transaction_id, [CAST(amount AS DOUBLE), lat, COALESCE(CAST(mcc_slot AS DOUBLE), 0), 0e0, 0e0] AS x FROM txn")
def prj_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered inputs of a model: what is missing, no number or no column is 0."""
    return validate.model_matrix(view(spark, sf_dir, "txn"), ["amount", "lat", "mcc_slot", "channel", "absent"]).select("transaction_id", "x")


@query("srt_10_top_features", """
    WITH f AS (SELECT transaction_id, unnest([{'f': 'a', 'v': (transaction_id * 3) % 7 - 3.5e0}, {'f': 'b', 'v': (transaction_id * 5) % 11 - 5e0}, {'f': 'c', 'v': (transaction_id * 7) % 5 - 1.5e0}, {'f': 'd', 'v': (transaction_id % 3) - 1e0}]) AS x FROM txn),
    r AS (SELECT transaction_id, x.f AS f, ROW_NUMBER() OVER (PARTITION BY transaction_id ORDER BY ABS(x.v) DESC, x.f) AS rn, ABS(x.v) > 1 AS far FROM f)
    SELECT transaction_id, COALESCE(string_agg(f, ',' ORDER BY rn) FILTER (WHERE far AND rn <= 2), '') AS top FROM r GROUP BY transaction_id""")
def srt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that stand out most, in order."""
    i = F.col("transaction_id")
    values = {"a": (i * 3) % 7 - 3.5, "b": (i * 5) % 11 - 5.0, "c": (i * 7) % 5 - 1.5, "d": i % 3 - 1.0}
    return view(spark, sf_dir, "txn").select("transaction_id", F.array_join(drift.top_features(values, 2, 1.0), ",").alias("top"))


@query("set_03_overlap", "SELECT customer_id, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_only_first, list_contains(a, 'pos') AS has_pos FROM (SELECT customer_id, list(DISTINCT channel) FILTER (WHERE us < 1705276800000000) AS a0, list(DISTINCT channel) FILTER (WHERE us >= 1705276800000000) AS b0, COALESCE(a0, []) AS a, COALESCE(b0, []) AS b FROM txn GROUP BY customer_id) s")
def set_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, difference and overlap of sets; each set has few values."""
    late = F.col("us") >= 1705276800000000
    sets = view(spark, sf_dir, "txn").groupBy("customer_id").agg(F.collect_set(F.when(~late, F.col("channel"))).alias("a"), F.collect_set(F.when(late, F.col("channel"))).alias("b"))
    return sets.select("customer_id", F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_except("a", "b")).alias("n_only_first"), F.array_contains("a", "pos").alias("has_pos"))


@query("fn_a02_map_share", "SELECT transaction_id, COALESCE(CASE channel WHEN 'pos' THEN 0.5e0 WHEN 'online' THEN 0.3e0 END, 0) AS share FROM txn")
def fn_a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map's value, 0 if the key is absent."""
    return view(spark, sf_dir, "txn").select("transaction_id", drift.share_of(F.create_map(F.lit("pos"), F.lit(0.5), F.lit("online"), F.lit(0.3)), F.col("channel")).alias("share"))


@query("fn_j02_notes", "SELECT event_id, to_json({'k': props->>'$.k', 'notes': '[\"first\",\"second\"]', 'state': 'seen'}) AS body FROM events")
def fn_j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry appended to a nested array, and other keys laid over the object."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", drift.with_note(F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("notes"), F.lit('["first"]')))), "notes", F.lit("second"), {"state": F.lit("seen")}).alias("body"))


@query("fn_j03_first_metric", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS auc FROM events")
def fn_j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several keys that a metrics object has."""
    name = F.when(F.col("event_id") % 3 == 0, "auc_roc").when(F.col("event_id") % 3 == 1, "roc_auc").otherwise("loss")
    body = F.concat(F.lit('{"metrics": {"'), name, F.lit('": '), F.col("event_id").cast("string"), F.lit("}}"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", drift.first_metric(body, ["auc_roc", "roc_auc"]).alias("auc"))


@query("fn_d03_holidays", "SELECT transaction_id, strftime(ts, '%m-%d') IN ('01-01', '01-20') AS holiday, EXTRACT(HOUR FROM ts) < 6 AS unusual, CAST(EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS INTEGER) AS minutes, strftime(ts, '%A') AS day_name, strftime(ts, '%B') AS month_name, CAST((EXTRACT(MONTH FROM ts) + 2) // 3 AS INTEGER) AS quarter, date_trunc('week', ts)::DATE AS week, date_trunc('month', ts)::DATE AS month, ts::DATE + 30 AS later FROM txn")
def fn_d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar attributes, truncations and shifts."""
    from ..operators.enrich import UNUSUAL_HOURS, is_holiday

    ts = F.col("ts")
    return view(spark, sf_dir, "txn").select("transaction_id", is_holiday(ts).alias("holiday"), F.hour(ts).isin(*UNUSUAL_HOURS).alias("unusual"), (F.hour(ts) * 60 + F.minute(ts)).alias("minutes"), F.date_format(ts, "EEEE").alias("day_name"), F.date_format(ts, "MMMM").alias("month_name"), F.quarter(ts).alias("quarter"), F.to_date(F.date_trunc("week", ts)).alias("week"), F.to_date(F.date_trunc("month", ts)).alias("month"), F.date_add(ts, 30).alias("later"))


@query("st_14_last_scores", "SELECT model_version, COUNT(*) AS n, ROUND(AVG(score), 9) AS mean FROM (SELECT model_version, score, ROW_NUMBER() OVER (PARTITION BY model_version ORDER BY scored_us DESC, transaction_id DESC, score) AS rn FROM txn_score) r WHERE rn <= 1000 GROUP BY model_version")
def st_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the last scores of each model, a thousand at most."""
    w = Window.partitionBy("model_version").orderBy(F.col("scored_us").desc(), F.col("transaction_id").desc(), "score")
    last = view(spark, sf_dir, "txn_score").withColumn("rn", F.row_number().over(w)).filter("rn <= 1000")
    return last.groupBy("model_version").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"))


@query("udf_03_snippet", "SELECT transaction_id, upper(channel) AS channel, amount * 2 AS doubled FROM txn")
def udf_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions given as text, with verbs that change data refused."""
    return rules.transformed(view(spark, sf_dir, "txn"), ["transaction_id", "upper(channel) AS channel", "amount * 2 AS doubled"])


@query("udf_10_feature_retrieval", """
    SELECT t.transaction_id, CASE WHEN t.customer_id % 2 = 0 THEN 7e0 WHEN t.transaction_id % 3 = 0 THEN CAST(t.amount AS DOUBLE) ELSE 50e0 END AS mean, CASE WHEN t.customer_id % 2 = 0 OR t.transaction_id % 3 = 0 THEN '' ELSE 'mean' END AS missing FROM txn t""")
def udf_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features from the store, else computed, else by default, with the names of those that were missing."""
    txns = view(spark, sf_dir, "txn")
    store = txns.select("customer_id").distinct().filter("customer_id % 2 = 0").withColumn("mean", F.lit(7.0))
    out = drift.retrieved(txns, store, "customer_id", {"mean": (F.when(F.col("transaction_id") % 3 == 0, F.col("amount").cast("double")), 50.0)})
    return out.select("transaction_id", "mean", F.array_join("missing", ",").alias("missing"))
