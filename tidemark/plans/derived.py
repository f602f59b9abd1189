"""Queries built from the DataFrame operators, with the oracle's SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk, text
from ..operators import alerts, frames, merge, rules, standing, validate
from ..sources import files
from ..sources.views import view

#: Name -> (Spark function, oracle text over the views or None).
DERIVED: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def put(f):
        DERIVED[name] = (f, oracle)
        return f

    return put


_H = "PARTITION BY customer_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"


@query("win_03_velocity", f"""
    SELECT transaction_id, COUNT(*) OVER ({_H.format(60000000)}) AS n_1m, COUNT(*) OVER ({_H.format(300000000)}) AS n_5m, COUNT(*) OVER ({_H.format(3600000000)}) AS n_1h, COUNT(*) OVER ({_H.format(86400000000)}) AS n_24h,
           CAST(SUM(amount) OVER ({_H.format(3600000000)}) AS DOUBLE) AS sum_1h, CAST(SUM(amount) OVER ({_H.format(86400000000)}) AS DOUBLE) AS sum_24h,
           COUNT(DISTINCT merchant_id) OVER ({_H.format(86400000000)}) AS merchants_24h, COUNT(DISTINCT country) OVER ({_H.format(86400000000)}) AS countries_24h FROM txn""")
def win_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity of each transaction's customer."""
    return frames.velocity(view(spark, sf_dir, "txn")).select("transaction_id", "n_1m", "n_5m", "n_1h", "n_24h", "sum_1h", "sum_24h", "merchants_24h", "countries_24h")


@query("win_04_half_open", """
    SELECT transaction_id, COUNT(*) OVER w AS n, COALESCE(CAST(SUM(amount) OVER w AS DOUBLE), 0) AS total, COUNT(DISTINCT channel) OVER w AS channels
    FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)""")
def win_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour before each transaction of an account."""
    w = frames.before("account_id", "us", 3600)
    rows = frames.distinct_counts(view(spark, sf_dir, "txn"), "account_id", "us", {"channels": ("channel", 3600)}, inclusive=False)
    return rows.select("transaction_id", F.count("*").over(w).alias("n"), F.coalesce(F.sum("amount").over(w).cast("double"), F.lit(0.0)).alias("total"), "channels")


def _stats(name: str, span: int) -> str:
    ok = f"us >= now_us - {span * 1000000} AND us < now_us"
    return f"""COUNT(*) FILTER (WHERE {ok}) AS n_{name}, COALESCE(CAST(SUM(amount) FILTER (WHERE {ok}) AS DOUBLE), 0) AS sum_{name}, COALESCE(CAST(SUM(amount) FILTER (WHERE {ok}) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE {ok}), 0), 0) AS mean_{name},
        ROUND(COALESCE(STDDEV_SAMP(CAST(amount AS DOUBLE)) FILTER (WHERE {ok}), 0), 6) AS sd_{name}, COALESCE(MIN(CAST(amount AS DOUBLE)) FILTER (WHERE {ok}), 0) AS least_{name}, COALESCE(MAX(CAST(amount AS DOUBLE)) FILTER (WHERE {ok}), 0) AS largest_{name}, COUNT(DISTINCT country) FILTER (WHERE {ok} AND country <> '') AS countries_{name}"""


@query("agg_01_windowed_stats", f"SELECT account_id, {_stats('1d', 86400)}, {_stats('7d', 604800)} FROM txn CROSS JOIN (SELECT MAX(us) AS now_us FROM txn) ends GROUP BY account_id")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-back statistics of each account up to the last event."""
    txns = view(spark, sf_dir, "txn")
    now = txns.agg(F.max("us").alias("now")).first()["now"] or 0
    return frames.windowed_stats(txns, "account_id", F.lit(now), {"1d": 86400, "7d": 604800})


@query("win_07_amount_percentile", """
    WITH numbered AS (SELECT transaction_id, customer_id, amount, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY us, transaction_id) AS rn FROM txn)
    SELECT a.transaction_id, ROUND(COALESCE(AVG(CASE WHEN b.amount <= a.amount THEN 1e0 WHEN b.amount > a.amount THEN 0e0 END), 0.5e0), 9) AS pct
    FROM numbered a LEFT JOIN numbered b ON a.customer_id = b.customer_id AND b.rn < a.rn GROUP BY a.transaction_id""")
def win_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a customer's earlier amounts that are no larger."""
    rows = standing.share_not_above(view(spark, sf_dir, "txn"), "customer_id", "amount", "us", "transaction_id")
    return rows.select("transaction_id", F.round(F.coalesce("share", F.lit(0.5)), 9).alias("pct"))


@query("win_13_device_history", """
    SELECT transaction_id, MIN(us) OVER w AS first_us, COUNT(*) OVER w AS seen, ROUND(LEAST(1e0, 0.5e0 + 0.01e0 * (CAST(COUNT(*) OVER w * (COUNT(*) OVER w + 1) AS DOUBLE) / 2 - 1)), 9) AS trust
    FROM txn WINDOW w AS (PARTITION BY device_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)""")
def win_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's first use, uses so far, and trust that grows with them."""
    w = frames.Window.partitionBy("device_id").orderBy("us", "transaction_id").rowsBetween(frames.Window.unboundedPreceding, 0)
    rows = view(spark, sf_dir, "txn").select("transaction_id", F.min("us").over(w).alias("first_us"), F.count("*").over(w).alias("seen"))
    return rows.withColumn("trust", F.round(F.least(F.lit(1.0), 0.5 + 0.01 * (F.col("seen") * (F.col("seen") + 1) / 2 - 1)), 9))


_MILES = "7917.6e0 * ATAN2(SQRT(a), SQRT(1 - a))"


@query("jn_16_travel_speed", f"""
    WITH legs AS (SELECT transaction_id, lat, lon, (us - LAG(us) OVER w) / 3.6e9 AS hours, LAG(lat) OVER w AS lat0, LAG(lon) OVER w AS lon0 FROM txn WINDOW w AS (PARTITION BY customer_id ORDER BY us, transaction_id)),
    arcs AS (SELECT transaction_id, hours, POWER(SIN(RADIANS(lat - lat0) / 2), 2) + COS(RADIANS(lat0)) * COS(RADIANS(lat)) * POWER(SIN(RADIANS(lon - lon0) / 2), 2) AS a FROM legs)
    SELECT transaction_id, ROUND({_MILES}, 4) AS miles, CASE WHEN hours >= 0.001 THEN ROUND({_MILES} / hours, 3) END AS mph FROM arcs""")
def jn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and speed since the customer's previous transaction."""
    w = frames.Window.partitionBy("customer_id").orderBy("us", "transaction_id")
    rows = view(spark, sf_dir, "txn").select("transaction_id", ((F.col("us") - F.lag("us").over(w)) / 3.6e9).alias("hours"), risk.miles(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("d"))
    return rows.select("transaction_id", F.round("d", 4).alias("miles"), F.when(F.col("hours") >= 0.001, F.round(F.col("d") / F.col("hours"), 3)).alias("mph"))


_LEVELS = {"n_1m": (3, 5), "n_5m": (8, 15), "n_1h": (20, 50), "n_24h": (100, 200), "sum_1m": (1000, 5000), "sum_5m": (3000, 10000), "sum_1h": (10000, 50000), "sum_24h": (50000, 100000), "merchants_1h": (5, 10), "merchants_24h": (15, 30)}
_R = "PARTITION BY customer_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
_SPANS = {"1m": 60000000, "5m": 300000000, "1h": 3600000000, "24h": 86400000000}


@query("fn_m05_breaches", "WITH v AS (SELECT transaction_id, " + ", ".join(f"COUNT(*) OVER ({_R.format(us)}) AS n_{n}, SUM(amount) OVER ({_R.format(us)}) AS sum_{n}" for n, us in _SPANS.items()) + f", COUNT(DISTINCT merchant_id) OVER ({_R.format(3600000000)}) AS merchants_1h, COUNT(DISTINCT merchant_id) OVER ({_R.format(86400000000)}) AS merchants_24h FROM risk_txn), b AS (SELECT transaction_id, " + " + ".join(f"CASE WHEN {m} >= {c} THEN 1 ELSE 0 END" for m, (w, c) in _LEVELS.items()) + " AS n_critical, " + " + ".join(f"CASE WHEN {m} >= {w} AND {m} < {c} THEN 1 ELSE 0 END" for m, (w, c) in _LEVELS.items()) + " AS n_warning FROM v) SELECT transaction_id, n_critical, n_warning, ROUND(LEAST(1e0, 0.3e0 * n_critical + 0.1e0 * n_warning), 6) AS risk FROM b")
def fn_m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity thresholds reached by each transaction, and the risk that they give."""
    rows = frames.velocity(view(spark, sf_dir, "risk_txn")).select("transaction_id", risk.breaches().alias("b"))
    of = lambda level: F.size(F.filter("b", lambda x: x["level"] == level))
    return rows.select("transaction_id", of("critical").alias("n_critical"), of("warning").alias("n_warning"), F.round(risk.breach_risk(F.col("b")), 6).alias("risk"))


def _grade(x: str, cuts: tuple[float, float, float]) -> str:
    return f"CASE WHEN {x} >= {cuts[2]} THEN 'critical' WHEN {x} >= {cuts[1]} THEN 'high' WHEN {x} >= {cuts[0]} THEN 'medium' ELSE 'low' END"


@query("fn_m08_ensemble", f"""
    WITH s AS (SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 THEN NULL ELSE score END AS r, CAST((transaction_id * 41) % 100 AS DOUBLE) / 100 AS a, CASE WHEN transaction_id % 4 = 0 THEN NULL ELSE CAST((transaction_id * 43) % 100 AS DOUBLE) / 100 END AS m FROM latest_score),
    e AS (SELECT transaction_id, (COALESCE(r * 0.3e0, 0) + COALESCE(a * 0.3e0, 0) + COALESCE(m * 0.4e0, 0)) / (CASE WHEN r IS NULL THEN 0e0 ELSE 0.3e0 END + 0.3e0 + CASE WHEN m IS NULL THEN 0e0 ELSE 0.4e0 END) AS x FROM s)
    SELECT transaction_id, ROUND(x, 6) AS final, {_grade('ROUND(x, 6)', risk.ENSEMBLES['online'][1])} AS class FROM e""")
def fn_m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores combined over the methods that gave one."""
    i = F.col("transaction_id")
    weights, cuts = risk.ENSEMBLES["online"]
    rules_, model = F.when(i % 3 != 0, F.col("score")), F.when(i % 4 != 0, (i * 43) % 100 / 100)
    final = F.round(risk.ensemble(rules_, (i * 41) % 100 / 100, model, weights), 6)
    return view(spark, sf_dir, "latest_score").select("transaction_id", final.alias("final")).withColumn("class", risk.graded(F.col("final"), cuts))


_BLOCK = "(status = 'declined' AND amount > 95)"
_ROUND = "(merchant_id % 10 = 0 OR mcc_slot IS NULL)"


@query("br_eval_decision", f"""
    SELECT transaction_id, CASE WHEN {_BLOCK} THEN 'BR-BLOCK' ELSE concat_ws(',', CASE WHEN country = 'NG' THEN 'BR-COUNTRY' END, CASE WHEN {_ROUND} THEN 'BR-ROUND' END, CASE WHEN channel NOT IN ('online', 'mobile') THEN 'BR-CHANNEL' END) END AS triggered,
           CASE WHEN {_BLOCK} THEN 'block' WHEN country = 'NG' OR {_ROUND} THEN 'flag' ELSE 'allow' END AS decision,
           CASE WHEN {_BLOCK} THEN 3 WHEN country = 'NG' THEN 2 WHEN {_ROUND} THEN 1 WHEN channel NOT IN ('online', 'mobile') THEN 0 ELSE -1 END AS severity FROM txn""")
def br_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business rules with an early stop."""
    return rules.business_decision(view(spark, sf_dir, "txn"))


_NEAR = "PARTITION BY customer_id ORDER BY us RANGE BETWEEN {0} PRECEDING AND {0} FOLLOWING"
_MATCHES = f"""
    WITH first_uses AS (SELECT device_id, account_id, MIN(us) AS since FROM risk_txn GROUP BY device_id, account_id),
    f AS (SELECT t.*, COUNT(*) OVER p AS n_prior, CAST(SUM(amount) OVER p AS DOUBLE) AS sum_prior, COUNT(CASE WHEN country <> 'US' THEN 1 END) OVER p AS abroad_prior,
                 COUNT(*) OVER ({_NEAR.format(600000000)}) - 1 AS rapid, COUNT(CASE WHEN status = 'declined' THEN 1 END) OVER ({_NEAR.format(1800000000)}) AS declines,
                 list_sort(list(CAST(amount AS DOUBLE)) OVER ({_NEAR.format(3600000000)})) AS amounts, COUNT(CASE WHEN amount <= 5 THEN 1 END) OVER ({_NEAR.format(1800000000)}) AS small, COUNT(*) OVER ({_NEAR.format(1800000000)}) - 1 AS in_burst,
                 MAX(us) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1800000001 PRECEDING) AS before_burst,
                 LAG(us) OVER o AS last_us, LAG(lat) OVER o AS lat0, LAG(lon) OVER o AS lon0, COUNT(CASE WHEN channel = 'online' THEN 1 END) OVER p AS c_online, COUNT(CASE WHEN channel = 'mobile' THEN 1 END) OVER p AS c_mobile, COUNT(CASE WHEN channel = 'pos' THEN 1 END) OVER p AS c_pos, COUNT(CASE WHEN channel = 'atm' THEN 1 END) OVER p AS c_atm,
                 COUNT(*) OVER (PARTITION BY customer_id, mcc ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_mcc,
                 MIN(us) OVER d AS device_since, COUNT(DISTINCT account_id) OVER d AS device_accounts
               FROM risk_txn t WINDOW p AS (PARTITION BY customer_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY customer_id ORDER BY us, transaction_id), d AS (PARTITION BY device_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT f.*, amounts[-3:] AS top, (us - last_us) / 3.6e9 AS hours, POWER(SIN(RADIANS(lat - lat0) / 2), 2) + COS(RADIANS(lat0)) * COS(RADIANS(lat)) * POWER(SIN(RADIANS(lon - lon0) / 2), 2) AS a FROM f),
    matches AS (SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, CAST(amount AS DOUBLE) > 3e0 * CASE WHEN n_prior < 5 THEN 500e0 ELSE sum_prior / n_prior END AS amt1, amount >= 9000 AND amount < 10000 AS amt2, amount >= 5000 AND amount % 1000 = 0 AS amt3,
                  rapid >= 5 AS vel1, status = 'approved' AND declines >= 3 AS vel2, len(amounts) >= 3 AND top[1] > 0 AND top[2] >= 2 * top[1] AND top[3] >= 2 * top[2] AS vel3,
                  COALESCE(lat <> 0 AND lon <> 0 AND lat0 <> 0 AND lon0 <> 0 AND {_MILES} >= 100 AND hours > 0 AND {_MILES} > 500 * hours, FALSE) AS geo1, country <> 'US' AND abroad_prior = 0 AND n_prior >= 10 AS geo2, country IN ('NG', 'RU', 'UA', 'VN', 'PH', 'ID', 'BR', 'KP', 'IR', 'SY') AS geo3,
                  us - device_since <= 86400000000 AND amount >= 1000 AS pat1, n_prior >= 10 AND same_mcc <= 0.05e0 * n_prior AS pat2, amount >= 500 AND small >= 3 AS pat3, device_accounts > 2 AS pat4,
                  n_prior >= 10 AND CASE channel WHEN 'online' THEN c_online WHEN 'mobile' THEN c_mobile WHEN 'pos' THEN c_pos ELSE c_atm END = 0 AS pat5, us // 3600000000 % 24 < 5 AND amount >= 2000 AS tmp1, COALESCE(us - last_us >= 7776000000000, FALSE) AS tmp2,
                  in_burst >= 4 AND COALESCE(CASE WHEN before_burst IS NOT NULL THEN us - before_burst - 1800000000 ELSE us - last_us END >= 172800000000, FALSE) AS tmp3 FROM g)
"""
#: Short name -> rule, tier, confidence, category; tiers 0 to 3 are low to critical.
_CONFIG = {
    "amt1": ("AMT-001", 2, 0.75, "amount"), "amt2": ("AMT-002", 3, 0.85, "amount"), "amt3": ("AMT-003", 1, 0.55, "amount"), "vel1": ("VEL-001", 2, 0.80, "velocity"), "vel2": ("VEL-002", 2, 0.85, "velocity"), "vel3": ("VEL-003", 1, 0.60, "velocity"),
    "geo1": ("GEO-001", 3, 0.90, "geo"), "geo2": ("GEO-002", 2, 0.70, "geo"), "geo3": ("GEO-003", 2, 0.65, "geo"), "pat1": ("PAT-001", 2, 0.75, "pattern"), "pat2": ("PAT-002", 1, 0.55, "pattern"), "pat3": ("PAT-003", 3, 0.90, "pattern"), "pat4": ("PAT-004", 2, 0.80, "pattern"), "pat5": ("PAT-005", 0, 0.45, "pattern"),
    "tmp1": ("TMP-001", 1, 0.60, "temporal"), "tmp2": ("TMP-002", 2, 0.70, "temporal"), "tmp3": ("TMP-003", 1, 0.65, "temporal"),
}
_SHORT = {s: v[0] for s, v in _CONFIG.items()}


@query("fr_rules", _MATCHES + "SELECT transaction_id, " + ", ".join(_SHORT) + " FROM matches")
def fr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud rules matched by each transaction."""
    return rules.fraud_matches(view(spark, sf_dir, "risk_txn")).select("transaction_id", *[F.col(f"`{long}`").alias(short) for short, long in _SHORT.items()])


_KINDS = {c: " OR ".join(s for s, v in _CONFIG.items() if v[3] == c) for c in sorted({v[3] for v in _CONFIG.values()})}


@query("fr_agg_score", _MATCHES + ", one AS (SELECT transaction_id, " + " + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in _CONFIG) + " AS n_rules, GREATEST(" + ", ".join(f"CASE WHEN {s} THEN {v[1]} ELSE -1 END" for s, v in _CONFIG.items()) + ") AS tier, ROUND(1 - " + " * ".join(f"CASE WHEN {s} THEN 1 - {v[2]}e0 ELSE 1e0 END" for s, v in _CONFIG.items()) + ", 4) AS confidence, " + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in _KINDS.values()) + """ AS kinds FROM matches),
    two AS (SELECT transaction_id, n_rules, CASE WHEN n_rules > 0 THEN LEAST(3, tier + (n_rules - 1) // 2) ELSE -1 END AS severity, confidence, kinds FROM one)
    SELECT transaction_id, n_rules, severity, confidence, CASE WHEN n_rules > 0 THEN ROUND(0.5e0 * confidence + 0.3e0 * severity / 3 + 0.2e0 * LEAST(kinds / 5e0, 1e0), 6) ELSE 0 END AS score FROM two""")
def fr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, confidence and score from the matched rules."""
    return rules.fraud_score(rules.fraud_matches(view(spark, sf_dir, "risk_txn")))


#: Settings as a configuration file gives them: three rules with other parameters, all others off, a tier for every match.
_SETTINGS = {
    "severity_escalation": {"enabled": True, "rules_per_tier": 1, "max_severity": "high"},
    "rules": [
        {"id": "FRAUD-AMT-002", "severity": "low", "confidence": 0.5, "parameters": {"lower_bound": 2000.0, "threshold": 8000.0}},
        {"id": "FRAUD-AMT-003", "severity": "medium", "parameters": {"min_amount": 100.0, "modulo": 5}},
        {"id": "FRAUD-GEO-003", "severity": "low", "parameters": {"high_risk_countries": ["NG", "BR"]}},
        *[{"id": f"FRAUD-{rule}", "enabled": False} for rule in rules.FRAUD_RULES if rule not in ("AMT-002", "AMT-003", "GEO-003")],
    ],
}


@query("fr_configured", """
    WITH m AS (SELECT transaction_id, amount >= 2000 AND amount < 8000 AS a2, amount >= 100 AND amount % 5 = 0 AS a3, COALESCE(country IN ('NG', 'BR'), FALSE) AS g3 FROM risk_txn),
    one AS (SELECT *, CAST(a2 AS INT) + CAST(a3 AS INT) + CAST(g3 AS INT) AS n_rules, CASE WHEN a3 THEN 1 WHEN a2 OR g3 THEN 0 ELSE -1 END AS tier, CASE WHEN a2 OR a3 THEN 1 ELSE 0 END + CAST(g3 AS INT) AS kinds,
                   ROUND(1 - CASE WHEN a2 THEN 0.5e0 ELSE 1e0 END * CASE WHEN a3 THEN 0.45e0 ELSE 1e0 END * CASE WHEN g3 THEN 0.35e0 ELSE 1e0 END, 4) AS confidence FROM m),
    two AS (SELECT *, CASE WHEN n_rules > 0 THEN LEAST(2, tier + n_rules - 1) ELSE -1 END AS severity FROM one)
    SELECT transaction_id, n_rules, severity, confidence, CASE WHEN n_rules > 0 THEN ROUND(0.5e0 * confidence + 0.3e0 * severity / 3 + 0.2e0 * kinds / 5, 6) ELSE 0 END AS score FROM two""")
def fr_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score under a configuration that switches rules off and changes parameters, severities and escalation."""
    config = rules.fraud_config(_SETTINGS)
    return rules.fraud_score(rules.fraud_matches(view(spark, sf_dir, "risk_txn"), config), config)


def _rule_counts(short: str, long: str) -> str:
    return f"SELECT '{long}' AS rule_id, COUNT(*) FILTER (WHERE {short} AND is_fraud) AS tp, COUNT(*) FILTER (WHERE {short} AND NOT is_fraud) AS fp, COUNT(*) FILTER (WHERE NOT {short} AND is_fraud) AS fn, COUNT(*) FILTER (WHERE NOT {short} AND NOT is_fraud) AS tn FROM labelled"


@query("fr_backtest", _MATCHES + ", labelled AS (SELECT m.*, s.score >= 0.9 AS is_fraud FROM matches m JOIN latest_score s ON m.transaction_id = s.transaction_id), counts AS (" + " UNION ALL ".join(_rule_counts(s, r) for s, r in _SHORT.items()) + ") SELECT rule_id, tp, fp, fn, tn, ROUND(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 9) AS prec, ROUND(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 9) AS rec, ROUND(2e0 * tp / NULLIF(2 * tp + fp + fn, 0), 9) AS f1 FROM counts")
def fr_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule against labels."""
    labels = view(spark, sf_dir, "latest_score").select("transaction_id", (F.col("score") >= 0.9).alias("is_fraud"))
    return rules.backtest(rules.fraud_matches(view(spark, sf_dir, "risk_txn")), labels)


@query("fn_s_cleaning", r"""
    SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS bare, trim(regexp_replace(url, '\s+', ' ', 'g')) AS url, sha256(concat_ws('|', lower(trim(url)), CAST(page_id AS VARCHAR))) AS key, left(sha256(url), 16) AS short FROM pages""")
def fn_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, white space and keys of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.length(text.no_tags(F.col("html"))).cast("bigint").alias("bare"), text.squeezed(F.col("url")).alias("url"), text.key_of(F.col("url"), F.col("page_id")).alias("key"), text.short_hash(F.col("url")).alias("short"))


@query("fn_d_calendar", """
    SELECT transaction_id, CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS hour, CAST(EXTRACT(ISODOW FROM ts) - 1 AS INTEGER) AS weekday, EXTRACT(ISODOW FROM ts) >= 6 AS weekend, CAST(EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS INTEGER) AS minutes, CAST(EXTRACT(QUARTER FROM ts) AS INTEGER) AS quarter, CAST(EXTRACT(WEEK FROM ts) AS INTEGER) AS week FROM txn""")
def fn_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar parts of each transaction."""
    return view(spark, sf_dir, "txn").select("transaction_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), (F.weekday("ts") >= 5).alias("weekend"), (F.hour("ts") * 60 + F.minute("ts")).alias("minutes"), F.quarter("ts").alias("quarter"), F.weekofyear("ts").alias("week"))


@query("fn_h01_sticky_split", "SELECT customer_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256('test:' || CAST(customer_id AS VARCHAR)), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 10000) AS BIGINT) AS place FROM (SELECT DISTINCT customer_id FROM txn) c")
def fn_h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sticky A/B places of customers."""
    return view(spark, sf_dir, "txn").select("customer_id").distinct().select("customer_id", text.bucket_of(F.lit("test"), F.col("customer_id").cast("string")).alias("place"))


@query("snk_05_upsert", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT c_custkey + 100000000, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 10 = 0""")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged with changed and new ones."""
    target = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    changed = target.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = target.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 100_000_000).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return merge.upsert(target, changed.union(new), ["c_custkey"])


@query("snk_06_insert_new", "SELECT alert_id, status FROM alert UNION ALL SELECT DISTINCT alert_id + 100000000, 'new' FROM alert WHERE alert_id % 2 = 0")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts added unless their key exists."""
    have = view(spark, sf_dir, "alert").select("alert_id", "status")
    more = have.filter("alert_id % 2 = 0").select((F.col("alert_id") + 100_000_000).alias("alert_id"), F.lit("new").alias("status"))
    return merge.insert_new(have, more.union(have.withColumn("status", F.lit("again"))), ["alert_id"])


@query("snk_11_incremental", "SELECT transaction_id FROM txn WHERE us > (SELECT MIN(us) + (MAX(us) - MIN(us)) // 2 FROM txn)")
def snk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the bookmark."""
    txns = view(spark, sf_dir, "txn")
    state = txns.agg(F.expr("min(us) + (max(us) - min(us)) div 2").alias("high")).select(F.lit("txn").alias("table_name"), "high")
    return merge.incremental(txns, state, "txn", "us").select("transaction_id")


@query("snk_12_scd2", """
    SELECT c_custkey, c_mktsegment, 1 AS valid_from, CASE WHEN c_custkey % 4 = 0 AND c_mktsegment <> 'MOVED' THEN 2 END AS valid_to, NOT (c_custkey % 4 = 0 AND c_mktsegment <> 'MOVED') AS is_current FROM customer WHERE c_custkey % 9 <> 0
    UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END, 2, NULL, TRUE FROM customer WHERE (c_custkey % 4 = 0 AND c_mktsegment <> 'MOVED') OR c_custkey % 9 = 0""")
def snk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose segment changed, as a slowly changing dimension."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    dimension = customers.filter("c_custkey % 9 <> 0").select("c_custkey", "c_mktsegment", F.lit(1).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.lit(True).alias("is_current"))
    source = customers.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return merge.scd2(dimension, source, "c_custkey", ["c_mktsegment"], F.lit(2))


@query("src_17_date_dimension", """
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, strftime(d, '%Y-%m-%d') AS day, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(week(d) AS INTEGER) AS week, CAST(dayofweek(d) AS INTEGER) AS weekday, dayofweek(d) IN (0, 6) AS is_weekend
    FROM (SELECT CAST(unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d) days""")
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar dimension."""
    return files.date_dimension(spark)


_GATE = """
    WITH RECURSIVE steps AS (SELECT alert_id, account_id, created_us AS us, COALESCE(rule_id, 'none') || '|' || severity AS key, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY created_us, alert_id) AS n FROM alert),
    walk AS (SELECT 0::BIGINT AS n, account_id, NULL::BIGINT AS alert_id, NULL::VARCHAR AS verdict, []::STRUCT(us BIGINT, key VARCHAR)[] AS sent FROM (SELECT DISTINCT account_id FROM steps) a
      UNION ALL
      SELECT s.n, s.account_id, s.alert_id, CASE WHEN dup THEN 'duplicate' WHEN full_ THEN 'throttled' ELSE 'sent' END, CASE WHEN dup OR full_ THEN w.sent ELSE list_append(w.sent, {'us': s.us, 'key': s.key}) END
      FROM walk w JOIN steps s ON s.account_id = w.account_id AND s.n = w.n + 1,
        LATERAL (SELECT len(list_filter(w.sent, lambda x: x.key = s.key AND s.us - x.us < 3600000000)) > 0 AS dup, len(list_filter(w.sent, lambda x: s.us - x.us < 3600000000)) >= 5 AS full_) t)
    SELECT alert_id, account_id, verdict FROM walk WHERE n > 0"""


@query("win_18_alert_gate", _GATE)
def win_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the sequential alert gate."""
    return alerts.gate(view(spark, sf_dir, "alert"))


@query("jn_08_unnest_json", "SELECT event_id, 'k' AS key, CAST(props->>'$.k' AS BIGINT) AS value FROM events WHERE props->>'$.k' IS NOT NULL")
def jn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each entry of a JSON object."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("jn_15_exact_prefix_default", """
    SELECT t.transaction_id, COALESCE(e.name, p.name, 'other') AS name FROM (SELECT transaction_id, CAST(5000 + (transaction_id * 17) % 1000 AS VARCHAR) AS mcc FROM txn) t
    LEFT JOIN (SELECT '5411' AS code, 'grocery' AS name UNION ALL SELECT '5812', 'restaurant') e ON t.mcc = e.code LEFT JOIN (SELECT '54' AS code, 'food' AS name UNION ALL SELECT '58', 'dining' UNION ALL SELECT '51', 'supplies') p ON left(t.mcc, 2) = p.code""")
def jn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category by exact code, else by prefix, else a default; both tables have a few fixed rows."""
    rows = view(spark, sf_dir, "txn").select("transaction_id", (5000 + (F.col("transaction_id") * 17) % 1000).cast("string").alias("mcc"))
    exact = spark.createDataFrame([("5411", "grocery"), ("5812", "restaurant")], "code string, exact string")
    prefix = spark.createDataFrame([("54", "food"), ("58", "dining"), ("51", "supplies")], "start string, loose string")
    joined = rows.join(F.broadcast(exact), F.col("mcc") == F.col("code"), "left").join(F.broadcast(prefix), F.left("mcc", F.lit(2)) == F.col("start"), "left")
    return joined.select("transaction_id", F.coalesce("exact", "loose", F.lit("other")).alias("name"))




@query("flt_18_validated", """
    WITH v AS (SELECT transaction_id, CASE WHEN country IN ('US', 'GB', 'DE', 'FR', 'JP', 'BR') THEN 0 ELSE 1 END + CASE WHEN mcc_slot IS NULL THEN 1 ELSE 0 END + CASE WHEN length(channel) > 5 THEN 1 ELSE 0 END + CASE WHEN amount < 1 THEN 1 ELSE 0 END + CASE WHEN us < (SELECT MAX(us) FROM txn) - 7776000000000 THEN 1 ELSE 0 END AS errors,
                 CASE WHEN amount > 50 AND CAST(amount AS DOUBLE) = FLOOR(CAST(amount AS DOUBLE)) THEN 1 ELSE 0 END + CASE WHEN amount > 99 THEN 1 ELSE 0 END AS warnings FROM txn)
    SELECT transaction_id, errors = 0 AS is_valid, errors, warnings FROM v""")
def flt_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows checked field by field and across fields."""
    txns = view(spark, sf_dir, "txn")
    now = txns.agg(F.max("us").alias("now")).first()["now"] or 0
    spec = {"country": {"required": True, "allowed": ["US", "GB", "DE", "FR", "JP", "BR"]}, "mcc_slot": {"required": True}, "channel": {"max_length": 5, "pattern": "[a-z]+"}, "amount": {"minimum": 1, "number": True}}
    rows = validate.validated(txns, spec, validate.transaction_rules(F.lit(now), round_over=50, high_value=99))
    count = lambda severity: F.size(F.filter("issues", lambda x: x["severity"] == severity))
    return rows.select("transaction_id", "is_valid", count("error").alias("errors"), count("warning").alias("warnings"))


@query("prj_01_variant", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def prj_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns from a variant."""
    v = F.parse_json("props")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("agg_53_stage_metrics", """
    SELECT transaction_type AS stage, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'declined') AS failed, CAST(COUNT(*) FILTER (WHERE status <> 'declined') AS DOUBLE) / COUNT(*) AS success_rate, CAST(MIN(amount) AS DOUBLE) AS least, CAST(MAX(amount) AS DOUBLE) AS most, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean FROM txn GROUP BY transaction_type""")
def agg_53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each stage in one aggregate."""
    amount = F.col("amount").cast("double")
    ok = F.count(F.when(F.col("status") != "declined", 1)).cast("double")
    return view(spark, sf_dir, "txn").groupBy(F.col("transaction_type").alias("stage")).agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "declined", 1)).alias("failed"), (ok / F.count("*")).alias("success_rate"), F.min(amount).alias("least"), F.max(amount).alias("most"), (F.sum("amount").cast("double") / F.count("*")).alias("mean"))


@query("st_07_transitions", "SELECT alert_id, status = 'open' AS may_investigate, status IN ('open', 'investigating') AS may_resolve, status = 'investigating' AS may_reopen FROM alert")
def st_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves that each alert's state allows."""
    rows = view(spark, sf_dir, "alert").select("alert_id", F.col("status").alias("from_status"), F.lit("investigating").alias("a"), F.lit("resolved").alias("b"), F.lit("open").alias("c"))
    return rows.select("alert_id", alerts.allowed(to="a").alias("may_investigate"), alerts.allowed(to="b").alias("may_resolve"), alerts.allowed(to="c").alias("may_reopen"))
