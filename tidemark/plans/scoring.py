"""Queries of the enrichment and scoring stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich
from ..sources import reference as ref
from ..sources.views import view
from .derived import _MILES, query
from .records import _table

_P = "PARTITION BY customer_id ORDER BY us, transaction_id"
_B = "PARTITION BY customer_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
_ARC = "POWER(SIN(RADIANS({2} - {0}) / 2), 2) + COS(RADIANS({0})) * COS(RADIANS({2})) * POWER(SIN(RADIANS({3} - {1}) / 2), 2)"


@query("stg_06_features", f"""
    WITH n AS (SELECT t.*, make_timestamp(us) AS tm, AVG(CAST(amount AS DOUBLE)) OVER p AS mean, STDDEV_SAMP(CAST(amount AS DOUBLE)) OVER p AS sd, LAG(us) OVER o AS last_us, LAG(channel) OVER o AS last_channel, ROW_NUMBER() OVER o AS rn,
        COUNT(*) OVER ({_B.format(3600000000)}) - 1 AS n1, COUNT(*) OVER ({_B.format(86400000000)}) - 1 AS n24, COUNT(*) OVER ({_B.format(604800000000)}) - 1 AS n7, CAST(SUM(amount) OVER ({_B.format(3600000000)}) - amount AS DOUBLE) AS s1, CAST(SUM(amount) OVER ({_B.format(86400000000)}) - amount AS DOUBLE) AS s24,
        list(merchant_id) OVER ({_B.format(86400000000)}) AS ms, list(country) OVER ({_B.format(86400000000)}) AS cs, ROW_NUMBER() OVER (PARTITION BY customer_id, merchant_id ORDER BY us, transaction_id) AS visit,
        MAX(CASE WHEN status <> 'declined' THEN 1 END) OVER p AS any_ok, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) AS soon
      FROM risk_txn t WINDOW p AS ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS ({_P})),
    oks AS (SELECT transaction_id, MAX(CASE WHEN status <> 'declined' THEN rn END) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok_rn FROM n),
    pct AS (SELECT a.transaction_id, AVG(CASE WHEN b.amount <= a.amount THEN 1e0 WHEN b.amount > a.amount THEN 0e0 END) AS pct FROM n a LEFT JOIN n b ON a.customer_id = b.customer_id AND b.rn < a.rn GROUP BY a.transaction_id)
    SELECT n.transaction_id, ROUND(CASE WHEN sd > 0 THEN (CAST(amount AS DOUBLE) - mean) / sd ELSE 0 END, 6) AS amount_zscore, CAST(EXTRACT(HOUR FROM tm) AS INTEGER) AS hour_of_day, CAST(EXTRACT(ISODOW FROM tm) - 1 AS INTEGER) AS day_of_week, EXTRACT(ISODOW FROM tm) >= 6 AS is_weekend,
      strftime(tm, '%m-%d') IN ('01-01', '01-20', '02-17', '05-26', '06-19', '07-04', '09-01', '10-13', '11-11', '11-27', '12-25') AS is_holiday, ROUND(COALESCE((us - last_us) / 1e6, 0), 2) AS time_since_last_transaction, ROUND(CASE WHEN mean > 0 THEN CAST(amount AS DOUBLE) / mean ELSE 0 END, 6) AS amount_to_avg_ratio,
      n1 AS txn_count_1h, n24 AS txn_count_24h, n7 AS txn_count_7d, ROUND(s1, 2) AS txn_amount_sum_1h, ROUND(s24, 2) AS txn_amount_sum_24h, len(list_distinct(ms)) - CASE WHEN len(list_filter(ms, lambda x: x = merchant_id)) = 1 THEN 1 ELSE 0 END AS unique_merchants_24h, len(list_distinct(cs)) - CASE WHEN len(list_filter(cs, lambda x: x = country)) = 1 THEN 1 ELSE 0 END AS unique_countries_24h,
      visit = 1 AS new_merchant_flag, EXTRACT(HOUR FROM tm) < 6 AS unusual_hour_flag, ROUND(COALESCE(pct, 0.5e0), 6) AS amount_percentile, COALESCE(last_channel <> channel, FALSE) AS channel_switch_flag, rn - 1 - COALESCE(ok_rn, 0) AS consecutive_declined_count, soon > 0 AS rapid_succession_flag
    FROM n JOIN oks USING (transaction_id) JOIN pct USING (transaction_id)""")
def stg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty features of every transaction."""
    return enrich.features(view(spark, sf_dir, "risk_txn"))


@query("fn_m03_derived_features", """
    WITH t AS (SELECT transaction_id, CAST(amount AS DOUBLE) AS a, make_timestamp(us) AS tm, country <> 'US' AS abroad, CASE WHEN transaction_id % 3 = 0 THEN 50e0 ELSE 20e0 END AS mean, CASE WHEN transaction_id % 5 = 0 THEN 0e0 ELSE 8e0 END AS sd, CASE WHEN EXTRACT(HOUR FROM make_timestamp(us)) < 6 THEN 1e0 ELSE 0e0 END AS odd FROM risk_txn)
    SELECT transaction_id, ROUND(LN(1 + a), 9) AS amount_log, ROUND(CASE WHEN sd > 0 THEN (a - mean) / sd ELSE 0 END, 6) AS zscore, ROUND(a / mean, 6) AS ratio, ROUND(a - mean, 6) AS deviation, CAST(EXTRACT(HOUR FROM tm) * 60 + EXTRACT(MINUTE FROM tm) AS DOUBLE) AS minutes_since_midnight,
      odd AS unusual_hour, a AS amount_x_velocity, a * odd AS amount_x_hour_risk, 0e0 AS international_x_new_merchant, CASE WHEN a > 3 * mean THEN odd ELSE 0e0 END AS high_amount_x_unusual_hour FROM t""")
def fn_m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a transaction alone, crosses, and defaults for what isn't known."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "risk_txn").withColumns({"account_avg_amount": F.when(i % 3 != 0, 20.0), "account_std_amount": F.when(i % 5 == 0, 0.0).otherwise(8.0)})
    names = ["amount_log", "zscore", "ratio", "deviation", "minutes_since_midnight", "unusual_hour", "amount_x_velocity", "amount_x_hour_risk", "international_x_new_merchant", "high_amount_x_unusual_hour"]
    return enrich.derived_features(rows).select("transaction_id", *[F.round(n, {"amount_log": 9}.get(n, 6)).alias(n) if n in ("amount_log", "zscore", "ratio", "deviation") else F.col(n) for n in names])


@query("stg_07_geo", f"""
    WITH t AS (SELECT r.*, LAG(lat) OVER o AS lat0, LAG(lon) OVER o AS lon0, ABS(us - LAG(us) OVER o) / 3.6e9 AS hours, CASE WHEN customer_id % 2 = 0 THEN CAST(customer_id % 50 AS DOUBLE) END AS hlat, CASE WHEN customer_id % 2 = 0 THEN CAST(customer_id % 120 AS DOUBLE) END AS hlon FROM risk_txn r WINDOW o AS ({_P})),
    d AS (SELECT t.*, COALESCE({_table(ref.COUNTRY_RISK)}[country], 0.1e0) AS risk, {_ARC.format("hlat", "hlon", "lat", "lon")} AS a1, {_ARC.format("lat0", "lon0", "lat", "lon")} AS a2 FROM t),
    e AS (SELECT transaction_id, risk, {_MILES.replace("(a)", "(a1)").replace("1 - a", "1 - a1")} AS home, CASE WHEN hours >= 0.001 THEN {_MILES.replace("(a)", "(a2)").replace("1 - a", "1 - a2")} / hours END AS mph FROM d)
    SELECT transaction_id, risk, risk >= 0.7e0 AS high_risk, ROUND(home, 4) AS miles_from_home, ROUND(mph, 3) AS mph, COALESCE(mph > 500, FALSE) AS impossible FROM e""")
def stg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of the country, distance from home and speed of travel."""
    txns = view(spark, sf_dir, "risk_txn")
    homes = txns.select("customer_id").distinct().filter("customer_id % 2 = 0").select("customer_id", (F.col("customer_id") % 50).cast("double").alias("home_lat"), (F.col("customer_id") % 120).cast("double").alias("home_lon"))
    rows = enrich.with_place(txns, homes)
    return rows.select("transaction_id", F.col("geo_country_risk").alias("risk"), F.col("geo_is_high_risk").alias("high_risk"), F.round("geo_miles_from_home", 4).alias("miles_from_home"), F.round("geo_mph", 3).alias("mph"), F.col("geo_impossible_travel").alias("impossible"))


@query("stg_08_device", """
    WITH d AS (SELECT transaction_id, us, customer_id, CASE WHEN transaction_id % 31 = 0 THEN NULL ELSE device_id END AS device_id FROM risk_txn),
    h AS (SELECT d.*, COUNT(*) OVER b AS n, MIN(us) OVER b AS since, COUNT(DISTINCT customer_id) OVER b AS accounts, ROW_NUMBER() OVER (PARTITION BY device_id, customer_id ORDER BY us, transaction_id) > 1 AS known FROM d WHERE device_id IS NOT NULL WINDOW b AS (PARTITION BY device_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT transaction_id, known, COALESCE((us - since) / 8.64e10 < 1, TRUE) AS is_new, COALESCE((us - since) / 8.64e10, 0) AS age, accounts, CASE WHEN n = 0 THEN 0.3e0 ELSE LEAST(1e0, 0.5e0 + 0.01e0 * (n * (n + 1) / 2 - 1)) END AS trust FROM h)
    SELECT d.transaction_id, known, is_new, ROUND(age, 6) AS age_days, accounts, ROUND(trust, 6) AS trust, ROUND(CASE WHEN trust IS NULL THEN 0.8e0 ELSE LEAST(1e0, CASE WHEN NOT known THEN 0.3e0 WHEN is_new THEN 0.15e0 ELSE 0e0 END + CASE WHEN accounts >= 3 THEN 0.3e0 ELSE 0e0 END + 0.2e0 * (1 - trust)) END, 6) AS risk FROM d LEFT JOIN r USING (transaction_id)""")
def stg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a device's past says."""
    rows = enrich.with_device(view(spark, sf_dir, "risk_txn").withColumn("device_id", F.when(F.col("transaction_id") % 31 != 0, F.col("device_id"))))
    return rows.select("transaction_id", F.col("device_is_known").alias("known"), F.col("device_is_new").alias("is_new"), F.round("device_age_days", 6).alias("age_days"), F.col("device_accounts").alias("accounts"), F.round("device_trust", 6).alias("trust"), F.round("device_risk", 6).alias("risk"))


@query("stg_09_merchant", f"""
    WITH m AS (SELECT transaction_id, us, CASE WHEN transaction_id % 37 = 0 THEN NULL ELSE merchant_id END AS merchant_id, CASE WHEN transaction_id % 41 = 0 THEN '' ELSE mcc END AS mcc, status = 'declined' AS fraud FROM risk_txn),
    h AS (SELECT m.*, COUNT(*) OVER b AS n, COUNT(CASE WHEN fraud THEN 1 END) OVER b AS frauds, MIN(us) OVER b AS since FROM m WHERE merchant_id IS NOT NULL WINDOW b AS (PARTITION BY merchant_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT transaction_id, mcc, CASE WHEN mcc = '' THEN 0.5e0 ELSE COALESCE({_table(ref.MCC_RISK)}[mcc], {_table(ref.MCC_RISK)}[left(mcc, 2) || 'xx'], 0.3e0) END AS mcc_risk, COALESCE(CAST(frauds AS DOUBLE) / NULLIF(n, 0), 0) AS rate, COALESCE((us - since) / 8.64e10 < 30, TRUE) AS is_new FROM h)
    SELECT m.transaction_id, mcc_risk, ROUND(rate, 9) AS fraud_rate, rate >= 0.05e0 AS high_fraud, is_new, ROUND(CASE WHEN mcc_risk IS NULL THEN 0.5e0 ELSE LEAST(1e0, 0.4e0 * mcc_risk + 0.3e0 * LEAST(1e0, rate / 0.2e0) + CASE WHEN is_new THEN 0.12e0 ELSE 0e0 END + CASE WHEN r.mcc = '' THEN 0.1e0 ELSE 0e0 END) END, 6) AS risk FROM m LEFT JOIN r USING (transaction_id)""")
def stg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merchant's category and past say."""
    i = F.col("transaction_id")
    txns = view(spark, sf_dir, "risk_txn").withColumns({"merchant_id": F.when(i % 37 != 0, F.col("merchant_id")), "mcc": F.when(i % 41 == 0, "").otherwise(F.col("mcc"))})
    rows = enrich.with_merchant(txns, F.col("status") == "declined")
    return rows.select("transaction_id", F.col("merchant_mcc_risk").alias("mcc_risk"), F.round("merchant_fraud_rate", 9).alias("fraud_rate"), F.col("merchant_is_high_fraud").alias("high_fraud"), F.col("merchant_is_new").alias("is_new"), F.round("merchant_risk", 6).alias("risk"))


_METHODS = """
    WITH s AS (SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 THEN NULL ELSE score END AS r, CASE WHEN transaction_id % 7 = 0 THEN NULL ELSE CAST((transaction_id * 41) % 200 AS DOUBLE) / 100 - 1 END AS a, CASE WHEN transaction_id % 4 = 0 THEN NULL ELSE CAST((transaction_id * 43) % 100 AS DOUBLE) / 100 END AS m, CAST((transaction_id * 47) % 100 AS DOUBLE) / 100 AS c FROM latest_score),
    w AS (SELECT s.*, CASE WHEN r IS NULL THEN 0e0 ELSE 0.3e0 END AS wr, CASE WHEN a IS NULL THEN 0e0 ELSE 0.3e0 END AS wa, CASE WHEN m IS NULL THEN 0e0 WHEN c < 0.5e0 THEN 0.2e0 ELSE 0.4e0 END AS wm FROM s),
    f AS (SELECT w.*, CASE WHEN wr + wa + wm > 0 THEN (COALESCE(r * wr, 0) + COALESCE((1 - a) / 2 * wa, 0) + COALESCE(m * wm, 0)) / (wr + wa + wm) ELSE 0 END AS x FROM w)
"""


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("transaction_id")
    of = lambda k, n: ((i * k) % n).cast("double") / 100
    return view(spark, sf_dir, "latest_score").select("transaction_id", enrich.method_results(F.when(i % 3 != 0, F.col("score")), F.when(i % 7 != 0, of(41, 200) - 1), F.when(i % 4 != 0, of(43, 100)), of(47, 100)).alias("methods"))


@query("stg_12_ensemble", _METHODS + "SELECT transaction_id, ROUND(x, 6) AS final, CASE WHEN x >= 0.85e0 THEN 'critical' WHEN x >= 0.6e0 THEN 'high' WHEN x >= 0.3e0 THEN 'medium' ELSE 'low' END AS class, x >= 0.6e0 AS alert, x >= 0.9e0 AS block, x >= 0.7e0 AS review FROM f")
def stg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods' scores joined into one, its class and what follows from it."""
    x = F.col("x")
    return _methods(spark, sf_dir).select("transaction_id", enrich.final_score(F.col("methods")).alias("x")).select("transaction_id", F.round("x", 6).alias("final"), enrich.classified(x).alias("class"), (x >= 0.6).alias("alert"), (x >= 0.9).alias("block"), (x >= 0.7).alias("review"))


@query("stg_13_methods", _METHODS + """
    SELECT transaction_id, 'rule_engine' AS method, COALESCE(r, 0) AS raw, ROUND(COALESCE(r, 0), 6) AS normalised, 0.3e0 AS weight, ROUND(COALESCE(r * 0.3e0, 0), 6) AS weighted, r IS NOT NULL AS success FROM f
    UNION ALL SELECT transaction_id, 'anomaly_detector', COALESCE(a, 0), ROUND(COALESCE((1 - a) / 2, 0), 6), 0.3e0, ROUND(COALESCE((1 - a) / 2 * 0.3e0, 0), 6), a IS NOT NULL FROM f
    UNION ALL SELECT transaction_id, 'ml_model', COALESCE(m, 0), ROUND(COALESCE(m, 0), 6), CASE WHEN c < 0.5e0 THEN 0.2e0 ELSE 0.4e0 END, ROUND(COALESCE(m * CASE WHEN c < 0.5e0 THEN 0.2e0 ELSE 0.4e0 END, 0), 6), m IS NOT NULL FROM f""")
def stg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's score, put on one scale and weighed."""
    rows = _methods(spark, sf_dir).select("transaction_id", F.inline("methods"))
    return rows.select("transaction_id", "method", "raw", F.round("normalised", 6).alias("normalised"), "weight", F.round("weighted", 6).alias("weighted"), "success")


@query("fn_m09_batch_score", """
    WITH b AS (SELECT transaction_id, ROUND(0.30e0 * COALESCE(CASE WHEN transaction_id % 3 <> 0 THEN score END, 0) + 0.25e0 * CAST((transaction_id * 41) % 100 AS DOUBLE) / 100 + 0.45e0 * CAST((transaction_id * 43) % 100 AS DOUBLE) / 100, 6) AS x FROM latest_score)
    SELECT transaction_id, x AS score, CASE WHEN x >= 0.95e0 THEN 'critical' WHEN x >= 0.8e0 THEN 'high' WHEN x >= 0.5e0 THEN 'medium' ELSE 'low' END AS class, CASE WHEN x >= 0.95e0 THEN 'critical' WHEN x >= 0.8e0 THEN 'high' WHEN x >= 0.5e0 THEN 'medium' WHEN x >= 0.3e0 THEN 'low' ELSE 'minimal' END AS service_class FROM b""")
def fn_m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job's score, and its class under two sets of cuts."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "latest_score").select("transaction_id", enrich.batch_score(F.when(i % 3 != 0, F.col("score")), (i * 41) % 100 / 100, (i * 43) % 100 / 100).alias("score"))
    return rows.select("transaction_id", "score", enrich.classified(F.col("score"), "batch").alias("class"), enrich.classified(F.col("score"), "service").alias("service_class"))


@query("fn_m11_confidence", """
    WITH q AS (SELECT transaction_id, score, (transaction_id % 9 + 0.5e0 * (transaction_id % 5)) / 20 AS worse FROM latest_score),
    g AS (SELECT transaction_id, score, CASE WHEN worse > 0.3e0 THEN 'poor' WHEN worse > 0.1e0 THEN 'degraded' ELSE 'good' END AS quality FROM q)
    SELECT transaction_id, quality, ROUND(LEAST(1e0, ABS(score - 0.5e0) * 2 * CASE quality WHEN 'good' THEN 1e0 WHEN 'degraded' THEN 0.8e0 ELSE 0.5e0 END), 6) AS confidence FROM g""")
def fn_m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from the score and the quality of its features."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "latest_score").select("transaction_id", "score", enrich.feature_quality(i % 9, i % 5, 20).alias("quality"))
    return rows.select("transaction_id", "quality", F.round(enrich.confidence(F.col("score"), F.col("quality")), 6).alias("confidence"))
