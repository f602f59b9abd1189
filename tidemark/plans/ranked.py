"""Reports whose work is dealt to tasks, most on ranks and percentiles by ranges of values; their oracle texts are those of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drift
from ..operators import models, ranks, skew
from ..sources.views import spark_sql, view
from .derived import query
from .reports import REPORTS


def _without(name: str, *parts: str) -> str:
    """A report's text without its percentiles, which the Spark side computes from counts by value."""
    text = REPORTS[name]
    for part in parts:
        if part not in text:
            raise ValueError(f"{name} has no {part}")
        text = text.replace(part, "")
    return text


_MEDIAN = " CAST(MEDIAN(CAST(amount AS DOUBLE)) AS DOUBLE) AS middle,"
_FACT = "SELECT CAST(day AS VARCHAR(10)) AS day, CAST(amount AS DOUBLE) AS amount FROM fact"


@query("agg_08_daily_summary", REPORTS["agg_08_daily_summary"])
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums and the median amount."""
    base = spark_sql(spark, sf_dir, _without("agg_08_daily_summary", _MEDIAN))
    return base.join(ranks.percentiles(spark_sql(spark, sf_dir, _FACT), "amount", {"middle": 0.5}, ["day"]), "day")


@query("agg_12_model_performance", REPORTS["agg_12_model_performance"])
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and latency of each model."""
    base = spark_sql(spark, sf_dir, _without("agg_12_model_performance", " ROUND(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY latency_ms), 6) AS p95_ms,"))
    p95 = ranks.percentiles(view(spark, sf_dir, "txn_score"), "latency_ms", {"p95_ms": 0.95}, ["model_version"])
    return base.join(p95.withColumn("p95_ms", F.round("p95_ms", 6)), "model_version")


@query("agg_13_daily_digest", REPORTS["agg_13_daily_digest"])
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily percentiles of amounts and numbers of members."""
    cut = [f" ROUND(PERCENTILE_CONT({p}) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE)), 4) AS {n}," for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    base = spark_sql(spark, sf_dir, _without("agg_13_daily_digest", *cut))
    found = ranks.percentiles(spark_sql(spark, sf_dir, _FACT), "amount", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["day"])
    return base.join(found.select("day", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")]), "day")


@query("agg_39_roc", REPORTS["agg_39_roc"])
def agg_39_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the ROC and precision curves."""
    return ranks.roc(view(spark, sf_dir, "scored_label"))


@query("agg_39_auc", REPORTS["agg_39_auc"])
def agg_39_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve and average precision."""
    return ranks.auc(view(spark, sf_dir, "scored_label")).select(F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"))


@query("agg_40_auc_trend", REPORTS["agg_40_auc_trend"])
def agg_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area for each period that has five labels and both kinds."""
    out = ranks.auc(view(spark, sf_dir, "scored_label"), ["period"])
    return out.select("period", (F.col("p") + F.col("n")).alias("labels"), F.when(F.col("p") + F.col("n") >= 5, F.round("auc", 9)).alias("auc"))


@query("agg_43_ks", REPORTS["agg_43_ks"])
def agg_43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two periods."""
    return ranks.ks(view(spark, sf_dir, "scored_label"), "score", F.col("period") == "base").select(F.round("ks", 9).alias("ks"))


_X = "(ks * SQRT(CAST(ta AS DOUBLE) * tb / (ta + tb)))"
_LARGE = " + ".join(f"({'2e0' if k % 2 else '-2e0'}) * EXP(-2e0 * {k * k} * {_X} * {_X})" for k in range(1, 9))
_SMALL = f"1 - SQRT(2 * PI()) / {_X} * (" + " + ".join(f"EXP(-POWER({2 * k - 1} * PI(), 2) / (8 * {_X} * {_X}))" for k in range(1, 9)) + ")"


@query("agg_43_ks_test", f"""
    WITH x AS (SELECT 'quality' AS feature, CAST(score AS DOUBLE) AS x, period = 'base' AS base FROM scored_label UNION ALL SELECT 'amount', CAST(amount AS DOUBLE), transaction_id % 2 = 0 FROM txn UNION ALL SELECT 'drifting', CAST(amount AS DOUBLE) + CASE WHEN us >= 1705276800000000 THEN 9 ELSE 0 END, us < 1705276800000000 FROM txn),
    steps AS (SELECT feature, x, COUNT(*) FILTER (WHERE base) AS a, COUNT(*) FILTER (WHERE NOT base) AS b FROM x GROUP BY feature, x),
    run AS (SELECT feature, SUM(a) OVER w AS ca, SUM(b) OVER w AS cb, SUM(a) OVER p AS ta, SUM(b) OVER p AS tb FROM steps WINDOW w AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)),
    d AS (SELECT feature, MAX(ABS(CAST(ca AS DOUBLE) / ta - CAST(cb AS DOUBLE) / tb)) AS ks, MAX(ta) AS ta, MAX(tb) AS tb FROM run GROUP BY feature),
    p AS (SELECT feature, ks, CASE WHEN {_X} >= 1 THEN LEAST(1e0, GREATEST(0e0, {_LARGE})) WHEN {_X} > 0.04 THEN LEAST(1e0, GREATEST(0e0, {_SMALL})) ELSE 1e0 END AS p_value FROM d)
    SELECT feature, ROUND(ks, 9) AS ks, ROUND(p_value, 9) AS p_value, p_value < 0.05 AS is_drifted FROM p""")
def agg_43_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each feature's periods, how likely it is without drift, and the verdict."""
    txns, late = view(spark, sf_dir, "txn"), F.col("us") >= 1_705_276_800_000_000
    amount = F.col("amount").cast("double")
    samples = {
        "quality": view(spark, sf_dir, "scored_label").select(F.col("score").alias("x"), (F.col("period") == "base").alias("base")),
        "amount": txns.select(amount.alias("x"), (F.col("transaction_id") % 2 == 0).alias("base")),
        "drifting": txns.select((amount + F.when(late, 9).otherwise(0)).alias("x"), (~late).alias("base")),
    }
    out = None
    for name, rows in samples.items():
        one = ranks.ks(rows, "x", F.col("base")).select(F.lit(name).alias("feature"), "ks", ranks.ks_p_value(F.col("ks"), F.col("a"), F.col("b")).alias("p_value"))
        out = one if out is None else out.union(one)
    return out.select("feature", F.round("ks", 9).alias("ks"), F.round("p_value", 9).alias("p_value"), (F.col("p_value") < 0.05).alias("is_drifted"))


@query("agg_42_score_psi", """
    WITH s AS (SELECT model_version, score, transaction_id % 3 = 0 AS base FROM txn_score UNION ALL SELECT 'v3', POWER(score, 1.5), transaction_id % 3 = 0 AND score < 0.7 FROM txn_score),
    bins AS (SELECT model_version, LEAST(FLOOR(score * 50), 49) AS bin, base FROM s WHERE score BETWEEN 0 AND 1),
    grid AS (SELECT model_version, b AS bin FROM (SELECT DISTINCT model_version FROM s) v CROSS JOIN range(50) r(b)),
    n AS (SELECT g.model_version, g.bin, COUNT(*) FILTER (WHERE base) AS b, COUNT(*) FILTER (WHERE NOT base) AS c FROM grid g LEFT JOIN bins USING (model_version, bin) GROUP BY g.model_version, g.bin),
    d AS (SELECT model_version, 50e0 * b / SUM(b) OVER w + 1e-8 AS b, 50e0 * c / SUM(c) OVER w + 1e-8 AS c, SUM(c) OVER w AS rows FROM n WINDOW w AS (PARTITION BY model_version)),
    h AS (SELECT model_version, b / SUM(b) OVER w AS b, c / SUM(c) OVER w AS c, rows FROM d WINDOW w AS (PARTITION BY model_version)),
    psi AS (SELECT model_version, CASE WHEN MAX(rows) >= 100 THEN SUM((c - b) * LN(c / b)) END AS psi FROM h GROUP BY model_version)
    SELECT model_version, ROUND(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'critical' WHEN psi > 0.1 THEN 'warning' END AS severity FROM psi""")
def agg_42_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each model's scores in fifty bins, and its alert."""
    scores = view(spark, sf_dir, "txn_score").select("model_version", "score", (F.col("transaction_id") % 3 == 0).alias("base"))
    third = scores.select(F.lit("v3").alias("model_version"), F.pow("score", F.lit(1.5)).alias("score"), (F.col("base") & (F.col("score") < 0.7)).alias("base"))
    psi = drift.score_psi(scores.union(third), ["model_version"])
    alerts = drift.prediction_alert(psi, ["model_version"]).select("model_version", "severity")
    return psi.join(alerts, "model_version", "left").select("model_version", F.round("psi", 6).alias("psi"), "severity")


@query("agg_45_distribution", REPORTS["agg_45_distribution"])
def agg_45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and percentiles of scores by period."""
    fractions = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    rows = view(spark, sf_dir, "scored_label")
    base = rows.groupBy("period").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.stddev_pop("score"), 9).alias("sd"))
    return base.join(ranks.percentiles(rows, "score", fractions, ["period"]).select("period", *[F.round(c, 9).alias(c) for c in fractions]), "period")


@query("agg_46_latency", REPORTS["agg_46_latency"])
def agg_46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of latency and the share of errors."""
    rows = view(spark, sf_dir, "txn_score")
    rate = rows.agg((F.count(F.when(F.col("latency_ms") > 190, 1)).cast("double") / F.count("*")).alias("error_rate"))
    return ranks.percentiles(rows, "latency_ms", {"p95_ms": 0.95}).select(F.round("p95_ms", 6).alias("p95_ms")).crossJoin(rate)  # one row each


@query("agg_47_nearest_rank", REPORTS["agg_47_nearest_rank"])
def agg_47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by nearest rank."""
    return ranks.nearest_rank(view(spark, sf_dir, "txn_score"), "latency_ms", 95, "p95_ms")


@query("agg_57_platform_metrics", REPORTS["agg_57_platform_metrics"])
def agg_57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and latency of the platform."""
    cut = ", ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY latency_ms), 6) AS p50, ROUND(PERCENTILE_CONT(0.99) WITHIN GROUP (ORDER BY latency_ms), 6) AS p99"
    base = spark_sql(spark, sf_dir, _without("agg_57_platform_metrics", cut))
    found = ranks.percentiles(view(spark, sf_dir, "latest_score"), "latency_ms", {"p50": 0.5, "p99": 0.99})
    return base.crossJoin(found.select(F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99")))  # one row each


_GRID = (0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.1)
_CUTS = ", ".join(f"quantile_cont(anomaly, {c}) AS t{k}" for k, c in enumerate(_GRID))
_F1 = " UNION ALL ".join(f"SELECT {c}e0 AS contamination, ANY_VALUE(t{k}) AS threshold, 2e0 * COUNT(*) FILTER (WHERE anomaly < t{k} AND fraud) / NULLIF(COUNT(*) FILTER (WHERE anomaly < t{k}) + COUNT(*) FILTER (WHERE fraud), 0) AS f1 FROM s CROSS JOIN cuts" for k, c in enumerate(_GRID))


@query("udf_05_contamination", f"""
    WITH s AS (SELECT 1 - 2 * POWER(score, 3) AS anomaly, score >= 0.96 AND transaction_id % 3 > 0 OR transaction_id % 211 = 0 AS fraud FROM latest_score), cuts AS (SELECT {_CUTS} FROM s), f AS ({_F1})
    SELECT contamination, ROUND(threshold, 9) AS threshold, ROUND(COALESCE(f1, 0), 9) AS f1, ROW_NUMBER() OVER (ORDER BY COALESCE(f1, 0) DESC, contamination) = 1 AS best FROM f""")
def udf_05_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows to take for strange that finds frauds best."""
    i, score = F.col("transaction_id"), F.col("score")
    rows = view(spark, sf_dir, "latest_score").select((1 - 2 * F.pow(score, F.lit(3))).alias("anomaly"), ((score >= 0.96) & (i % 3 > 0) | (i % 211 == 0)).alias("fraud"))
    return models.contamination_scores(rows, "fraud", list(_GRID)).select("contamination", F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"), "best")


@query("agg_16_merchant_daily_risk")
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants' days with a fraud, by the SQL in ``reports``; lines are dealt to tasks by their number, twice."""
    number = spark_sql(spark, sf_dir, "SELECT COUNT(*) FROM lineitem").first()[0]
    lines = view(spark, sf_dir, "fact_line").select("transaction_id", "merchant_id", "is_fraud", "line_amount")
    days = view(spark, sf_dir, "fact").select("transaction_id", "day")
    both = skew.dealt(lines, number, "transaction_id").join(skew.dealt(days, number, "transaction_id"), "transaction_id")
    rows = skew.dealt(both.drop("transaction_id"), number, "merchant_id", "day").groupBy("merchant_id", "day")
    out = rows.agg(F.count("*").alias("n"), F.count_if("is_fraud").alias("frauds"), F.sum("line_amount").cast("double").alias("total"))
    return out.filter("frauds >= 1").withColumn("day", F.col("day").cast("string"))
