"""Queries of limits on what is sent, of pages, of distinct values up to a time and of tables refreshed from deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, frames, lifecycle, refresh
from ..operators.lineage import cut, scratch
from ..sources.views import view
from .derived import query


def _walk(total: int, storm: int, pace: int) -> str:
    """Alerts one by one, with those sent held in a list; ``storm`` alerts within a minute pause it for five."""
    return f"""
    WITH RECURSIVE steps AS (SELECT alert_id, account_id, rule_id, us // {pace} AS us, ROW_NUMBER() OVER (ORDER BY us // {pace}, alert_id) AS n FROM (SELECT *, created_us - 1704067200000000 AS us FROM alert) a),
    walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS alert_id, NULL::VARCHAR AS reason, 0::BIGINT AS pause, []::STRUCT(us BIGINT, account BIGINT, rule VARCHAR)[] AS sent
      UNION ALL
      SELECT s.n, s.alert_id, CASE t.why WHEN 'start' THEN 'storm' ELSE t.why END, CASE t.why WHEN 'start' THEN s.us + 300000000 ELSE w.pause END,
        CASE WHEN t.why IS NULL THEN list_append(list_filter(w.sent, lambda x: s.us - x.us < 3600000000), {{'us': s.us, 'account': s.account_id, 'rule': s.rule_id}}) ELSE w.sent END
      FROM walk w JOIN steps s ON s.n = w.n + 1, LATERAL (SELECT CASE WHEN s.us < w.pause THEN 'storm' WHEN len(list_filter(w.sent, lambda x: s.us - x.us < 60000000)) >= {total} THEN 'total' WHEN len(list_filter(w.sent, lambda x: s.us - x.us < 60000000)) >= {storm} THEN 'start'
        WHEN len(list_filter(w.sent, lambda x: x.account = s.account_id AND s.us - x.us < 3600000000)) >= 5 THEN 'account' WHEN s.rule_id IS NOT NULL AND len(list_filter(w.sent, lambda x: x.rule = s.rule_id AND s.us - x.us < 3600000000)) >= 50 THEN 'rule' END AS why) t)
    SELECT alert_id, reason FROM walk WHERE n > 0"""


def _alerts(spark: SparkSession, sf_dir: str, pace: int) -> DataFrame:
    return view(spark, sf_dir, "alert").withColumn("created_us", F.expr(f"(created_us - 1704067200000000) div {pace}"))


@query("win_19_throttles", _walk(100, 200, 2000))
def win_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits on what is sent, in all, by account and by rule, with a storm set off by 200; time runs 2,000 times as fast."""
    return admission.throttled(_alerts(spark, sf_dir, 2000), cut, lifecycle.THROTTLES, lifecycle.STORM)


@query("win_19_storm", _walk(60, 20, 6000))
def win_19_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storm that sets in before the total is full: five minutes of silence; time runs 6,000 times as fast."""
    return admission.throttled(_alerts(spark, sf_dir, 6000), cut, lifecycle.THROTTLES | {"total": (60, 60)}, (20, 300))


@query("st_09_rate_limit", """
    WITH RECURSIVE steps AS (SELECT transaction_id AS id, account_id AS k, us // 400 AS us, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY us // 400, transaction_id) AS n FROM (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM txn) t),
    walk AS (SELECT 0::BIGINT AS n, k, NULL::BIGINT AS id, NULL::BOOLEAN AS allowed, []::BIGINT[] AS sent FROM (SELECT DISTINCT k FROM steps) a
      UNION ALL SELECT s.n, s.k, s.id, t.free, CASE WHEN t.free THEN list_append(list_filter(w.sent, lambda x: s.us - x < 3600000000), s.us) ELSE w.sent END FROM walk w JOIN steps s ON s.k = w.k AND s.n = w.n + 1, LATERAL (SELECT len(list_filter(w.sent, lambda x: s.us - x < 3600000000)) < 5 AS free) t)
    SELECT id AS transaction_id, allowed FROM walk WHERE n > 0""")
def st_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five of an account within an hour, those turned away not counting; time runs 400 times as fast."""
    rows = view(spark, sf_dir, "txn").select("transaction_id", "account_id", F.expr("(us - 1704067200000000) div 400").alias("at"))
    return admission.limited(rows, ["account_id"], "at", "transaction_id", 5, 3600).select("transaction_id", F.col("why").isNull().alias("allowed"))


@query("srt_07_page", "SELECT transaction_id, us FROM txn ORDER BY us DESC, transaction_id LIMIT 100 OFFSET (SELECT (LEAST(GREATEST(3, 1), (COUNT(*) + 99) // 100) - 1) * 100 FROM txn)")
def srt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a hundred, or the last one."""
    return frames.page(view(spark, sf_dir, "txn"), [F.desc("us"), F.asc("transaction_id")], 3, 100).select("transaction_id", "us")


_SPANS = {"1h": 3600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}


@query("agg_03_distinct_values", "WITH e AS (SELECT account_id, us, CASE WHEN transaction_id % 4 = 0 THEN '' WHEN transaction_id % 9 <> 0 THEN country END AS country FROM txn), m AS (SELECT MAX(us) AS now_us FROM txn) SELECT account_id, " + ", ".join(f"COUNT(DISTINCT country) FILTER (WHERE country <> '' AND us >= now_us - {s}000000 AND us < now_us) AS distinct_{n}" for n, s in _SPANS.items()) + " FROM e CROSS JOIN m GROUP BY account_id")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's countries within look-back windows before now; null and empty ones don't count."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "txn").withColumn("country", F.when(i % 4 == 0, "").when(i % 9 != 0, F.col("country")))
    now = rows.agg(F.max("us")).first()[0] or 0
    return frames.distinct_until(rows, "account_id", "us", "country", now, _SPANS)


@query("agg_03_distinct_frames", "WITH e AS (SELECT transaction_id, account_id, us, CASE WHEN transaction_id % 4 = 0 THEN '' WHEN transaction_id % 9 <> 0 THEN country END AS country FROM txn) SELECT transaction_id, COUNT(DISTINCT NULLIF(country, '')) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS countries FROM e")
def agg_03_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same before every transaction of an account."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "txn").withColumn("country", F.when(i % 4 == 0, "").when(i % 9 != 0, F.col("country")))
    return frames.distinct_counts(rows, "account_id", "us", {"countries": ("country", 86_400)}, inclusive=False).select("transaction_id", "countries")


def _thrice(rows: DataFrame, what: refresh.Aggregate) -> DataFrame:
    """A table refreshed at three times, the last of which is now."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    first, last = rows.agg(F.min(what.at), F.max(what.at)).first()
    if first is not None:
        for now in (first + (last - first) // 2, first + (last - first) * 9 // 10, last):
            refresh.refreshed(folder, rows, what, now)
        return refresh.current(spark, folder, what)
    return rows.groupBy(*what.keys).agg(*[F.sum(c).alias(n) for n, c in what.sums.items()], *[F.max(c).alias(n) for n, c in what.maxima.items()], *[F.count_distinct(c).alias(n) for n, c in what.distinct.items()])


@query("snk_16_velocity_table", "SELECT account_id, us // 3600000000 AS hour, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(DISTINCT merchant_id) AS merchants FROM txn GROUP BY ALL")
def snk_16_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly velocity of accounts, kept and refreshed."""
    rows = view(spark, sf_dir, "txn").select("account_id", F.expr("us div 3600000000").alias("hour"), "us", "amount", "merchant_id")
    what = refresh.Aggregate(("account_id", "hour"), "us", {"n": F.lit(1), "total": F.col("amount")}, distinct={"merchants": "merchant_id"})
    return _thrice(rows, what).withColumn("total", F.col("total").cast("double"))


@query("snk_16_merchant_table", "SELECT merchant_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'declined') AS declined, COUNT(DISTINCT customer_id) AS customers, ROUND(COUNT(*) FILTER (WHERE status = 'declined') / CAST(COUNT(*) AS DOUBLE), 9) AS rate FROM txn GROUP BY merchant_id HAVING COUNT(*) >= 10")
def snk_16_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risky merchants of ten transactions or more, kept and refreshed."""
    rows = view(spark, sf_dir, "txn").select("merchant_id", "us", "status", "customer_id")
    what = refresh.Aggregate(("merchant_id",), "us", {"n": F.lit(1), "declined": (F.col("status") == "declined").cast("bigint")}, distinct={"customers": "customer_id"})
    return _thrice(rows, what).filter("n >= 10").withColumn("rate", F.round(F.col("declined") / F.col("n"), 9))


@query("snk_16_customer_table", "SELECT t.customer_id, COUNT(*) AS n, ROUND(AVG(s.score), 9) AS mean_score, MAX(s.score) AS top_score, COUNT(*) FILTER (WHERE s.score >= 0.8) AS risky FROM txn t JOIN latest_score s USING (transaction_id) GROUP BY t.customer_id")
def snk_16_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' risk, kept and refreshed."""
    rows = view(spark, sf_dir, "txn").join(view(spark, sf_dir, "latest_score"), "transaction_id").select("customer_id", "us", "score")
    what = refresh.Aggregate(("customer_id",), "us", {"n": F.lit(1), "score": F.col("score"), "risky": (F.col("score") >= 0.8).cast("bigint")}, {"top_score": F.col("score")})
    return _thrice(rows, what).select("customer_id", "n", F.round(F.col("score") / F.col("n"), 9).alias("mean_score"), "top_score", "risky")
