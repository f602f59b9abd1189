"""Reports and relational operators, stated once in SQL that both Spark and the oracle read.

Money is summed as decimals and turned to doubles at the end, so results don't depend on the order of rows; every
limited query has a unique tie-breaker; "now" is the last event.
"""

from __future__ import annotations


REPORTS: dict[str, str] = {
    # aggregations
    "agg_05_customer_profile": """
        SELECT customer_id, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean, CAST(MAX(amount) AS DOUBLE) AS largest,
               COUNT(DISTINCT merchant_id) AS merchants, COUNT(DISTINCT country) AS countries FROM txn GROUP BY customer_id""",
    "agg_06_customer_stats": """
        SELECT COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, CAST(MIN(amount) AS DOUBLE) AS least, CAST(MAX(amount) AS DOUBLE) AS largest, CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(*), 0) AS mean
        FROM txn WHERE account_id = 7 AND status = 'approved'""",
    "agg_07_alert_summary": "SELECT 'severity' AS kind, severity AS name, COUNT(*) AS n FROM alert GROUP BY severity UNION ALL SELECT 'status', status, COUNT(*) FROM alert GROUP BY status",
    "agg_08_daily_summary": """
        SELECT CAST(day AS VARCHAR(10)) AS day, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) FILTER (WHERE is_fraud) AS frauds, CAST(SUM(CASE WHEN is_fraud THEN amount ELSE 0 END) AS DOUBLE) AS fraud_total,
               CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / COUNT(*) AS fraud_rate, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean, CAST(MEDIAN(CAST(amount AS DOUBLE)) AS DOUBLE) AS middle,
               COUNT(DISTINCT customer_key) AS customers, COUNT(DISTINCT CASE WHEN is_fraud THEN customer_key END) AS fraud_customers
        FROM fact GROUP BY day""",
    "agg_09_fraud_by_geography": """
        SELECT g.country, g.region, COUNT(*) AS n, COUNT(*) FILTER (WHERE f.is_fraud) AS frauds, CAST(SUM(f.amount) AS DOUBLE) AS total, CAST(COUNT(*) FILTER (WHERE f.is_fraud) AS DOUBLE) / COUNT(*) AS fraud_rate
        FROM fact f JOIN geo g ON f.geo_key = g.geo_key GROUP BY g.country, g.region HAVING COUNT(*) FILTER (WHERE f.is_fraud) > 0""",
    "agg_10_fraud_by_category": """
        SELECT category, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_fraud) AS frauds, CAST(SUM(line_amount) AS DOUBLE) AS total, CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / COUNT(*) AS fraud_rate
        FROM fact_line GROUP BY category HAVING COUNT(*) >= 5""",
    "agg_11_hourly_metrics": """
        SELECT @us{date_trunc('hour', ts)} AS hour_us, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) FILTER (WHERE status = 'declined') AS declined,
               COUNT(*) FILTER (WHERE channel = 'online') AS online, COUNT(*) FILTER (WHERE channel = 'mobile') AS mobile, COUNT(*) FILTER (WHERE channel = 'pos') AS pos, COUNT(*) FILTER (WHERE channel = 'atm') AS atm
        FROM txn GROUP BY date_trunc('hour', ts)""",
    "agg_12_model_performance": """
        SELECT model_version, COUNT(*) AS n, ROUND(AVG(score), 9) AS mean_score, ROUND(STDDEV_SAMP(score), 9) AS sd_score, ROUND(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY latency_ms), 6) AS p95_ms, COUNT(*) FILTER (WHERE score >= 0.8) AS high
        FROM txn_score GROUP BY model_version""",
    "agg_13_daily_digest": """
        SELECT CAST(day AS VARCHAR(10)) AS day, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE)), 4) AS p50, ROUND(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE)), 4) AS p95, ROUND(PERCENTILE_CONT(0.99) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE)), 4) AS p99,
               COUNT(DISTINCT customer_key) AS customers, COUNT(DISTINCT geo_key) AS countries, COUNT(DISTINCT channel) AS channels, ROUND(100.0 * COUNT(*) FILTER (WHERE is_fraud) / NULLIF(COUNT(*), 0), 4) + 0e0 AS fraud_percent
        FROM fact GROUP BY day""",
    "agg_14_top_fraud_merchants": """
        SELECT merchant_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_fraud) AS frauds, CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / COUNT(*) AS rate
        FROM fact_line GROUP BY merchant_id HAVING COUNT(*) >= 10 ORDER BY rate DESC, merchant_id LIMIT 20""",
    "agg_14_top_fraud_countries": """
        SELECT g.country, COUNT(*) AS n, COUNT(*) FILTER (WHERE f.is_fraud) AS frauds FROM fact f JOIN geo g ON f.geo_key = g.geo_key
        GROUP BY g.country HAVING COUNT(*) >= 10 ORDER BY frauds DESC, g.country LIMIT 20""",
    "agg_15_alerts_by_severity_status": "SELECT severity, status, COUNT(*) AS n, ROUND(AVG(score), 9) AS mean_score FROM alert GROUP BY severity, status",
    "agg_16_merchant_daily_risk": """
        SELECT l.merchant_id, CAST(f.day AS VARCHAR(10)) AS day, COUNT(*) AS n, COUNT(*) FILTER (WHERE l.is_fraud) AS frauds, CAST(SUM(l.line_amount) AS DOUBLE) AS total
        FROM fact_line l JOIN fact f ON l.transaction_id = f.transaction_id GROUP BY l.merchant_id, f.day HAVING COUNT(*) FILTER (WHERE l.is_fraud) >= 1""",
    "agg_17_risk_by_hour_level": "SELECT CAST(EXTRACT(HOUR FROM t.ts) AS INTEGER) AS hour, a.severity, COUNT(*) AS n FROM alert a JOIN txn t ON a.transaction_id = t.transaction_id GROUP BY EXTRACT(HOUR FROM t.ts), a.severity",
    "agg_18_customer_risk_summary": """
        SELECT t.customer_id, COUNT(*) AS n, ROUND(AVG(s.score), 9) AS mean_score, MAX(s.score) AS top_score, COUNT(*) FILTER (WHERE s.score >= 0.8) AS risky
        FROM txn t JOIN latest_score s ON t.transaction_id = s.transaction_id GROUP BY t.customer_id""",
    "agg_18_velocity_by_hour": "SELECT account_id, @us{date_trunc('hour', ts)} AS hour_us, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(DISTINCT merchant_id) AS merchants FROM txn GROUP BY account_id, date_trunc('hour', ts)",
    "agg_19_kpis": """
        SELECT COUNT(*) AS total_txns, COUNT(*) FILTER (WHERE t.state = 'flagged') AS flagged_txns, ROUND(COALESCE(AVG(s.score), 0), 9) AS avg_risk_score, COUNT(DISTINCT a.alert_id) FILTER (WHERE a.status = 'open') AS active_alerts,
               COUNT(DISTINCT t.transaction_id) AS distinct_txns, CAST(SUM(t.amount) AS DOUBLE) AS fanned_total, COUNT(DISTINCT t.account_id) FILTER (WHERE s.score >= 0.8) AS risky_accounts
        FROM (SELECT x.*, CASE WHEN transaction_id % 25 = 3 THEN 'flagged' ELSE status END AS state FROM txn x) t LEFT JOIN txn_score s ON t.transaction_id = s.transaction_id LEFT JOIN alert a ON t.transaction_id = a.transaction_id
        WHERE t.us BETWEEN (SELECT MIN(us) FROM txn) + 3600000000 AND (SELECT MAX(us) FROM txn) AND (CAST(NULL AS VARCHAR(9)) IS NULL OR t.channel = CAST(NULL AS VARCHAR(9))) AND ('JP' IS NULL OR t.country <> 'JP')""",
    "agg_20_minute_volume": "SELECT @us{date_trunc('minute', ts)} AS minute_us, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total FROM txn GROUP BY date_trunc('minute', ts)",
    "agg_21_breakdowns": "SELECT 'country' AS kind, country AS name, COUNT(*) AS n FROM txn GROUP BY country UNION ALL SELECT 'channel', channel, COUNT(*) FROM txn GROUP BY channel",
    "agg_22_period_delta": """
        WITH ends AS (SELECT MAX(us) AS last_us FROM txn),
        sums AS (SELECT COUNT(*) FILTER (WHERE us > last_us - 86400000000) AS now_n, COUNT(*) FILTER (WHERE us <= last_us - 86400000000 AND us > last_us - 172800000000) AS before_n FROM txn CROSS JOIN ends)
        SELECT now_n, before_n, CASE WHEN before_n = 0 THEN NULL ELSE CAST(now_n - before_n AS DOUBLE) / before_n END AS delta FROM sums""",
    "agg_23_alert_trends": "SELECT grain, at_us, COUNT(*) AS n, ROUND(AVG(score), 9) AS mean_score FROM (SELECT 'day' AS grain, @us{date_trunc('day', created_at)} AS at_us, score FROM alert UNION ALL SELECT 'week', @us{date_trunc('week', created_at)}, score FROM alert UNION ALL SELECT 'month', @us{date_trunc('month', created_at)}, score FROM alert) trends GROUP BY grain, at_us",
    "agg_24_category_top": "SELECT category, COUNT(*) AS n, CAST(SUM(line_amount) AS DOUBLE) AS total FROM fact_line WHERE is_fraud GROUP BY category ORDER BY n DESC, category LIMIT 20",
    "agg_25_precision_trend": """
        SELECT @us{date_trunc('day', created_at)} AS day_us, COUNT(*) AS n, CASE WHEN COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive')) = 0 THEN 0e0 ELSE CAST(COUNT(*) FILTER (WHERE status = 'resolved') AS DOUBLE) / COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive')) END AS precision_proxy
        FROM alert GROUP BY date_trunc('day', created_at)""",
    "agg_26_rule_effectiveness": """
        SELECT r.rule_id, r.rule_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE a.status = 'resolved') AS confirmed, COUNT(*) FILTER (WHERE a.status = 'false_positive') AS wrong, ROUND(AVG((a.resolved_us - a.created_us) / 3.6e9), 6) AS mean_hours,
               CASE WHEN COUNT(*) FILTER (WHERE a.status = 'false_positive') > COUNT(*) FILTER (WHERE a.status = 'resolved') THEN 'tune' WHEN COUNT(*) FILTER (WHERE a.status = 'resolved') = 0 THEN 'watch' ELSE 'keep' END AS hint
        FROM alert a LEFT JOIN rule_table r ON a.rule_id = r.rule_id WHERE r.rule_id IS NOT NULL GROUP BY r.rule_id, r.rule_name HAVING COUNT(*) >= 3""",
    "agg_27_alert_volume": "SELECT @us{date_trunc('day', created_at)} AS day_us, severity, COUNT(*) AS n FROM alert GROUP BY date_trunc('day', created_at), severity",
    "agg_28_sla": """
        WITH ends AS (SELECT MAX(us) AS now_us FROM txn),
        timed AS (SELECT severity, (COALESCE(resolved_us, now_us) - created_us) / 3.6e9 AS hours, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 4 WHEN 'medium' THEN 24 ELSE 72 END AS target FROM alert CROSS JOIN ends)
        SELECT severity, COUNT(*) AS n, COUNT(*) FILTER (WHERE hours <= target) AS met, COUNT(*) FILTER (WHERE hours > target) AS breached, ROUND(AVG(hours), 6) AS mean_hours FROM timed GROUP BY severity""",
    "agg_29_alert_kpis": """
        WITH ends AS (SELECT MAX(us) AS now_us FROM txn),
        timed AS (SELECT a.*, (COALESCE(resolved_us, now_us) - created_us) / 3.6e9 AS hours, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 4 WHEN 'medium' THEN 24 ELSE 72 END AS target FROM alert a CROSS JOIN ends)
        SELECT COUNT(*) AS total_alerts, COUNT(*) FILTER (WHERE status IN ('open', 'investigating')) AS open_alerts, CASE WHEN COUNT(*) = 0 THEN 0e0 ELSE CAST(COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive')) AS DOUBLE) / COUNT(*) END AS resolution_rate,
               CASE WHEN COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive')) = 0 THEN 0e0 ELSE CAST(COUNT(*) FILTER (WHERE status = 'false_positive') AS DOUBLE) / COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive')) END AS false_positive_rate,
               CASE WHEN COUNT(*) = 0 THEN 0e0 ELSE CAST(COUNT(*) FILTER (WHERE hours <= target) AS DOUBLE) / COUNT(*) END AS sla_compliance, ROUND(COALESCE(AVG((resolved_us - created_us) / 3.6e9), 0), 6) AS avg_response_hours FROM timed""",
    "agg_30_resolution_by_analyst": "SELECT assigned_to, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'resolved') AS resolved, COUNT(*) FILTER (WHERE status = 'false_positive') AS wrong, ROUND(AVG((resolved_us - created_us) / 3.6e9), 6) AS mean_hours FROM alert WHERE assigned_to IS NOT NULL GROUP BY assigned_to",
    "agg_31_analyst_workload": """
        WITH ends AS (SELECT MAX(us) AS now_us FROM txn), who AS (SELECT DISTINCT assigned_to AS analyst FROM alert WHERE assigned_to IS NOT NULL),
        mine AS (SELECT assigned_to, COUNT(*) FILTER (WHERE status = 'investigating') AS my_active, COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive') AND resolved_us >= now_us - 604800000000) AS my_closed_7d FROM alert CROSS JOIN ends GROUP BY assigned_to),
        everyone AS (SELECT COUNT(*) FILTER (WHERE status = 'open') AS open_alerts, COUNT(*) FILTER (WHERE status = 'investigating') AS investigating_alerts, COUNT(*) FILTER (WHERE status IN ('resolved', 'false_positive')) AS closed_alerts,
          ROUND(COALESCE(AVG((resolved_us - created_us) / 3.6e9) FILTER (WHERE status IN ('resolved', 'false_positive') AND resolved_us IS NOT NULL), 0), 6) AS avg_resolution_hours FROM alert)
        SELECT analyst, open_alerts, investigating_alerts, closed_alerts, my_active, my_closed_7d, avg_resolution_hours FROM who JOIN mine ON analyst = assigned_to CROSS JOIN everyone""",
    "agg_33_channel_union": """
        WITH hours AS (SELECT @us{date_trunc('hour', ts)} AS hour_us, COUNT(*) FILTER (WHERE status = 'declined') AS bad, COUNT(*) FILTER (WHERE channel = 'online') AS online, COUNT(*) FILTER (WHERE channel = 'pos') AS pos, COUNT(*) FILTER (WHERE channel = 'atm') AS atm, COUNT(*) FILTER (WHERE channel = 'mobile') AS mobile FROM txn GROUP BY date_trunc('hour', ts))
        SELECT hour_us, 'online' AS channel, online AS n, bad FROM hours UNION ALL SELECT hour_us, 'pos', pos, bad FROM hours UNION ALL SELECT hour_us, 'atm', atm, bad FROM hours UNION ALL SELECT hour_us, 'mobile', mobile, bad FROM hours""",
    "agg_34_completeness": "SELECT COUNT(*) AS n, CAST(COUNT(*) - COUNT(mcc_slot) AS DOUBLE) / COUNT(*) AS mcc_null_rate, CAST(COUNT(*) - COUNT(mcc_slot) AS DOUBLE) / COUNT(*) <= 0.01 AS mcc_ok, CAST(COUNT(*) - COUNT(amount) AS DOUBLE) / COUNT(*) AS amount_null_rate FROM txn",
    "agg_35_freshness": "SELECT channel, MAX(us) AS last_us, ((SELECT MAX(us) FROM txn) - MAX(us)) / 6e7 AS age_minutes, ((SELECT MAX(us) FROM txn) - MAX(us)) / 6e7 <= 15 AS fresh FROM txn GROUP BY channel",
    "agg_36_volume_check": """
        WITH daily AS (SELECT day, COUNT(*) AS n FROM fact GROUP BY day),
        placed AS (SELECT day, n, AVG(CAST(n AS DOUBLE)) OVER w AS mean, STDDEV_SAMP(CAST(n AS DOUBLE)) OVER w AS sd FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
        SELECT CAST(day AS VARCHAR(10)) AS day, n, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, CASE WHEN sd IS NULL OR sd < 1e-9 THEN FALSE ELSE ABS(n - mean) / sd > 2 END AS odd FROM placed""",
    "agg_37_quality_report": """
        WITH checks AS (SELECT 'mcc' AS name, CAST(COUNT(*) - COUNT(mcc_slot) AS DOUBLE) / COUNT(*) <= 0.01 AS ok FROM txn UNION ALL SELECT 'rows', COUNT(*) > 0 FROM txn UNION ALL SELECT 'keys', COUNT(*) = COUNT(DISTINCT transaction_id) FROM txn)
        SELECT COUNT(*) AS checks, COUNT(*) FILTER (WHERE ok) AS passed, CASE WHEN COUNT(*) = COUNT(*) FILTER (WHERE ok) THEN 'HEALTHY' ELSE 'DEGRADED' END AS health FROM checks""",
    "agg_38_confusion": """
        WITH grid AS (SELECT a.v AS actual, p.v AS predicted FROM (SELECT 0 AS v UNION ALL SELECT 1) a CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) p),
        counted AS (SELECT label AS actual, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, COUNT(*) AS n FROM scored_label GROUP BY label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)
        SELECT g.actual, g.predicted, COALESCE(c.n, 0) AS n FROM grid g LEFT JOIN counted c ON g.actual = c.actual AND g.predicted = c.predicted""",
    "agg_39_roc": """
        WITH by_score AS (SELECT score, COUNT(*) FILTER (WHERE label = 1) AS p, COUNT(*) FILTER (WHERE label = 0) AS n FROM scored_label GROUP BY score),
        run AS (SELECT score, SUM(p) OVER w AS tp, SUM(n) OVER w AS fp FROM by_score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        total AS (SELECT CAST(SUM(p) AS DOUBLE) AS p, CAST(SUM(n) AS DOUBLE) AS n FROM by_score)
        SELECT score, ROUND(tp / total.p, 9) AS tpr, ROUND(fp / total.n, 9) AS fpr, ROUND(CAST(tp AS DOUBLE) / (tp + fp), 9) AS prec FROM run CROSS JOIN total""",
    "agg_39_auc": """
        WITH by_score AS (SELECT score, COUNT(*) FILTER (WHERE label = 1) AS p, COUNT(*) FILTER (WHERE label = 0) AS n FROM scored_label GROUP BY score),
        run AS (SELECT score, p, n, CAST(SUM(p) OVER w AS BIGINT) AS tp, CAST(SUM(n) OVER w AS BIGINT) AS fp FROM by_score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
        SELECT ROUND(CAST(SUM(n * (2 * tp - p)) AS DOUBLE) / 2 / (CAST(SUM(p) AS DOUBLE) * SUM(n)), 9) AS auc, ROUND(SUM(CAST(p AS DOUBLE) * tp / (tp + fp)) / SUM(p), 9) AS average_precision FROM run""",
    "agg_40_auc_trend": """
        WITH ranked AS (SELECT period, label, RANK() OVER (PARTITION BY period ORDER BY score) + (COUNT(*) OVER (PARTITION BY period, score) - 1) / 2e0 AS r FROM scored_label),
        sums AS (SELECT period, SUM(CASE WHEN label = 1 THEN r ELSE 0 END) AS rank_sum, COUNT(*) FILTER (WHERE label = 1) AS p, COUNT(*) FILTER (WHERE label = 0) AS n FROM ranked GROUP BY period)
        SELECT period, p + n AS labels, CASE WHEN p + n >= 5 AND p > 0 AND n > 0 THEN ROUND((rank_sum - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n), 9) END AS auc FROM sums""",
    "agg_41_psi": """
        WITH bins AS (SELECT CAST(LEAST(FLOOR(score * 10), 9) AS INTEGER) AS bin, period FROM scored_label WHERE score BETWEEN 0 AND 1),
        slots AS (SELECT 0 AS bin UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9),
        counts AS (SELECT s.bin, COUNT(*) FILTER (WHERE b.period = 'base') + 1e-8 AS e, COUNT(*) FILTER (WHERE b.period = 'now') + 1e-8 AS a FROM slots s LEFT JOIN bins b ON s.bin = b.bin GROUP BY s.bin),
        total AS (SELECT SUM(e) AS e, SUM(a) AS a FROM counts)
        SELECT ROUND(SUM((c.a / t.a - c.e / t.e) * LN((c.a / t.a) / (c.e / t.e))), 7) AS psi FROM counts c CROSS JOIN total t""",
    "agg_43_ks": """
        WITH steps AS (SELECT score, COUNT(*) FILTER (WHERE period = 'base') AS a, COUNT(*) FILTER (WHERE period = 'now') AS b FROM scored_label GROUP BY score),
        run AS (SELECT SUM(a) OVER w AS ca, SUM(b) OVER w AS cb, SUM(a) OVER () AS ta, SUM(b) OVER () AS tb FROM steps WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))
        SELECT ROUND(MAX(ABS(CAST(ca AS DOUBLE) / ta - CAST(cb AS DOUBLE) / tb)), 9) AS ks FROM run""",
    "agg_44_mean_shift": """
        SELECT ROUND(ABS(AVG(score) FILTER (WHERE period = 'now') - AVG(score) FILTER (WHERE period = 'base')) / (STDDEV_POP(score) FILTER (WHERE period = 'base')), 8) AS shift FROM scored_label""",
    "agg_45_distribution": """
        SELECT period, ROUND(AVG(score), 9) AS mean, ROUND(STDDEV_POP(score), 9) AS sd, ROUND(PERCENTILE_CONT(0.05) WITHIN GROUP (ORDER BY score), 9) AS p05, ROUND(PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY score), 9) AS p25, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY score), 9) AS p50, ROUND(PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY score), 9) AS p75, ROUND(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY score), 9) AS p95 FROM scored_label GROUP BY period""",
    "agg_46_latency": "SELECT ROUND(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY latency_ms), 6) AS p95_ms, CAST(COUNT(*) FILTER (WHERE latency_ms > 190) AS DOUBLE) / COUNT(*) AS error_rate FROM txn_score",
    "agg_47_nearest_rank": """
        WITH counts AS (SELECT latency_ms, COUNT(*) AS n FROM txn_score GROUP BY latency_ms),
        run AS (SELECT latency_ms, SUM(n) OVER (ORDER BY latency_ms ROWS UNBOUNDED PRECEDING) AS upto, SUM(n) OVER () AS total FROM counts)
        SELECT MIN(CASE WHEN upto > FLOOR(total * 95 / 100e0) THEN latency_ms END) AS p95_ms FROM run""",
    "agg_48_threshold_sweep": """
        WITH cuts AS (SELECT 0.1e0 AS cut UNION ALL SELECT 0.25e0 UNION ALL SELECT 0.5e0 UNION ALL SELECT 0.75e0 UNION ALL SELECT 0.9e0),
        counts AS (SELECT cut, COUNT(*) FILTER (WHERE label = 1 AND score >= cut) AS tp, COUNT(*) FILTER (WHERE label = 0 AND score >= cut) AS fp, COUNT(*) FILTER (WHERE label = 1 AND score < cut) AS fn, COUNT(*) FILTER (WHERE label = 0 AND score < cut) AS tn FROM scored_label CROSS JOIN cuts GROUP BY cut)
        SELECT cut, tp, fp, fn, tn, ROUND(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 9) AS prec, ROUND(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 9) AS rec, ROUND(2e0 * tp / NULLIF(2 * tp + fp + fn, 0), 9) AS f1 FROM counts""",
    "agg_49_fairness": """
        SELECT segment, COUNT(*) AS n, ROUND(AVG((score - label) * (score - label)), 9) AS brier, CAST(COUNT(*) FILTER (WHERE (score >= 0.5) = (label = 1)) AS DOUBLE) / COUNT(*) AS accuracy,
               CAST(COUNT(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE label = 1), 0) AS tpr, CAST(COUNT(*) FILTER (WHERE score >= 0.5 AND label = 0) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE label = 0), 0) AS fpr FROM scored_label GROUP BY segment""",
    "agg_50_measures": """
        WITH months AS (SELECT date_trunc('month', day) AS month, COUNT(*) AS n, SUM(amount) AS total, COUNT(*) FILTER (WHERE is_fraud) AS frauds FROM fact GROUP BY date_trunc('month', day))
        SELECT @us{m.month} AS month_us, m.n, CAST(m.total AS DOUBLE) AS total, CAST(m.frauds AS DOUBLE) / NULLIF(m.n, 0) AS rate, CAST(m.n - b.n AS DOUBLE) / NULLIF(b.n, 0) AS month_change FROM months m LEFT JOIN months b ON @us{b.month} = @us{m.month - INTERVAL '1' MONTH}""",
    "agg_50_all_measures": """
        WITH f AS (SELECT x.*, CAST(EXTRACT(YEAR FROM day) * 12 + EXTRACT(MONTH FROM day) - 1 AS INTEGER) AS month, transaction_id % 24 AS hour, is_flagged AND transaction_id % 5 IN (2, 3) AS closed, is_flagged AND transaction_id % 5 = 3 AS wrong,
                     (transaction_id % 96) * 60 + transaction_id % 47 AS minutes, CASE WHEN (score >= 0.5) = is_fraud THEN 1e0 ELSE 0e0 END AS hit, CASE risk_level WHEN 'critical' THEN 60 WHEN 'high' THEN 240 ELSE 1440 END AS target FROM fact x),
        hours AS (SELECT month, day, hour, COUNT(*) AS n FROM f GROUP BY month, day, hour),
        uptime AS (SELECT month, AVG(CAST(n AS DOUBLE)) AS per_hour, CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT day) / 24 * 100 AS pct FROM hours GROUP BY month),
        placed AS (SELECT month, day, minutes, target, ROW_NUMBER() OVER (PARTITION BY day ORDER BY minutes, transaction_id) - 1 AS place, (COUNT(*) OVER (PARTITION BY day) - 1) * 0.95e0 AS spot FROM f WHERE closed),
        solved_day AS (SELECT month, day, AVG(CAST(minutes AS DOUBLE)) AS mean, AVG(CASE WHEN minutes <= target THEN 1e0 ELSE 0e0 END) AS sla, SUM(CASE WHEN place = FLOOR(spot) THEN minutes * (1 - (spot - FLOOR(spot))) WHEN place = FLOOR(spot) + 1 THEN minutes * (spot - FLOOR(spot)) ELSE 0e0 END) AS p95 FROM placed GROUP BY month, day),
        solved AS (SELECT month, AVG(mean) AS mean, AVG(p95) AS p95, AVG(sla) AS sla FROM solved_day GROUP BY month),
        accurate AS (SELECT month, AVG(hit) AS accuracy, MAX(last_day) AS last_day FROM (SELECT month, AVG(hit) AS hit, MAX(day) AS last_day FROM f GROUP BY month, day) d GROUP BY month),
        ranked AS (SELECT f.month, f.is_fraud, RANK() OVER (PARTITION BY f.day ORDER BY f.score) + (COUNT(*) OVER (PARTITION BY f.day, f.score) - 1) / 2e0 AS rk FROM f JOIN accurate a ON f.day = a.last_day),
        area AS (SELECT month, (SUM(rk) FILTER (WHERE is_fraud) - COUNT(*) FILTER (WHERE is_fraud) * (COUNT(*) FILTER (WHERE is_fraud) + 1) / 2e0) / NULLIF(COUNT(*) FILTER (WHERE is_fraud) * COUNT(*) FILTER (WHERE NOT is_fraud), 0) AS auc FROM ranked GROUP BY month),
        lines AS (SELECT f.month, CAST(COUNT(*) FILTER (WHERE l.is_fraud AND l.category < 'Brand#3') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE l.category < 'Brand#3'), 0) AS category_rate FROM fact_line l JOIN f ON l.transaction_id = f.transaction_id GROUP BY f.month),
        base AS (SELECT month, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) FILTER (WHERE is_fraud) AS frauds, CAST(COALESCE(SUM(amount) FILTER (WHERE is_fraud), 0) AS DOUBLE) AS fraud_amount,
                   CAST(COALESCE(SUM(amount) FILTER (WHERE is_fraud AND is_flagged), 0) AS DOUBLE) AS prevented, COUNT(*) FILTER (WHERE is_fraud AND is_flagged) AS preventions, COUNT(*) FILTER (WHERE is_flagged) * 12.5e0 + COUNT(*) * 0.002e0 AS cost,
                   COALESCE(CAST(COUNT(*) FILTER (WHERE wrong) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE closed), 0), 0) AS wrong_rate, COUNT(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk, CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / COUNT(*) AS rate,
                   COALESCE(CAST(COUNT(*) FILTER (WHERE is_fraud AND channel = 'online') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE channel = 'online'), 0), 0) AS channel_rate, COALESCE(CAST(COUNT(*) FILTER (WHERE is_fraud AND geo_key < 8) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE geo_key < 8), 0), 0) AS geography_rate FROM f GROUP BY month)
        SELECT b.month, b.n AS total_transactions, b.total AS total_transaction_amount, b.frauds AS fraud_transactions, b.fraud_amount, b.prevented AS fraud_prevented, b.preventions AS fraud_prevention_count, ROUND(b.rate, 9) AS fraud_rate, ROUND(b.rate - COALESCE(m.rate, 0), 9) AS fraud_rate_mom, ROUND(b.rate - COALESCE(y.rate, 0), 9) AS fraud_rate_yoy,
               ROUND(COALESCE((b.prevented - b.cost) / NULLIF(b.cost, 0), 0), 6) AS platform_roi, ROUND(a.accuracy, 9) AS model_accuracy, ROUND(area.auc, 9) AS latest_model_auc, ROUND(s.mean, 6) AS average_alert_resolution_minutes, ROUND(s.p95, 6) AS p95_alert_resolution_minutes, ROUND(s.sla, 9) AS sla_compliance_rate, ROUND(b.wrong_rate, 9) AS false_positive_rate,
               ROUND(u.per_hour, 9) AS pipeline_throughput_per_hour, ROUND(u.pct / 100, 9) AS system_uptime, b.high_risk AS high_risk_indicator_count, ROUND(b.fraud_amount - COALESCE(y.fraud_amount, 0), 4) AS fraud_amount_yoy, ROUND(COALESCE(l.category_rate, 0), 9) AS merchant_category_fraud_rate, ROUND(b.channel_rate, 9) AS channel_fraud_rate, ROUND(b.geography_rate, 9) AS geography_fraud_rate
        FROM base b LEFT JOIN base m ON m.month = b.month - 1 LEFT JOIN base y ON y.month = b.month - 12 JOIN uptime u ON u.month = b.month JOIN accurate a ON a.month = b.month LEFT JOIN solved s ON s.month = b.month LEFT JOIN area ON area.month = b.month LEFT JOIN lines l ON l.month = b.month""",
    "agg_51_histogram": "SELECT CAST(LEAST(FLOOR(score * 20), 19) AS INTEGER) AS bin, COUNT(*) AS n FROM latest_score GROUP BY CAST(LEAST(FLOOR(score * 20), 19) AS INTEGER)",
    "agg_54_filtered_count": "SELECT COUNT(*) AS n FROM txn WHERE status = 'approved' AND channel = 'online' AND amount >= 50",
    "agg_57_platform_metrics": """
        SELECT CAST(COUNT(*) FILTER (WHERE score >= 0.8) AS DOUBLE) / COUNT(*) AS detection_rate, (SELECT CAST(COUNT(*) FILTER (WHERE status = 'false_positive') AS DOUBLE) / NULLIF(COUNT(*), 0) FROM alert) AS false_rate, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY latency_ms), 6) AS p50, ROUND(PERCENTILE_CONT(0.99) WITHIN GROUP (ORDER BY latency_ms), 6) AS p99 FROM latest_score""",
    # joins
    "jn_01_alert_transactions": "SELECT a.alert_id, a.severity, CAST(t.amount AS DOUBLE) AS amount, t.channel, t.country FROM alert a JOIN txn t ON a.transaction_id = t.transaction_id",
    "jn_02_star": "SELECT f.transaction_id, g.country, g.region, g.is_high_risk, c.c_name AS customer FROM fact f JOIN geo g ON f.geo_key = g.geo_key JOIN customer c ON f.customer_key = c.c_custkey WHERE f.is_fraud",
    "jn_04_null_safe": "SELECT t.transaction_id, m.name FROM txn t LEFT JOIN (SELECT 0 AS slot, 'zero' AS name UNION ALL SELECT 3, 'three' UNION ALL SELECT NULL, 'none') m ON COALESCE(t.mcc_slot, -1) = COALESCE(m.slot, -1)",
    "jn_06_left_rules": "SELECT a.alert_id, a.rule_id, COALESCE(r.rule_name, 'unknown') AS rule_name FROM alert a LEFT JOIN rule_table r ON a.rule_id = r.rule_id",
    "jn_07_latest_score": "SELECT a.alert_id, s.score, s.model_version FROM alert a LEFT JOIN latest_score s ON a.transaction_id = s.transaction_id",
    "jn_09_semi": "SELECT t.transaction_id, t.customer_id FROM txn t WHERE EXISTS (SELECT 1 FROM txn_score s WHERE s.transaction_id = t.transaction_id AND s.score BETWEEN 0.9 AND 1.0)",
    "jn_10_anti": "SELECT t.transaction_id FROM txn t LEFT JOIN alert a ON t.transaction_id = a.transaction_id WHERE a.transaction_id IS NULL AND t.amount > 90",
    "jn_11_scalar_subquery": "SELECT alert_id, rule_id FROM alert WHERE rule_id = (SELECT MIN(rule_id) FROM alert WHERE severity = 'critical') OR account_id = (SELECT MIN(account_id) FROM alert)",
    "jn_18_integrity": "SELECT COUNT(*) AS orphans FROM alert a LEFT JOIN txn t ON a.transaction_id = t.transaction_id WHERE t.transaction_id IS NULL",
    # sorts, limits, paging
    "srt_01_alert_page": "SELECT alert_id, severity, created_us FROM alert ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, created_us DESC, alert_id LIMIT 25 OFFSET 25",
    "srt_03_newest": "SELECT transaction_id, us FROM txn ORDER BY us DESC, transaction_id LIMIT 50 OFFSET 100",
    "srt_04_top_scores": "SELECT transaction_id, score FROM latest_score WHERE score >= 0.8 ORDER BY score DESC, transaction_id LIMIT 100",
    "srt_06_customer_history": "SELECT transaction_id, us, CAST(amount AS DOUBLE) AS amount FROM txn WHERE customer_id = (SELECT MIN(customer_id) FROM txn) AND us >= (SELECT MAX(us) FROM txn) - 2592000000000 ORDER BY us DESC, transaction_id LIMIT 500",
    "srt_11_live_feed": "SELECT t.transaction_id, t.us, s.score FROM txn t LEFT JOIN latest_score s ON t.transaction_id = s.transaction_id ORDER BY t.us DESC, t.transaction_id LIMIT 100",
    # sets and filters
    "set_01_union_all": "SELECT transaction_id, 'base' AS span, score FROM latest_score WHERE transaction_id % 2 = 0 UNION ALL SELECT transaction_id, 'now', score FROM latest_score WHERE transaction_id % 2 = 1",
    "set_02_distinct": "SELECT DISTINCT channel, status, country FROM txn",
    "flt_26_ilike": "SELECT alert_id, assigned_to, rule_id FROM alert WHERE assigned_to ILIKE '%ANALYST3%' OR rule_id ILIKE 'RULE1%'",
    "flt_27_between": "SELECT COUNT(*) AS n FROM fact WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "flt_31_filter_clause": "SELECT country, COUNT(*) FILTER (WHERE status = 'declined') AS declined, COUNT(*) FILTER (WHERE amount > 50) AS large FROM txn GROUP BY country",
    "flt_30_tenant_security": "SELECT t.transaction_id, t.country FROM txn t WHERE t.country IN (SELECT c FROM (SELECT 'amy' AS who, 'US' AS c UNION ALL SELECT 'amy', 'GB' UNION ALL SELECT 'bob', 'DE') acl WHERE who = 'amy')",
    # projections
    "prj_12_fact_load": "SELECT transaction_id, CAST(EXTRACT(YEAR FROM day) * 10000 + EXTRACT(MONTH FROM day) * 100 + EXTRACT(DAY FROM day) AS INTEGER) AS date_key, CAST(amount AS DOUBLE) AS amount, is_fraud, is_flagged, score, COALESCE(risk_level, 'low') AS severity FROM fact",
    "prj_14_label_derivation": """
        SELECT t.transaction_id, CASE WHEN a.status = 'resolved' THEN 1 WHEN a.status = 'false_positive' THEN 0 WHEN a.alert_id IS NULL AND t.status = 'approved' THEN 0 END AS label FROM txn t LEFT JOIN alert a ON t.transaction_id = a.transaction_id""",
    # windows
    "win_01_velocity_history": """
        SELECT transaction_id, (COUNT(*) OVER h1) - 1 AS n_1h, (COUNT(*) OVER h24) - 1 AS n_24h, (COUNT(*) OVER d7) - 1 AS n_7d, CAST((SUM(amount) OVER h1) - amount AS DOUBLE) AS sum_1h, CAST((SUM(amount) OVER h24) - amount AS DOUBLE) AS sum_24h
        FROM txn WINDOW h1 AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), h24 AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), d7 AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)""",
    "win_05_since_last": "SELECT transaction_id, (us - LAG(us) OVER (PARTITION BY customer_id ORDER BY us, transaction_id)) / 1e6 AS seconds_since FROM txn",
    "win_06_zscore": """
        SELECT transaction_id, ROUND((CAST(amount AS DOUBLE) - mean) / NULLIF(sd, 0), 6) AS z, ROUND(CAST(amount AS DOUBLE) / NULLIF(mean, 0), 6) AS ratio FROM (
          SELECT transaction_id, amount, CAST(SUM(amount) OVER w AS DOUBLE) / COUNT(*) OVER w AS mean, ROUND(STDDEV_SAMP(CAST(amount AS DOUBLE)) OVER w, 7) AS sd FROM txn
          WINDOW w AS (PARTITION BY customer_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) prior_rows""",
    "win_08_new_merchant": "SELECT transaction_id, ROW_NUMBER() OVER (PARTITION BY customer_id, merchant_id ORDER BY us, transaction_id) = 1 AS is_new FROM txn",
    "win_09_channel_switch": "SELECT transaction_id, COALESCE(channel <> LAG(channel) OVER (PARTITION BY customer_id ORDER BY us, transaction_id), FALSE) AS switched FROM txn",
    "win_10_consecutive_declines": """
        WITH marked AS (SELECT transaction_id, customer_id, us, status, SUM(CASE WHEN status = 'declined' THEN 0 ELSE 1 END) OVER (PARTITION BY customer_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM txn)
        SELECT transaction_id, CAST(COUNT(CASE WHEN status = 'declined' THEN 1 END) OVER (PARTITION BY customer_id, COALESCE(island, 0) ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS declines FROM marked""",
    "win_11_rapid_succession": "SELECT transaction_id, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) > 0 AS rapid FROM txn",
    "win_12_symmetric": "SELECT transaction_id, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND 600000000 FOLLOWING) - 1 AS around FROM txn",
    "win_14_latest_per_key": "SELECT customer_id, transaction_id, us FROM (SELECT customer_id, transaction_id, us, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY us DESC, transaction_id DESC) AS rn FROM txn) r WHERE rn = 1",
    "win_16_expanding_folds": """
        WITH days AS (SELECT @div{us||,||86400000000} AS day, COUNT(*) AS n FROM txn GROUP BY @div{us||,||86400000000}),
        run AS (SELECT day, COALESCE(SUM(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, SUM(n) OVER () AS n FROM days),
        placed AS (SELECT t.transaction_id, @div{r.n||,||6} AS size, r.n, r.earlier + ROW_NUMBER() OVER (PARTITION BY r.day ORDER BY t.us, t.transaction_id) AS rn FROM txn t JOIN run r ON @div{t.us||,||86400000000} = r.day)
        SELECT transaction_id, fold, CASE WHEN rn <= n - (5 - fold) * size THEN 'train' ELSE 'test' END AS part FROM placed CROSS JOIN (SELECT 0 AS fold UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) f WHERE rn <= n - (4 - fold) * size""",
    "win_16_time_split": """
        WITH days AS (SELECT @div{us||,||86400000000} AS day, COUNT(*) AS n FROM txn GROUP BY @div{us||,||86400000000}),
        run AS (SELECT day, COALESCE(SUM(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, SUM(n) OVER () AS n FROM days),
        placed AS (SELECT t.transaction_id, r.n, r.earlier + ROW_NUMBER() OVER (PARTITION BY r.day ORDER BY t.us, t.transaction_id) AS rn FROM txn t JOIN run r ON @div{t.us||,||86400000000} = r.day)
        SELECT transaction_id, CASE WHEN rn <= FLOOR(n * 0.7e0) THEN 'train' WHEN rn <= FLOOR(n * 0.7e0) + FLOOR(n * 0.15e0) THEN 'validation' ELSE 'test' END AS part FROM placed""",
    "win_17_first_kept": "SELECT transaction_id FROM (SELECT transaction_id, ROW_NUMBER() OVER (PARTITION BY account_id, merchant_id, channel ORDER BY us, transaction_id) AS rn FROM txn) r WHERE rn = 1",
    "win_20_drift_windows": """
        WITH ends AS (SELECT MAX(scored_us) AS now_us FROM txn_score)
        SELECT 'now' AS span, COUNT(*) AS n, ROUND(AVG(score), 9) AS mean FROM txn_score CROSS JOIN ends WHERE scored_us > now_us - 86400000000
        UNION ALL SELECT 'before', COUNT(*), ROUND(AVG(score), 9) FROM txn_score CROSS JOIN ends WHERE scored_us <= now_us - 86400000000 AND scored_us > now_us - 172800000000""",
}
