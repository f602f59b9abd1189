"""Queries of the warehouse: loads, dimensions, facts, refreshes, exports and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.lineage import scratch
from ..sources import files
from ..sources.views import spark_sql, view
from .derived import query

_RECENT = "us >= (SELECT MAX(us) FROM txn) - 86400000000"


@query("snk_10_staging_merge", f"""
    SELECT t.transaction_id, t.amount, CASE WHEN t.{_RECENT} THEN s.score ELSE 0e0 END AS score FROM txn t JOIN latest_score s ON t.transaction_id = s.transaction_id WHERE t.transaction_id % 3 <> 0
    UNION ALL SELECT t.transaction_id, t.amount, s.score FROM txn t JOIN latest_score s ON t.transaction_id = s.transaction_id WHERE t.transaction_id % 3 = 0 AND t.{_RECENT}""")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of the last hours merged into staging: scores of known rows change, new rows go in whole."""
    raw = view(spark, sf_dir, "txn").join(view(spark, sf_dir, "latest_score").select("transaction_id", "score"), "transaction_id").select("transaction_id", "amount", "score", "us")
    staging = raw.filter("transaction_id % 3 <> 0").select("transaction_id", "amount", F.lit(0.0).alias("score"))
    recent = merge.looked_back(raw, "us", raw.agg(F.max("us").alias("now")), 86_400_000_000).select("transaction_id", "amount", "score")
    return merge.upsert(staging, recent, ["transaction_id"], ["score"])


@query("snk_13_dimensions", """
    SELECT 'merchant' AS dimension, CAST(merchant_id AS VARCHAR) AS member, CASE WHEN merchant_id % 2 = 0 THEN 6 ELSE 1 END AS n FROM (SELECT DISTINCT merchant_id FROM txn) m
    UNION ALL SELECT 'geography', country || '/' || COALESCE(city, ''), 0 FROM (SELECT DISTINCT country, CASE WHEN customer_id % 4 = 0 THEN NULL ELSE 'c' || CAST(customer_id % 4 AS VARCHAR) END AS city FROM txn) g""")
def snk_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants and places of a batch put into their dimensions; a merchant that is known counts one more batch."""
    txns = view(spark, sf_dir, "txn").withColumn("city", F.when(F.col("customer_id") % 4 != 0, F.concat(F.lit("c"), (F.col("customer_id") % 4).cast("string"))))
    known = txns.select("merchant_id").distinct().filter("merchant_id % 2 = 0").withColumn("n", F.lit(5))
    merchants = merge.upsert_dimension(known, txns, ["merchant_id"], "n")
    old = txns.filter("country = 'US'").select("country", "city").distinct()
    places = merge.insert_new_null_safe(old, txns.select("country", "city"), ["country", "city"])
    return merchants.select(F.lit("merchant").alias("dimension"), F.col("merchant_id").cast("string").alias("member"), "n").union(places.select(F.lit("geography"), F.concat_ws("/", "country", F.coalesce("city", F.lit(""))), F.lit(0)))


@query("snk_14_profiles", "SELECT customer_id, n, CAST(CASE WHEN customer_id % 2 = 0 THEN total ELSE 1 END AS DOUBLE) AS total, CASE WHEN customer_id % 2 = 0 THEN 'b2' ELSE 'b1' END AS batch FROM (SELECT customer_id, COUNT(*) AS n, SUM(amount) AS total FROM txn GROUP BY customer_id) p")
def snk_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer profiles from variants merged over those of an earlier batch."""
    sums = view(spark, sf_dir, "txn").groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    old = sums.select("customer_id", "n", F.lit(1.0).alias("total"), F.lit("b1").alias("batch"))
    raw = sums.filter("customer_id % 2 = 0").select(F.parse_json(F.to_json(F.struct("customer_id", "n", F.col("total").cast("string").alias("total")))).alias("raw_data"))
    get = lambda path, kind: F.try_variant_get("raw_data", f"$.{path}", kind).alias(path)
    new = raw.select(get("customer_id", "bigint"), get("n", "bigint"), get("total", "double"), F.lit("b2").alias("batch"))
    return merge.upsert(old, new, ["customer_id"])


_DISTRIBUTION = "SELECT @div{us||,||3600000000} AS hour, CASE WHEN s.score >= 0.8 THEN 'high' ELSE 'low' END AS level, COUNT(*) AS n, ROUND(AVG(s.score), 9) AS mean, SUM(amount) AS total FROM txn t JOIN latest_score s ON t.transaction_id = s.transaction_id GROUP BY 1, 2"


@query("snk_15_table_as", _DISTRIBUTION)
def snk_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report kept as a table that each refresh replaces."""
    return files.replaced(spark_sql(spark, sf_dir, _DISTRIBUTION), scratch(spark))


@query("snk_17_replace_day", "SELECT CAST(ts AS DATE) AS day, 1 AS version, COUNT(*) AS n FROM txn WHERE CAST(ts AS DATE) <> DATE '2024-01-15' GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE), 2, COUNT(*) FROM txn WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1")
def snk_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's rows deleted and written anew."""
    days = view(spark, sf_dir, "txn").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    table = days.select("day", F.lit(1).alias("version"), "n")
    return merge.replace_where(table, days.select("day", F.lit(2).alias("version"), "n"), F.col("day") == F.lit("2024-01-15").cast("date"))


@query("prj_13_fact_rows", """
    SELECT t.transaction_id, s.score >= 0.8 AS is_fraudulent, CAST(t.ts AS DATE) AS day, EXTRACT(HOUR FROM t.ts) AS hour FROM txn t JOIN latest_score s ON t.transaction_id = s.transaction_id WHERE t.transaction_id % 4 <> 0""")
def prj_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the fact table lacks, with labels from the level and truncated times."""
    staging = view(spark, sf_dir, "txn").join(view(spark, sf_dir, "latest_score").select("transaction_id", "score"), "transaction_id").withColumn("level", F.when(F.col("score") >= 0.9, "critical").when(F.col("score") >= 0.8, "high").otherwise("low"))
    fact = staging.filter("transaction_id % 4 = 0").select("transaction_id")
    new = merge.missing(staging, fact, ["transaction_id"])
    return new.select("transaction_id", F.col("level").isin("high", "critical").alias("is_fraudulent"), F.to_date("ts").alias("day"), F.hour(F.date_trunc("hour", "ts")).cast("bigint").alias("hour"))


@query("jn_03_fact_keys", """
    SELECT t.transaction_id, CAST(strftime(t.ts, '%Y%m%d') AS INTEGER) AS date_key, CASE WHEN t.customer_id % 2 = 0 THEN t.customer_id * 10 + 1 END AS customer_key, CASE WHEN t.merchant_id % 3 = 0 THEN t.merchant_id + 1000 END AS merchant_key, CASE t.channel WHEN 'online' THEN 1 WHEN 'pos' THEN 2 WHEN 'mobile' THEN 3 END AS channel_key, s.score, a.severity, COALESCE(a.status = 'resolved', FALSE) AS is_fraud
    FROM txn t LEFT JOIN latest_score s ON t.transaction_id = s.transaction_id LEFT JOIN alert a ON t.transaction_id = a.transaction_id""")
def jn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact row's keys from six dimensions, the customer's from its current version only."""
    txns = view(spark, sf_dir, "txn")
    customers = txns.select("customer_id").distinct().filter("customer_id % 2 = 0").select("customer_id", F.explode(F.array(F.struct((F.col("customer_id") * 10).alias("customer_key"), F.lit(False).alias("is_current")), F.struct((F.col("customer_id") * 10 + 1).alias("customer_key"), F.lit(True).alias("is_current")))).alias("v")).select("customer_id", "v.*")
    merchants = txns.select("merchant_id").distinct().filter("merchant_id % 3 = 0").withColumn("merchant_key", F.col("merchant_id") + 1000)
    channels = spark.createDataFrame([("online", 1), ("pos", 2), ("mobile", 3)], "channel string, channel_key int")
    scores, alerts_ = view(spark, sf_dir, "latest_score").select("transaction_id", "score"), view(spark, sf_dir, "alert").select("transaction_id", "severity", F.col("status").alias("alert_status"))
    rows = txns.join(customers.filter("is_current").drop("is_current"), "customer_id", "left").join(merchants, "merchant_id", "left").join(F.broadcast(channels), "channel", "left").join(scores, "transaction_id", "left").join(alerts_, "transaction_id", "left")
    return rows.select("transaction_id", F.date_format("ts", "yyyyMMdd").cast("int").alias("date_key"), "customer_key", "merchant_key", "channel_key", "score", "severity", F.coalesce(F.col("alert_status") == "resolved", F.lit(False)).alias("is_fraud"))


@query("jn_13_update_from", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN FALSE ELSE TRUE END AS is_current, CASE WHEN c_custkey % 5 = 0 THEN 9 END AS valid_to FROM customer")
def jn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose tracked value differs in another table are closed."""
    target = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", F.lit(True).alias("is_current"), F.lit(None).cast("int").alias("valid_to"))
    source = target.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("new_segment"))
    return merge.update_from(target, source, ["c_custkey"], F.col("c_mktsegment") != F.col("new_segment"), {"is_current": F.lit(False), "valid_to": F.lit(9)}).select("c_custkey", "is_current", "valid_to")


@query("jn_14_profile_lookup", "SELECT t.transaction_id, p.n, p.mean FROM txn t LEFT JOIN (SELECT customer_id, COUNT(*) AS n, ROUND(AVG(CAST(amount AS DOUBLE)), 6) AS mean FROM txn WHERE customer_id % 3 <> 0 GROUP BY customer_id) p ON t.customer_id = p.customer_id")
def jn_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction with its customer's profile, if there is one."""
    txns = view(spark, sf_dir, "txn")
    profiles = txns.filter("customer_id % 3 <> 0").groupBy("customer_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("amount").cast("double")), 6).alias("mean"))
    return txns.join(profiles, "customer_id", "left").select("transaction_id", "n", "mean")


@query("jn_19_columns_lacking", "SELECT 'events' AS source, 'account_id,amount' AS lacking, 'props' AS extra")
def jn_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a table lacks, and those that are not wanted, from its schema alone."""
    have = spark.read.parquet(f"{sf_dir}/events.parquet").columns
    lacking, extra = files.column_differences(have, ["event_id", "ts", "user_id", "event_type", "value", "account_id", "amount"])
    return spark.createDataFrame([("events", ",".join(lacking), ",".join(extra))], "source string, lacking string, extra string")


@query("flt_35_load_checks", "SELECT COUNT(*) AS staged, COUNT(*) FILTER (WHERE transaction_id % 4 = 0) AS loaded, COUNT(*) FILTER (WHERE mcc_slot IS NULL) AS null_keys, FALSE AS passed FROM txn")
def flt_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and null keys after a load, in one pass over each table."""
    staged = view(spark, sf_dir, "txn")
    return merge.load_checks(staged, staged.filter("transaction_id % 4 = 0").select("transaction_id"), "mcc_slot")


@query("snk_07_cascade_delete", "SELECT 'txn' AS of, COUNT(*) AS n FROM txn WHERE transaction_id % 10 <> 3 UNION ALL SELECT 'alert', COUNT(*) FROM alert WHERE transaction_id % 10 <> 3 UNION ALL SELECT 'score', COUNT(*) FROM latest_score WHERE transaction_id % 10 <> 3")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions deleted with the alerts and scores that hang on them."""
    gone = view(spark, sf_dir, "txn").filter("transaction_id % 10 = 3").select("transaction_id")
    left = merge.cascade({n: view(spark, sf_dir, v) for n, v in (("txn", "txn"), ("alert", "alert"), ("score", "latest_score"))}, gone, ["transaction_id"])
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("of"), "n") for n, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


def _exported(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark)
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("s_acctbal"))
        return files.round_trip(rows, path, how)

    return run


_SUPPLIERS = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier"
for _how in ("csv", "json", "jsonl", "ndjson", "parquet"):
    query(f"src_01_{_how}", _SUPPLIERS)(_exported(_how))


@query("snk_08_staged_json", _SUPPLIERS)
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put as compressed JSON lines with the batch's marks, and copied in by column name; lines that can't be read are
    left out."""
    path = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    files.put_staged(rows, path, "b7")
    return files.copy_into(rows.limit(0), files.load_staged(spark, path, rows.schema)).select("s_suppkey", "s_name", "s_acctbal")


@query("src_07_hour_partitions", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-10 09:00:00'")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some hours of a table that is laid out by hour; other folders are not read."""
    path = scratch(spark)
    files.write_partitioned(spark.read.parquet(f"{sf_dir}/events.parquet"), path, "ts")
    return files.read_hours(spark, path, "2024-01-10 05:00:00", "2024-01-10 09:00:00").select("event_id")


@query("src_08_schema", "SELECT * FROM (VALUES ('s_acctbal', 'double', TRUE), ('s_name', 'string', FALSE), ('s_suppkey', 'bigint', FALSE)) AS t(field, type, nullable)")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, types and whether nulls occur, of a file of JSON lines."""
    path = scratch(spark)
    files.round_trip(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("s_acctbal")), path, "jsonl")
    return files.detected_schema(files.read_any(spark, path, "jsonl"))


@query("src_14_bound_parameters", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND value >= 90")
def src_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with bound parameters, so that values are never text of the query."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql("SELECT event_id, event_type FROM events WHERE event_type = :kind AND value >= :least", args={"kind": "purchase", "least": 90})


@query("src_16_catalog", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS t(name, type)")
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table as the catalogue has them."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    return spark.createDataFrame([(c.name, c.dataType) for c in spark.catalog.listColumns("nation")], "name string, type string")


@query("snk_02_rows_a_file", "SELECT COUNT(*) AS n, TRUE AS small_files FROM lineitem")
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a bounded number of rows."""
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").write.option("maxRecordsPerFile", 5000).parquet(path)
    back = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return back.agg(F.sum("n").alias("n"), (F.max("n") <= 5000).alias("small_files"))


@query("snk_20_quarantine", "SELECT transaction_id, 'no_merchant_category' AS reason FROM txn WHERE mcc_slot IS NULL")
def snk_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail are written apart, with the reason, and can be read again."""
    path = scratch(spark)
    files.quarantine(view(spark, sf_dir, "txn").select("transaction_id", "mcc_slot"), F.when(F.col("mcc_slot").isNull(), "no_merchant_category"), path)
    return spark.read.parquet(path).select("transaction_id", "reason")


@query("st_12_quarantine_retry", """
    WITH q AS (SELECT transaction_id, transaction_id % 5 AS tries, transaction_id % 2 = 0 AS mended, (transaction_id % 60) AS age FROM txn)
    SELECT transaction_id, CASE WHEN age > 30 THEN 'purged' WHEN tries >= 3 THEN 'discarded' WHEN mended THEN 'released' ELSE 'kept' END AS state, CASE WHEN age <= 30 AND tries < 3 THEN tries + 1 ELSE tries END AS tries FROM q""")
def st_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined rows tried again up to three times, kept thirty days."""
    i = F.col("transaction_id")
    rows = view(spark, sf_dir, "txn").select("transaction_id", (i % 5).alias("tries"), (i % 60 * 86_400_000_000).alias("age_us"), (i % 2 == 0).alias("mended"))
    return files.retried(rows, F.col("mended")).select("transaction_id", "state", "tries")


@query("agg_59_refresh_day", """
    WITH d AS (SELECT * FROM txn WHERE CAST(ts AS DATE) = DATE '2024-01-15')
    SELECT 'channel' AS report, channel AS member, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS total FROM d GROUP BY channel UNION ALL SELECT 'country', country, COUNT(*), CAST(SUM(amount) AS DOUBLE) FROM d GROUP BY country UNION ALL SELECT 'status', status, COUNT(*), CAST(SUM(amount) AS DOUBLE) FROM d GROUP BY status""")
def agg_59(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of a date from one reading of that day."""
    day = view(spark, sf_dir, "txn").filter(F.to_date("ts") == F.lit("2024-01-15").cast("date"))
    members = F.inline(F.array(*[F.struct(F.lit(c).alias("report"), F.col(c).alias("member")) for c in ("channel", "country", "status")]))
    return day.select("amount", members).groupBy("report", "member").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("src_03_json_wrapped", "SELECT n_nationkey, n_name FROM nation")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an array under a key of one JSON object."""
    path = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")  # a fixed small table
    rows.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("transactions"))).alias("value")).write.text(path)
    return files.read_json(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("src_04_json_lines", "SELECT n_nationkey, n_name FROM nation")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines between blank lines."""
    path = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.explode(F.array(F.lit(""), F.to_json(F.struct("n_nationkey", "n_name")), F.lit(""))).alias("value"))
    rows.write.text(path)
    return files.read_lines(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("src_10_decoded_messages", "SELECT event_id, event_type, event_id % 4 AS part FROM events WHERE event_id % 7 <> 0")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages decoded from JSON with their topic's places; those that can't be read are left out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    messages = events.select(F.col("event_id").cast("string").alias("key"), body.cast("binary").alias("value"), F.lit("events").alias("topic"), (F.col("event_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))
    return files.decoded(messages, "event_id long, event_type string").select("event_id", "event_type", F.col("_partition").alias("part"))


@query("snk_19_csv_export", "SELECT COUNT(*) AS n FROM (SELECT 1 FROM supplier LIMIT 50) s")
def snk_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to a cap, as CSV with a header."""
    path = scratch(spark)
    files.export_csv(spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey"), path, 50)
    return files.read_csv(spark, path).agg(F.count("*").alias("n"))
