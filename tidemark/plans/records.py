"""Queries over raw records: validation of formats, cleaning, filling, normalising, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clean, validate
from ..sources import reference as ref
from ..sources.views import view
from .derived import query

_TIMES = ["'2024-01-02T03:04:05Z'", "'2024-01-02T03:04:05Z'", "'2024-01-02T01:04:05Z'", "'2024-03-04T00:00:00Z'", "'2024-04-25T10:11:12Z'", "'1970-08-23T06:15:02Z'", "'2024-01-02T03:04:05Z'", "'2024-01-02T03:04:05Z'", "NULL", "NULL", "'2024-04-05T00:00:00Z'", "'2024-01-01T21:34:05Z'"]
_ISO = "CASE m % 12 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_TIMES)) + " END"


def _table(table: dict[str, object]) -> str:
    """A table as a literal map of the oracle."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE"
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


@query("fn_d01_timestamps", f"SELECT transaction_id, {_ISO} AS iso FROM raw_txn")
def fn_d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in many spellings, month first, digits as epochs, in UTC."""
    return view(spark, sf_dir, "raw_txn").select("transaction_id", F.date_format(text.timestamp(F.col("transaction_timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("stg_03_clean", f"""
    SELECT transaction_id, transaction_id % 20 = 19 AS is_duplicate,
      CASE WHEN transaction_id % 20 = 19 THEN merchant_name ELSE CASE m % 3 WHEN 0 THEN 'Big Shop' WHEN 1 THEN 'Plain' ELSE 'Tab andbell' END END AS merchant_name,
      CASE WHEN transaction_id % 20 = 19 THEN transaction_currency ELSE CASE m % 8 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUROS' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' WHEN 4 THEN 'USD' WHEN 5 THEN 'XYZ' WHEN 6 THEN 'STERLING' ELSE 'USD' END END AS currency,
      CASE WHEN transaction_id % 20 = 19 THEN channel ELSE CASE m % 7 WHEN 0 THEN 'web' WHEN 1 THEN ' pos' WHEN 2 THEN 'in_store' WHEN 3 THEN 'fax' WHEN 4 THEN 'online' WHEN 5 THEN 'online' ELSE 'atm' END END AS channel,
      CASE WHEN transaction_id % 20 = 19 THEN transaction_timestamp ELSE COALESCE({_ISO}, transaction_timestamp) END AS ts,
      CASE WHEN transaction_id % 20 = 19 THEN transaction_amount ELSE CASE m % 6 WHEN 0 THEN '12.5' WHEN 1 THEN '1234.56' WHEN 2 THEN '12.5' WHEN 3 THEN '1234.5' WHEN 4 THEN 'abc' ELSE '99.0' END END AS amount,
      CASE WHEN transaction_id % 20 = 19 THEN geo_latitude ELSE CASE m % 4 WHEN 0 THEN NULL WHEN 1 THEN -90e0 WHEN 2 THEN 12.5e0 END END AS latitude
    FROM raw_txn""")
def stg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cleaned step by step; duplicates are told and left as they are."""
    rows = clean.cleaned(view(spark, sf_dir, "raw_txn").drop("m", "amount"), ["transaction_id"])
    return rows.select("transaction_id", "is_duplicate", "merchant_name", F.col("transaction_currency").alias("currency"), "channel", F.col("transaction_timestamp").alias("ts"), F.col("transaction_amount").alias("amount"), F.col("geo_latitude").alias("latitude"))


@query("stg_04_impute", "SELECT transaction_id, CASE WHEN m % 8 = 4 THEN 'USD' ELSE transaction_currency END AS currency, CASE WHEN m % 7 IN (4, 5) THEN 'online' ELSE channel END AS channel, FALSE AS is_international FROM raw_txn")
def stg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and blank fields filled."""
    rows = view(spark, sf_dir, "raw_txn").withColumn("is_international", F.lit(None).cast("boolean"))
    return rows.select("transaction_id", *[clean.imputed(F.col(c), clean.DEFAULTS[c]).alias(n) for c, n in (("transaction_currency", "currency"), ("channel", "channel"), ("is_international", "is_international"))])


def _canonical(c: str, table: dict[str, str]) -> str:
    return f"CASE WHEN {_table(table)}[lower(trim({c}))] <> lower(trim({c})) THEN {_table(table)}[lower(trim({c}))] ELSE {c} END"


@query("stg_05_normalise", f"""
    WITH n AS (SELECT *, COALESCE({_table(ref.CURRENCY_ALIASES)}[lower(trim(transaction_currency))], upper(trim(transaction_currency))) AS code FROM raw_txn)
    SELECT transaction_id, code AS currency, ROUND(CASE WHEN COALESCE(code, 'USD') = 'USD' THEN CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) * {_table(ref.RATES)}[code] END, 4) AS usd,
      COALESCE({_table(ref.COUNTRY_ALIASES)}[lower(trim(geo_country))], CASE WHEN regexp_full_match(trim(geo_country), '[A-Za-z]{{2}}') THEN upper(trim(geo_country)) END, geo_country) AS country,
      COALESCE({_table(ref.MCC_NAMES)}[trim(mcc)], CASE WHEN regexp_full_match(trim(mcc), '3[0-9]{{3}}') THEN {_table(ref.MCC_NAMES)}['3000'] END) AS mcc_category,
      {_canonical("transaction_type", ref.TYPE_ALIASES)} AS type, {_canonical("channel", ref.CHANNEL_ALIASES)} AS channel, {_canonical("card_type", ref.CARD_ALIASES)} AS card FROM n""")
def stg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes, dollars and categories."""
    rows = clean.normalised(view(spark, sf_dir, "raw_txn").withColumns({"transaction_amount": F.col("amount"), "merchant_category_code": F.col("mcc")}))
    return rows.select("transaction_id", F.col("transaction_currency").alias("currency"), F.col("transaction_amount_usd").alias("usd"), F.col("geo_country").alias("country"), "mcc_category", F.col("transaction_type").alias("type"), "channel", F.col("card_type").alias("card"))


@query("fn_m02_convert", f"SELECT transaction_id, code, ROUND(CASE WHEN code = 'EUR' THEN CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) * {_table(ref.RATES)}[code] / 1.084e0 END, 4) AS euros FROM (SELECT transaction_id, amount, CASE transaction_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' ELSE 'ZZZ' END AS code FROM raw_txn) r")
def fn_m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts across two rates."""
    code = F.element_at(F.array(*map(F.lit, ("USD", "EUR", "JPY", "ZZZ"))), (F.col("transaction_id") % 4 + 1).cast("int"))
    return view(spark, sf_dir, "raw_txn").select("transaction_id", code.alias("code"), clean.in_dollars(F.col("amount"), code, "EUR").alias("euros"))


@query("fn_m06_within", "SELECT transaction_id, CASE WHEN geo_latitude BETWEEN -90 AND 90 THEN geo_latitude END AS latitude, CASE WHEN m % 5 = 0 THEN NULL ELSE CAST(m % 180 AS DOUBLE) END AS longitude FROM raw_txn")
def fn_m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates out of range, or no numbers, become null."""
    text_ = F.when(F.col("m") % 10 == 0, "east").when(F.col("m") % 5 == 0, "180.5").otherwise((F.col("m") % 180).cast("string"))
    return view(spark, sf_dir, "raw_txn").select("transaction_id", clean.within(F.col("geo_latitude"), 90).alias("latitude"), clean.within(text_, 180).alias("longitude"))


@query("fn_s05_masks", """
    SELECT transaction_id, 'u***@mail.example' AS email, CASE WHEN transaction_id % 2 = 0 THEN '************' || right(CAST(10000 + transaction_id % 9000 AS VARCHAR), 4) ELSE '***MASKED***' END AS card, '10.0.' || CAST(transaction_id % 200 AS VARCHAR) || '.***' AS ip,
      CASE WHEN length('dev' || CAST(device_id AS VARCHAR)) > 8 THEN left('dev' || CAST(device_id AS VARCHAR), 4) || '***' || right('dev' || CAST(device_id AS VARCHAR), 4) ELSE '***MASKED***' END AS device, CASE WHEN transaction_id % 3 = 0 THEN '***' ELSE '***MASKED***' END AS name FROM txn""")
def fn_s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal fields masked by name."""
    i = F.col("transaction_id")
    number = F.when(i % 2 == 0, F.concat(F.lit("411111111111"), F.right((10000 + i % 9000).cast("string"), F.lit(4)))).otherwise("12")
    values = {"email": F.concat(F.lit("user"), i.cast("string"), F.lit("@mail.example")), "card_number": number, "ip_address": F.concat(F.lit("10.0."), (i % 200).cast("string"), F.lit(".7")), "device_id": F.concat(F.lit("dev"), F.col("device_id").cast("string")), "full_name": F.when(i % 3 != 0, "Jo Doe")}
    short = {"email": "email", "card_number": "card", "ip_address": "ip", "device_id": "device", "full_name": "name"}
    return view(spark, sf_dir, "txn").select("transaction_id", *[clean.masked(k, v).alias(short[k]) for k, v in values.items()])


@query("fn_s10_scrub", "SELECT transaction_id, 'mail ***REDACTED_EMAIL*** ssn ***REDACTED_SSN*** card ***REDACTED_CARD*** call (***REDACTED_PHONE*** id ' || CAST(transaction_id AS VARCHAR) AS line FROM txn")
def fn_s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data blacked out in log lines."""
    i = F.col("transaction_id").cast("string")
    line = F.concat(F.lit("mail a.b"), i, F.lit("@Mail.example ssn 123-45-6789 card 4111 1111 1111 1111 call (555) 123-4567 id "), i)
    return view(spark, sf_dir, "txn").select("transaction_id", clean.scrubbed(line).alias("line"))


@query("flt_04_formats", """
    SELECT transaction_id, m % 3 <> 0 AS bad_number, m % 2 <> 0 AS bad_boolean, m % 5 IN (2, 4) AS bad_ip, m % 12 IN (3, 4, 6, 7, 8, 10) AS bad_iso FROM raw_txn""")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inside a variant, addresses of both versions and ISO times."""
    m = F.col("m")
    body = F.concat(F.lit('{"n": '), F.when(m % 3 == 0, "12.5").when(m % 3 == 1, "true").otherwise('"12"'), F.lit(', "b": '), F.when(m % 2 == 0, "false").otherwise("0"), F.lit("}"))
    ip = F.element_at(F.array(*map(F.lit, ("192.168.0.255", "2001:db8::8a2e:370:7334", "256.1.1.1", "::ffff:10.0.0.1", "1::2::3"))), (m % 5 + 1).cast("int"))
    v = F.parse_json(body)
    rows = view(spark, sf_dir, "raw_txn").select("transaction_id", validate.not_number(v, "$.n").alias("bad_number"), validate.not_boolean(v, "$.b").alias("bad_boolean"), validate.not_ip(ip).alias("bad_ip"), validate.not_iso(F.col("transaction_timestamp")).alias("bad_iso"))
    return rows


@query("flt_19_required", "SELECT transaction_id FROM raw_txn WHERE transaction_currency IS NOT NULL AND geo_country IS NOT NULL")
def flt_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all required fields."""
    return view(spark, sf_dir, "raw_txn").dropna(subset=["transaction_currency", "geo_country"]).select("transaction_id")


@query("prj_03_public_columns", "SELECT transaction_id, transaction_currency, geo_country FROM raw_txn")
def prj_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal columns, by prefix, left out before rows are kept."""
    rows = view(spark, sf_dir, "raw_txn").select("transaction_id", "transaction_currency", "geo_country", F.lit(1).alias("_batch"), F.lit(2).alias("_topic"))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


@query("prj_06_coerced", "SELECT transaction_id, COALESCE(transaction_currency, 'USD') AS currency, TRY_CAST(transaction_amount AS DOUBLE) AS amount, CASE WHEN channel IN ('in_store', 'fax', 'atm') THEN channel END AS channel FROM raw_txn")
def prj_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields cast to a schema with defaults; values outside an enumeration become null."""
    fields = {"transaction_currency": ("string", "USD", None), "transaction_amount": ("double", None, None), "channel": ("string", None, ("in_store", "fax", "atm"))}
    rows = validate.coerced(view(spark, sf_dir, "raw_txn").select("transaction_id", *fields), fields)
    return rows.select("transaction_id", F.col("transaction_currency").alias("currency"), F.col("transaction_amount").alias("amount"), "channel")


@query("flt_36_batch_gate", "SELECT 'ok' AS verdict, CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) FILTER (WHERE transaction_amount = 'abc') AS failed FROM raw_txn")
def flt_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch passes with a given share of good rows; below it, the job fails."""
    rows = view(spark, sf_dir, "raw_txn").withColumn("good", clean.amount(F.col("transaction_amount")).isNotNull())
    return validate.gated(rows, F.col("good"), 0.8)


@query("st_16_dead_letters", "SELECT transaction_id, CASE WHEN m % 6 IN (0, 1, 2, 3, 5) THEN 'amount' ELSE 'none' END AS failed_stage, CASE WHEN m % 6 IN (0, 1, 2, 3, 5) THEN 'skip' END AS policy FROM raw_txn WHERE m % 6 IN (0, 1, 2, 3, 5) AND TRY_CAST(transaction_amount AS DOUBLE) IS NULL UNION ALL SELECT transaction_id, 'amount', 'skip' FROM raw_txn WHERE m % 6 = 4")
def st_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail a stage whose policy is to skip, with the stage; a stage whose policy is to halt raises."""
    rows = view(spark, sf_dir, "raw_txn")
    _, dead = validate.routed(rows, {"amount": (F.col("transaction_amount").try_cast("double").isNull(), "skip"), "id": (F.col("transaction_id").isNull(), "halt")})
    return dead.select("transaction_id", "failed_stage", "policy")


@query("fn_s01_composed", "SELECT transaction_id, CASE WHEN m % 2 = 0 THEN chr(233) || 't' || chr(233) ELSE 'a' || chr(9) || 'b' END AS s FROM raw_txn")
def fn_s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed letters, without control characters but for tabs and line ends."""
    raw = F.when(F.col("m") % 2 == 0, F.lit("e\u0301te\u0301\x00")).otherwise(F.lit("a\t\x07b\x7f"))
    return view(spark, sf_dir, "raw_txn").select("transaction_id", text.no_controls(text.nfc(raw)).alias("s"))


@query("fn_s07_fingerprint", "SELECT transaction_id, left(sha256('dev' || CAST(m AS VARCHAR) || '|' || CASE WHEN m % 2 = 0 THEN 'mobile' ELSE 'unknown' END || '|||'), 16) AS fingerprint, 'ANON-' || upper(left(sha256('acc' || CAST(m % 50 AS VARCHAR)), 12)) AS anonymous FROM raw_txn")
def fn_s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's fingerprint over what is known of it, and an account's stand-in."""
    kind = F.when(F.col("m") % 2 == 0, "Mobile").otherwise("toaster")
    device = F.concat(F.lit("dev"), F.col("m").cast("string"))
    return view(spark, sf_dir, "raw_txn").select("transaction_id", text.fingerprint(device, text.device_type(kind), F.lit(""), F.lit(""), F.lit("")).alias("fingerprint"), text.anonymous(F.col("account_id")).alias("anonymous"))


@query("flt_16_custom_rules", "SELECT transaction_id, amount > 1000 AND amount = FLOOR(amount) AS round_amount, amount > 5000 AS high_value, channel = 'pos' AND merchant_id % 10 = 0 AS no_merchant FROM risk_txn")
def flt_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings for round and for high amounts and for shops without a merchant; the high value is lowered to the data."""
    rows = view(spark, sf_dir, "risk_txn").withColumn("merchant_id", F.when(F.col("merchant_id") % 10 != 0, F.col("merchant_id")))
    found = validate.validated(rows, {}, validate.transaction_rules(F.lit(1 << 60), round_over=1000, high_value=5000))
    has = lambda rule: F.exists("issues", lambda x: x["rule"] == rule)
    return found.select("transaction_id", has("round_amount").alias("round_amount"), has("high_value").alias("high_value"), has("pos_needs_merchant").alias("no_merchant"))


@query("prj_05_event_defaults", "SELECT transaction_id, CASE WHEN m % 2 = 0 THEN '2.0' ELSE '1.0.0' END AS event_version, TRUE AS has_id FROM raw_txn")
def prj_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's id, time and version where they are missing."""
    rows = view(spark, sf_dir, "raw_txn").withColumns({"event_id": F.lit(None).cast("string"), "event_version": F.when(F.col("m") % 2 == 0, "2.0")})
    out = rows.withColumns({"event_id": F.coalesce("event_id", F.uuid()), "event_version": F.coalesce("event_version", F.lit("1.0.0"))})
    return out.select("transaction_id", "event_version", F.col("event_id").isNotNull().alias("has_id"))


_CROSS = {
    "international_flag_matches_country": "geo_country IS NOT NULL AND geo_country <> 'USA' AND transaction_id % 2 = 1",
    "card_last_four_required_for_card_transactions": "card_type IS NOT NULL AND transaction_id % 3 = 0",
    "ip_required_for_online": "channel2 = 'online' AND transaction_id % 5 = 0",
    "geo_coordinates_paired": "(geo_latitude IS NULL) <> (transaction_id % 4 = 1)",
    "pos_requires_merchant": "channel2 = 'pos' AND transaction_id % 7 = 0",
    "atm_no_merchant_category": "channel2 = 'atm' AND transaction_id % 6 <> 2",
    "refund_amount_limit": "transaction_id % 6 = 0 AND amount * 1000 > 50000",
    "future_timestamp_check": "transaction_id % 100 > 90",
    "stale_timestamp_check": "transaction_id % 100 < 5",
}
_ERRORS = ("geo_coordinates_paired", "refund_amount_limit", "future_timestamp_check", "stale_timestamp_check")


@query("flt_07_cross_fields", "WITH r AS (SELECT *, CASE transaction_id % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'pos' ELSE 'atm' END AS channel2 FROM raw_txn), c AS (SELECT transaction_id, " + ", ".join(f"COALESCE({t}, FALSE) AS {n}" for n, t in _CROSS.items()) + " FROM r) SELECT transaction_id, NOT (" + " OR ".join(_ERRORS) + ") AS is_valid, concat_ws(',', " + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in _CROSS) + ") AS broken FROM c")
def flt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across the fields of a record; warnings leave it valid."""
    i = F.col("transaction_id")
    now = 1_706_745_600_000_000
    us = F.when(i % 100 > 90, now + 300_000_001).when(i % 100 < 5, now - 90 * 86_400_000_000 - 1).otherwise(F.when(i % 2 == 0, now + 300_000_000).otherwise(now - 90 * 86_400_000_000))
    rows = view(spark, sf_dir, "raw_txn").withColumns({"is_international": F.when(i % 2 == 0, True).when(i % 4 == 1, False), "card_last_four": F.when(i % 3 != 0, "1234"), "ip_address": F.when(i % 5 != 0, "10.0.0.1"), "geo_longitude": F.when(i % 4 != 1, 1.0), "merchant_id": F.when(i % 7 != 0, "m"), "channel": F.element_at(F.array(*map(F.lit, ("online", "pos", "atm"))), (i % 3 + 1).cast("int")), "transaction_type": F.when(i % 6 == 0, "refund").when(i % 6 == 2, "withdrawal"), "transaction_amount": F.col("amount") * 1000, "us": us})
    found = validate.validated(rows, {}, validate.cross_field_rules(F.lit(now)))
    return found.select("transaction_id", "is_valid", F.array_join(F.transform("issues", lambda x: x["rule"]), ",").alias("broken"))
