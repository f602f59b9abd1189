"""Enrichment of transactions: features, places, devices, merchants, velocity and the scoring ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import breach_risk, breaches, miles
from ..sources import reference as ref
from . import frames, standing

#: Month and day of holidays, and hours that are unusual: fixed values.
HOLIDAYS = ((1, 1), (1, 20), (2, 17), (5, 26), (6, 19), (7, 4), (9, 1), (10, 13), (11, 11), (11, 27), (12, 25))
UNUSUAL_HOURS = (0, 1, 2, 3, 4, 5)


def is_holiday(ts: Column) -> Column:
    """Whether the month and day are those of a holiday."""
    return (F.month(ts) * 100 + F.dayofmonth(ts)).isin(*[m * 100 + d for m, d in HOLIDAYS])


def features(txns: DataFrame) -> DataFrame:
    """``transaction_id`` and the twenty features of each transaction, from its customer's earlier ones.

    The profile is the mean and sample deviation of all earlier amounts. Counts and sums look back from the transaction,
    itself left out. Without history: deviation, ratio and time are 0, the percentile is 0.5."""
    prior = frames.prior("customer_id", "us", "transaction_id")
    order = Window.partitionBy("customer_id").orderBy("us", "transaction_id")
    day = frames.history("customer_id", "us", 86_400)
    same = lambda c: Window.partitionBy("customer_id", c).orderBy("us").rangeBetween(-86_400 * frames.SECOND, 0)
    amount, ts = F.col("amount").cast("double"), F.timestamp_micros("us")
    rows = standing.share_not_above(txns, "customer_id", "amount", "us", "transaction_id")
    rows = frames.distinct_counts(rows, "customer_id", "us", {"m24": ("merchant_id", 86_400), "c24": ("country", 86_400)})
    declined = F.col("status") == "declined"
    rows = rows.withColumns({
        "mean": F.avg(amount).over(prior),
        "sd": F.stddev_samp(amount).over(prior),
        "last_us": F.lag("us").over(order),
        "last_channel": F.lag("channel").over(order),
        "soon": F.count("*").over(Window.partitionBy("customer_id").orderBy("us").rangeBetween(-60 * frames.SECOND, -1)),
        "place": F.row_number().over(order),
        "same_m": F.count("*").over(same("merchant_id")),
        "same_c": F.count("*").over(same("country")),
        "met": F.row_number().over(Window.partitionBy("customer_id", "merchant_id").orderBy("us", "transaction_id")) > 1,
        **{f"n_{n}": F.count("*").over(frames.history("customer_id", "us", s)) - 1 for n, s in (("1h", 3600), ("24h", 86_400), ("7d", 604_800))},
        **{f"s_{n}": (F.sum("amount").over(w) - F.col("amount")).cast("double") for n, w in (("1h", frames.history("customer_id", "us", 3600)), ("24h", day))},
    })
    # rows are counted up to the last one that was not declined: what lies between it and now was
    rows = rows.withColumn("ok_place", F.max(F.when(~declined, F.col("place"))).over(prior))
    idle = (F.col("us") - F.col("last_us")) / frames.SECOND
    return rows.select(
        "transaction_id",
        F.round(F.when(F.col("sd") > 0, (amount - F.col("mean")) / F.col("sd")).otherwise(0.0), 6).alias("amount_zscore"),
        F.hour(ts).alias("hour_of_day"),
        F.weekday(ts).alias("day_of_week"),
        (F.weekday(ts) >= 5).alias("is_weekend"),
        is_holiday(ts).alias("is_holiday"),
        F.round(F.coalesce(idle, F.lit(0.0)), 2).alias("time_since_last_transaction"),
        F.round(F.when(F.col("mean") > 0, amount / F.col("mean")).otherwise(0.0), 6).alias("amount_to_avg_ratio"),
        F.col("n_1h").alias("txn_count_1h"),
        F.col("n_24h").alias("txn_count_24h"),
        F.col("n_7d").alias("txn_count_7d"),
        F.round("s_1h", 2).alias("txn_amount_sum_1h"),
        F.round("s_24h", 2).alias("txn_amount_sum_24h"),
        (F.col("m24") - (F.col("same_m") == 1).cast("int")).alias("unique_merchants_24h"),
        (F.col("c24") - (F.col("same_c") == 1).cast("int")).alias("unique_countries_24h"),
        (~F.col("met")).alias("new_merchant_flag"),
        F.hour(ts).isin(*UNUSUAL_HOURS).alias("unusual_hour_flag"),
        F.round(F.coalesce("share", F.lit(0.5)), 6).alias("amount_percentile"),
        F.coalesce(F.col("last_channel") != F.col("channel"), F.lit(False)).alias("channel_switch_flag"),
        (F.col("place") - 1 - F.coalesce("ok_place", F.lit(0))).alias("consecutive_declined_count"),
        (F.col("soon") > 0).alias("rapid_succession_flag"),
    )


#: What features are when nothing is known: fixed values, those that the formulas below fall back on.
FEATURE_DEFAULTS = {"account_avg_amount": 50.0, "account_std_amount": 30.0, "txn_count_1h": 1.0, "new_merchant_flag": 0.0}


def derived_features(rows: DataFrame) -> DataFrame:
    """``rows`` with features of the transaction alone and their products: logarithm, deviations, hour flags, crosses.

    Reads ``amount``, ``us``, ``country`` and, where they are, the names of ``FEATURE_DEFAULTS``."""
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(FEATURE_DEFAULTS[c])) if c in rows.columns else F.lit(FEATURE_DEFAULTS[c])
    amount, mean, sd = F.col("amount").cast("double"), known("account_avg_amount"), known("account_std_amount")
    ts = F.timestamp_micros("us")
    odd = ((F.hour(ts) < 6) | (F.hour(ts) > 23)).cast("double")
    abroad = (F.col("country") != "US").cast("double")
    return rows.withColumns({
        "amount_log": F.log1p(amount),
        "zscore": F.when(sd > 0, (amount - mean) / sd).otherwise(0.0),
        "ratio": F.when(mean > 0, amount / mean).otherwise(1.0),
        "deviation": amount - mean,
        "minutes_since_midnight": (F.hour(ts) * 60 + F.minute(ts)).cast("double"),
        "unusual_hour": odd,
        "amount_x_velocity": amount * known("txn_count_1h"),
        "amount_x_hour_risk": amount * odd,
        "international_x_new_merchant": abroad * known("new_merchant_flag"),
        "high_amount_x_unusual_hour": (amount > mean * 3).cast("double") * odd,
    })


def country_risk(code: Column) -> Column:
    """0.5 for no country, 0.1 for one that isn't listed."""
    return F.when(F.coalesce(code, F.lit("")) == "", 0.5).otherwise(F.coalesce(ref.mapped(ref.COUNTRY_RISK, F.upper(code)), F.lit(0.1)))


def with_place(txns: DataFrame, homes: DataFrame, fastest: float = 500.0) -> DataFrame:
    """``geo_*`` columns: risk of the country, miles from home, speed since the last transaction and whether it is too high.

    ``homes`` has a row for each customer (``customer_id``, ``home_lat``, ``home_lon``); unknown homes give no distance.
    Under 0.001 hours no speed is told. The join is left to Spark, which broadcasts homes only if they are few."""
    order = Window.partitionBy("customer_id").orderBy("us", "transaction_id")
    rows = txns.withColumns({"last_lat": F.lag("lat").over(order), "last_lon": F.lag("lon").over(order), "hours": F.abs(F.col("us") - F.lag("us").over(order)) / 3.6e9})
    rows = rows.join(homes, "customer_id", "left")
    speed = F.when(F.col("hours") >= 0.001, miles(F.col("last_lat"), F.col("last_lon"), F.col("lat"), F.col("lon")) / F.col("hours"))
    risk = country_risk(F.col("country"))
    return rows.withColumns({
        "geo_country_risk": risk,
        "geo_is_high_risk": risk >= 0.7,
        "geo_miles_from_home": miles(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")),
        "geo_mph": speed,
        "geo_impossible_travel": F.coalesce(speed > fastest, F.lit(False)),
    }).drop("last_lat", "last_lon", "hours", "home_lat", "home_lon")


def placed_by_fields(txns: DataFrame) -> DataFrame:
    """``place`` from a transaction's own ``lat``, ``lon``, ``country`` and ``city``: without coordinates there is none."""
    no = F.lit(False)
    there = F.struct(F.coalesce("country", F.lit("")).alias("country_code"), F.coalesce("country", F.lit("")).alias("country_name"), F.coalesce("city", F.lit("")).alias("city"), F.col("lat").cast("double").alias("latitude"), F.col("lon").cast("double").alias("longitude"), no.alias("is_vpn"), no.alias("is_proxy"), no.alias("is_tor"))
    return txns.withColumn("place", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), there))


def with_geo(rows: DataFrame, homes: DataFrame, fastest: float = 500.0) -> DataFrame:
    """The thirteen ``geo_*`` columns of rows with a ``place`` (of ``addresses.located`` or ``placed_by_fields``).

    ``place`` has ``country_code``, ``country_name``, ``city``, ``latitude``, ``longitude``, ``is_vpn``, ``is_proxy`` and
    ``is_tor``; without one there is no risk, distance or speed, and no flag. ``homes`` has one row a customer
    (``customer_id``, ``home_lat``, ``home_lon``). Speed is from the place of the customer's transaction before, if that
    has one; under 0.001 hours no speed is told."""
    order = Window.partitionBy("customer_id").orderBy("us", "transaction_id")
    there, lat, lon = F.col("place").isNotNull(), F.col("place.latitude"), F.col("place.longitude")
    rows = rows.withColumns({"__lat": F.lag(lat).over(order), "__lon": F.lag(lon).over(order), "__hours": F.abs(F.col("us") - F.lag("us").over(order)) / 3.6e9}).join(homes, "customer_id", "left")
    speed = F.when(F.col("__hours") >= 0.001, miles(F.col("__lat"), F.col("__lon"), lat, lon) / F.col("__hours"))
    risk = F.when(there, country_risk(F.col("place.country_code"))).otherwise(0.0)
    return rows.withColumns({
        "geo_country_code": F.col("place.country_code"), "geo_country_name": F.col("place.country_name"), "geo_city": F.col("place.city"), "geo_latitude": lat, "geo_longitude": lon,
        "geo_is_vpn": F.coalesce("place.is_vpn", F.lit(False)), "geo_is_proxy": F.coalesce("place.is_proxy", F.lit(False)), "geo_is_tor": F.coalesce("place.is_tor", F.lit(False)),
        "geo_distance_from_home_miles": miles(F.col("home_lat"), F.col("home_lon"), lat, lon), "geo_country_risk_score": risk, "geo_is_high_risk_country": risk >= 0.7,
        "geo_travel_speed_mph": speed, "geo_is_impossible_travel": F.coalesce(speed > fastest, F.lit(False)),
    }).drop("__lat", "__lon", "__hours", "home_lat", "home_lon", "place")


def with_device(txns: DataFrame, new_days: float = 1.0, many: int = 3) -> DataFrame:
    """``device_*`` columns from the device's earlier transactions; without a device the risk is 0.8 and the rest null.

    Known: the customer used the device before. Trust starts at 0.5 and the n-th transaction adds 0.01 n, up to 1; a device
    never met has 0.3. Risk: unknown 0.3 (or new 0.15), many customers 0.3, 0.2 less trust, at most 1."""
    w = Window.partitionBy("device_id").orderBy("us", "transaction_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pair = Window.partitionBy("device_id", "customer_id").orderBy("us", "transaction_id")
    rows = txns.repartition("device_id").withColumn("__first", F.row_number().over(pair) == 1)
    rows = rows.withColumns({"__n": F.count("*").over(before), "__since": F.min("us").over(before), "device_accounts": F.count(F.when(F.col("__first"), 1)).over(before)})
    there, age = F.col("device_id").isNotNull(), (F.col("us") - F.col("__since")) / (86_400 * frames.SECOND)
    trust = F.when(F.col("__n") == 0, 0.3).otherwise(F.least(F.lit(1.0), 0.5 + 0.01 * (F.col("__n") * (F.col("__n") + 1) / 2 - 1)))
    known, new, shared = ~F.col("__first"), F.coalesce(age < new_days, F.lit(True)), F.col("device_accounts") >= many
    risk = F.when(~known, 0.3).when(new, 0.15).otherwise(0.0) + F.when(shared, 0.3).otherwise(0.0) + F.greatest(F.lit(0.0), 0.2 * (1 - trust))
    return rows.withColumns({
        "device_is_known": F.when(there, known),
        "device_is_new": F.when(there, new),
        "device_age_days": F.when(there, F.coalesce(age, F.lit(0.0))),
        "device_accounts": F.when(there, F.col("device_accounts")),
        "device_is_shared": F.when(there, shared),
        "device_trust": F.when(there, trust),
        "device_risk": F.when(there, F.least(F.lit(1.0), risk)).otherwise(0.8),
    }).drop("__first", "__n", "__since")


def mcc_risk(code: Column) -> Column:
    """By code, else by its first two digits, else 0.3; 0.5 for none."""
    return F.when(F.coalesce(code, F.lit("")) == "", 0.5).otherwise(F.coalesce(ref.mapped(ref.MCC_RISK, code), ref.mapped(ref.MCC_RISK, F.concat(F.left(code, F.lit(2)), F.lit("xx"))), F.lit(0.3)))


def with_merchant(txns: DataFrame, frauds: Column, new_days: float = 30.0, high_rate: float = 0.05) -> DataFrame:
    """``merchant_*`` columns from the merchant's earlier transactions; ``frauds`` is true for those known to be fraud.

    Risk: 0.4 of the category's, 0.3 of the fraud rate (a fifth counts as all), 0.12 for new merchants, 0.1 without a
    category; 0.5 without a merchant, and then the rest is null."""
    before = frames.prior("merchant_id", "us", "transaction_id")
    rows = txns.withColumns({"__n": F.count("*").over(before), "__frauds": F.count(F.when(frauds, 1)).over(before), "__since": F.min("us").over(before)})
    there, age = F.col("merchant_id").isNotNull(), (F.col("us") - F.col("__since")) / (86_400 * frames.SECOND)
    rate, new, category = F.coalesce(F.try_divide("__frauds", "__n"), F.lit(0.0)), F.coalesce(age < new_days, F.lit(True)), mcc_risk(F.col("mcc"))
    risk = 0.4 * category + 0.3 * F.least(F.lit(1.0), rate / 0.2) + F.when(new, 0.12).otherwise(0.0) + F.when(F.coalesce(F.col("mcc"), F.lit("")) == "", 0.1).otherwise(0.0)
    return rows.withColumns({
        "merchant_mcc_risk": F.when(there, category),
        "merchant_fraud_rate": F.when(there, rate),
        "merchant_is_high_fraud": F.when(there, rate >= high_rate),
        "merchant_age_days": F.when(there, F.coalesce(age, F.lit(0.0))),
        "merchant_is_new": F.when(there, new),
        "merchant_risk": F.when(there, F.least(F.lit(1.0), risk)).otherwise(0.5),
    }).drop("__n", "__frauds", "__since")


def with_velocity(txns: DataFrame) -> DataFrame:
    """The customer's velocity, the mean and largest amount of the hour (the row included), ``velocity_breaches`` and
    ``velocity_risk``."""
    hour = frames.history("customer_id", "us", 3600)
    rows = frames.velocity(txns).withColumns({"mean_1h": F.avg("amount").over(hour).cast("double"), "largest_1h": F.max("amount").over(hour).cast("double")}).withColumn("velocity_breaches", breaches())
    return rows.withColumn("velocity_risk", breach_risk(F.col("velocity_breaches")))


#: Kinds of devices; any other is unknown: fixed values.
DEVICE_TYPES = ("mobile", "desktop", "tablet", "pos", "atm")


def with_device_details(rows: DataFrame) -> DataFrame:
    """``with_device``'s rows with the device's kind, fingerprint, systems and flags, and ``device_risk`` raised by 0.2 for
    emulators and 0.1 for rooted devices, at most 1.

    Reads ``device_type``, ``user_agent``, ``screen_resolution``, ``timezone_offset``, ``os_family``, ``browser_family``, ``is_emulator`` and
    ``is_rooted``. The fingerprint is 16 digits of a sha256 over the first four and the id, missing ones empty. Without a
    device the flags are false and the risk stays."""
    there, kind = F.col("device_id").isNotNull(), F.lower("device_type")
    known = F.when(there & F.coalesce(kind.isin(*DEVICE_TYPES), F.lit(False)), kind).otherwise("unknown")
    rows = rows.withColumn("device_type", known)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("device_id", "device_type", "user_agent", "screen_resolution", "timezone_offset")]
    flag = lambda c: there & F.coalesce(F.col(c), F.lit(False))
    more = F.when(flag("is_emulator"), 0.2).otherwise(0.0) + F.when(flag("is_rooted"), 0.1).otherwise(0.0)
    return rows.withColumns({
        "device_fingerprint_hash": F.when(there, F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))),
        "device_os_family": F.when(there, F.coalesce("os_family", F.lit("unknown"))), "device_browser_family": F.when(there, F.coalesce("browser_family", F.lit("unknown"))),
        "device_is_emulator": flag("is_emulator"), "device_is_rooted": flag("is_rooted"), "device_risk": F.least(F.lit(1.0), F.col("device_risk") + more),
    })


#: Weights of rules, anomaly and model; least confidence of a model and what a lesser one leaves of its weight: fixed values.
WEIGHTS = {"rule_engine": 0.3, "anomaly_detector": 0.3, "ml_model": 0.4}
MIN_CONFIDENCE, PENALTY = 0.5, 0.5
#: Cuts of the classes: fixed values.
CUTS = {"online": {"critical": 0.85, "high": 0.6, "medium": 0.3}, "model": {"critical": 0.95, "high": 0.8, "medium": 0.5}, "batch": {"critical": 0.95, "high": 0.8, "medium": 0.5}, "service": {"critical": 0.95, "high": 0.8, "medium": 0.5, "low": 0.3}}


def classified(score: Column, cuts: str = "online") -> Column:
    """The class of a score: the first cut that it reaches, else the lowest class (``minimal`` for the service's)."""
    out = None
    for name, cut in CUTS[cuts].items():
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise("minimal" if "low" in CUTS[cuts] else "low")


def method_results(rules: Column, anomaly: Column, model: Column, confidence: Column) -> Column:
    """An array of each method's ``raw``, ``normalised`` and ``weighted`` score, ``weight`` and ``success``.

    Null stands for a method that failed. An anomaly detector's raw score runs from 1 (usual) to -1; a model that isn't
    sure enough counts for less."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    weight = F.when(confidence < MIN_CONFIDENCE, WEIGHTS["ml_model"] * PENALTY).otherwise(WEIGHTS["ml_model"])
    parts = (("rule_engine", rules, clip(rules), F.lit(WEIGHTS["rule_engine"])), ("anomaly_detector", anomaly, clip((1 - anomaly) / 2), F.lit(WEIGHTS["anomaly_detector"])), ("ml_model", model, clip(model), weight))
    one = lambda name, raw, value, w: F.struct(F.lit(name).alias("method"), F.coalesce(raw, F.lit(0.0)).alias("raw"), F.when(raw.isNotNull(), value).otherwise(0.0).alias("normalised"), w.cast("double").alias("weight"), F.when(raw.isNotNull(), value * w).otherwise(0.0).alias("weighted"), raw.isNotNull().alias("success"))
    return F.array(*[one(*p) for p in parts])


def final_score(methods: Column) -> Column:
    """The mean of the methods that worked, by their weights; 0 if none did."""
    total = lambda of: F.aggregate(methods, F.lit(0.0), lambda a, x: a + F.when(x["success"], of(x)).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(total(lambda x: x["normalised"] * x["weight"]), total(lambda x: x["weight"])), F.lit(0.0))))


def batch_score(rules: Column, anomaly: Column, model: Column) -> Column:
    """The batch job's fixed weights, missing scores as 0, to 6 places."""
    zero = F.lit(0.0)
    return F.round(0.30 * F.coalesce(rules, zero) + 0.25 * F.coalesce(anomaly, zero) + 0.45 * F.coalesce(model, zero), 6)


def feature_quality(missing: Column, stale: Column, total: int) -> Column:
    """``good``, ``degraded`` or ``poor`` by the share of missing features and half the share of stale ones."""
    worse = (missing + stale * 0.5) / max(total, 1)
    return F.when(worse > 0.3, "poor").when(worse > 0.1, "degraded").otherwise("good")


def confidence(score: Column, quality: Column) -> Column:
    """Twice the distance from a half, less for worse features."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(score - 0.5) * 2 * F.when(quality == "good", 1.0).when(quality == "degraded", 0.8).when(quality == "poor", 0.5).otherwise(0.7)))
