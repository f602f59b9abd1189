"""Queries of places, devices and velocity: addresses looked up among networks, and what stages add to transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import addresses, enrich
from ..sources import reference as ref
from ..sources.views import spark_sql, view
from .derived import _LEVELS, _MILES, _R, _SPANS, DERIVED, query
from .records import _table
from .scoring import _ARC, _P

_PLACE = ("country_code", "country_name", "city", "latitude", "longitude", "is_vpn", "is_proxy", "is_tor")

_FOUND = """
    kept AS (SELECT * FROM (SELECT n.*, ROW_NUMBER() OVER (PARTITION BY family, lo, length ORDER BY net_key) AS copy FROM network n) x WHERE copy = 1),
    pairs AS (SELECT a.transaction_id, n.*, ROW_NUMBER() OVER (PARTITION BY a.transaction_id ORDER BY n.length DESC) AS r FROM addressed a JOIN kept n ON n.family = a.family AND a.num BETWEEN n.lo AND n.hi),
    found AS (SELECT * FROM pairs WHERE r = 1)"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    networks = view(spark, sf_dir, "network").select("network", "net_key", *_PLACE)
    return addresses.located(view(spark, sf_dir, "addressed").drop("family", "num"), networks)


@query("udf_02_address_lookup", f"WITH {_FOUND} SELECT a.transaction_id, f.net_key, f.city, f.country_code, f.is_vpn, f.is_proxy, f.is_tor FROM addressed a LEFT JOIN found f USING (transaction_id)")
def udf_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest network that holds each transaction's address."""
    return _located(spark, sf_dir).select("transaction_id", *[F.col(f"place.{c}").alias(c) for c in ("net_key", "city", "country_code", "is_vpn", "is_proxy", "is_tor")])


_GEO = f"""
    home AS (SELECT customer_id, CASE WHEN customer_id % 2 = 0 THEN CAST(customer_id % 50 AS DOUBLE) END AS hlat, CASE WHEN customer_id % 2 = 0 THEN CAST(customer_id % 120 AS DOUBLE) END AS hlon, transaction_id, us, @columns FROM @source),
    t AS (SELECT h.*, LAG(latitude) OVER o AS lat0, LAG(longitude) OVER o AS lon0, ABS(us - LAG(us) OVER o) / 3.6e9 AS hours FROM home h WINDOW o AS ({_P})),
    d AS (SELECT t.*, CASE WHEN latitude IS NULL THEN 0e0 WHEN country_code = '' THEN 0.5e0 ELSE COALESCE({_table(ref.COUNTRY_RISK)}[country_code], 0.1e0) END AS risk, {_ARC.format("hlat", "hlon", "latitude", "longitude")} AS a1, {_ARC.format("lat0", "lon0", "latitude", "longitude")} AS a2 FROM t),
    e AS (SELECT d.*, {_MILES.replace("(a)", "(a1)").replace("1 - a", "1 - a1")} AS home_miles, CASE WHEN hours >= 0.001 THEN {_MILES.replace("(a)", "(a2)").replace("1 - a", "1 - a2")} / hours END AS mph FROM d)
    SELECT transaction_id, country_code AS geo_country_code, country_name AS geo_country_name, city AS geo_city, latitude AS geo_latitude, longitude AS geo_longitude, COALESCE(is_vpn, FALSE) AS geo_is_vpn, COALESCE(is_proxy, FALSE) AS geo_is_proxy, COALESCE(is_tor, FALSE) AS geo_is_tor,
      ROUND(home_miles, 4) AS geo_distance_from_home_miles, risk AS geo_country_risk_score, risk >= 0.7e0 AS geo_is_high_risk_country, ROUND(mph, 3) AS geo_travel_speed_mph, COALESCE(mph > 500, FALSE) AS geo_is_impossible_travel FROM e"""


def _geo(rows: DataFrame) -> DataFrame:
    homes = rows.select("customer_id").distinct().filter("customer_id % 2 = 0").select("customer_id", (F.col("customer_id") % 50).cast("double").alias("home_lat"), (F.col("customer_id") % 120).cast("double").alias("home_lon"))
    out = enrich.with_geo(rows, homes)
    rounded = {"geo_distance_from_home_miles": 4, "geo_travel_speed_mph": 3}
    return out.select("transaction_id", *[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in out.columns if c.startswith("geo_")])


@query("stg_07_geo_by_address", f"WITH {_FOUND}, joined AS (SELECT a.transaction_id, a.customer_id, a.us, f.* EXCLUDE (transaction_id) FROM addressed a LEFT JOIN found f USING (transaction_id))," + _GEO.replace("@columns", ", ".join(_PLACE)).replace("@source", "joined"))
def stg_07_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen columns of a transaction's place, by its address."""
    return _geo(_located(spark, sf_dir))


@query("stg_07_geo_by_fields", "WITH fields AS (SELECT transaction_id, customer_id, us, CASE WHEN transaction_id % 9 = 0 THEN NULL ELSE lat END AS latitude, CASE WHEN transaction_id % 9 = 0 THEN NULL ELSE lon END AS longitude, CASE WHEN transaction_id % 9 <> 0 THEN CASE WHEN transaction_id % 14 = 0 THEN '' ELSE country END END AS country_code, CASE WHEN transaction_id % 9 <> 0 THEN CASE WHEN transaction_id % 14 = 0 THEN '' ELSE country END END AS country_name, CASE WHEN transaction_id % 9 <> 0 THEN CASE WHEN merchant_id % 2 = 0 THEN 'town' ELSE '' END END AS city, FALSE AS is_vpn, FALSE AS is_proxy, FALSE AS is_tor FROM txn)," + _GEO.replace("@columns", ", ".join(_PLACE)).replace("@source", "fields"))
def stg_07_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a transaction's own fields, where no networks are known."""
    i = F.col("transaction_id")
    txns = view(spark, sf_dir, "txn").withColumns({"lat": F.when(i % 9 != 0, F.col("lat")), "country": F.when(i % 14 != 0, F.col("country")), "city": F.when(F.col("merchant_id") % 2 == 0, "town")})
    return _geo(enrich.placed_by_fields(txns))


_DEVICE = """SELECT transaction_id, CASE WHEN transaction_id % 31 <> 0 THEN device_id END AS device_id, CASE transaction_id % 6 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'desktop' WHEN 2 THEN 'TABLET' WHEN 3 THEN 'watch' WHEN 4 THEN NULL ELSE 'atm' END AS device_type,
  CASE WHEN transaction_id % 4 > 0 THEN 'agent ' || CAST(customer_id % 5 AS VARCHAR(9)) END AS user_agent, CASE WHEN transaction_id % 3 > 0 THEN '1920x1080' END AS screen_resolution, CASE WHEN transaction_id % 5 > 0 THEN CAST(customer_id % 24 AS VARCHAR(9)) END AS timezone_offset,
  CASE WHEN transaction_id % 2 = 0 THEN 'ios' END AS os_family, CASE WHEN transaction_id % 7 > 2 THEN 'safari' END AS browser_family, CASE WHEN transaction_id % 9 > 0 THEN transaction_id % 8 = 1 END AS is_emulator, transaction_id % 11 = 3 AS is_rooted FROM risk_txn"""


@query("stg_08_device_details", f"""
    WITH base AS ({DERIVED["stg_08_device"][1]}), raw AS ({_DEVICE}), kinds AS (SELECT *, CASE WHEN device_id IS NOT NULL AND LOWER(device_type) IN ('mobile', 'desktop', 'tablet', 'pos', 'atm') THEN LOWER(device_type) ELSE 'unknown' END AS kind FROM raw)
    SELECT transaction_id, kind AS device_type, CASE WHEN device_id IS NOT NULL THEN left(sha256(CAST(device_id AS VARCHAR) || '|' || kind || '|' || COALESCE(user_agent, '') || '|' || COALESCE(screen_resolution, '') || '|' || COALESCE(timezone_offset, '')), 16) END AS device_fingerprint_hash,
      CASE WHEN device_id IS NOT NULL THEN COALESCE(os_family, 'unknown') END AS device_os_family, CASE WHEN device_id IS NOT NULL THEN COALESCE(browser_family, 'unknown') END AS device_browser_family, device_id IS NOT NULL AND COALESCE(is_emulator, FALSE) AS device_is_emulator, device_id IS NOT NULL AND is_rooted AS device_is_rooted,
      ROUND(LEAST(1e0, risk + CASE WHEN device_id IS NOT NULL AND is_emulator THEN 0.2e0 ELSE 0e0 END + CASE WHEN device_id IS NOT NULL AND is_rooted THEN 0.1e0 ELSE 0e0 END), 6) AS device_risk FROM base JOIN kinds USING (transaction_id)""")
def stg_08_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's kind, fingerprint and flags, and the risk with them."""
    more = spark_sql(spark, sf_dir, _DEVICE).drop("device_id")
    rows = view(spark, sf_dir, "risk_txn").withColumn("device_id", F.when(F.col("transaction_id") % 31 != 0, F.col("device_id"))).join(more, "transaction_id")
    out = enrich.with_device_details(enrich.with_device(rows))
    return out.select("transaction_id", "device_type", "device_fingerprint_hash", "device_os_family", "device_browser_family", "device_is_emulator", "device_is_rooted", F.round("device_risk", 6).alias("device_risk"))


_COUNTS = ", ".join(f"COUNT(*) OVER ({_R.format(us)}) AS n_{n}, SUM(amount) OVER ({_R.format(us)}) AS sum_{n}" for n, us in _SPANS.items())
_CRITICAL = " + ".join(f"CASE WHEN {m} >= {c} THEN 1 ELSE 0 END" for m, (w, c) in _LEVELS.items())
_WARNING = " + ".join(f"CASE WHEN {m} >= {w} AND {m} < {c} THEN 1 ELSE 0 END" for m, (w, c) in _LEVELS.items())


@query("stg_10_velocity", f"""
    WITH v AS (SELECT transaction_id, AVG(amount) OVER ({_R.format(3600000000)}) AS mean, MAX(amount) OVER ({_R.format(3600000000)}) AS largest, {_COUNTS}, COUNT(DISTINCT merchant_id) OVER ({_R.format(3600000000)}) AS merchants_1h, COUNT(DISTINCT merchant_id) OVER ({_R.format(86400000000)}) AS merchants_24h FROM risk_txn)
    SELECT transaction_id, n_1h, n_24h, ROUND(CAST(mean AS DOUBLE), 4) AS mean_1h, CAST(largest AS DOUBLE) AS largest_1h, {_CRITICAL} + {_WARNING} AS breaches, ROUND(LEAST(1e0, 0.3e0 * ({_CRITICAL}) + 0.1e0 * ({_WARNING})), 6) AS risk FROM v""")
def stg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity, the hour's amounts, and the thresholds reached."""
    out = enrich.with_velocity(view(spark, sf_dir, "risk_txn"))
    return out.select("transaction_id", "n_1h", "n_24h", F.round("mean_1h", 4).alias("mean_1h"), "largest_1h", F.size("velocity_breaches").alias("breaches"), F.round("velocity_risk", 6).alias("risk"))
