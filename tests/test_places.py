"""Addresses and networks against the standard library, and the columns of a place."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import addresses, enrich, skew

rng = random.Random(4)
HEX = lambda n: format(n, "x")


def some_address():
    if rng.random() < 0.5:
        return str(ipaddress.IPv4Address(0x0A000000 + rng.randrange(1 << 12)))
    six = ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.randrange(4) << 80) + rng.choice([0, 1, 1 << 64, rng.randrange(1 << 70)]))
    return rng.choice([str(six), six.exploded, str(six).upper()])


BAD = [None, "", "x", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "::1.2.3.400"]
GOOD = ["0.0.0.0", "255.255.255.255", "::", "::1", "1::", "::1.2.3.4", "2001:db8::1.2.3.4", "1:2:3:4:5:6:7:8", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", " 10.0.0.1 ", "0:0:0:0:0:ffff:10.0.0.7", "::FFFF:0a00:0007"]
NETS = ["10.0.0.0/8", "10.0.4.0/22", "10.0.4.7/24", "10.0.4.9/32", "10.0.5.1", "0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1::/112", "2001:db8::1", "::ffff:10.0.8.0/120", "10.0.0.0/33", "nonsense", "10.0.0.0/", None]


def parse(text):
    try:
        x = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    x = getattr(x, "ipv4_mapped", None) or x
    number = int(x) << (96 if x.version == 4 else 0)
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    return (x.version, signed(number >> 64), signed(number & (1 << 64) - 1))


def net(text):
    try:
        x = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None
    if x.version == 6 and x.network_address.ipv4_mapped:
        return ipaddress.ip_network(f"{x.network_address.ipv4_mapped}/{x.prefixlen - 96}")
    return x


def test_parsed(spark):
    texts = BAD + GOOD + [some_address() for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", addresses.parsed(F.col("t")).alias("p")).collect()
    got = {r["i"]: tuple(r["p"]) if r["p"] else None for r in rows}
    assert [(t, got[i], parse(t)) for i, t in enumerate(texts) if got[i] != parse(t)] == []


@pytest.mark.parametrize("seldom", [10_000, 5])
def test_longest_network(spark, monkeypatch, seldom):
    monkeypatch.setattr(skew, "SELDOM", seldom)
    texts = BAD + GOOD + [some_address() for _ in range(200)] + ["10.0.4.9"] * 60
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, ip_address string")
    networks = spark.createDataFrame([(n, k) for k, n in enumerate(NETS + NETS[:3]) if n is None or n], "network string, k int")
    nets = [(net(n), k) for k, n in enumerate(NETS) if n and net(n) is not None]

    def best(t):
        if parse(t) is None:
            return None
        x = ipaddress.ip_address(t.strip())
        x = getattr(x, "ipv4_mapped", None) or x
        return max(((n.prefixlen, k) for n, k in nets if n.version == x.version and x in n), default=(0, None))[1]

    got = addresses.located(rows, networks).select("i", "place.k").collect()
    assert {r["i"]: r["k"] for r in got} == {i: best(t) for i, t in enumerate(texts)} and len(got) == len(texts)


def test_no_networks_no_rows(spark):
    rows = spark.createDataFrame([(1, "10.0.0.1"), (2, None)], "i int, ip_address string")
    none = spark.createDataFrame([], "network string, k int")
    assert sorted(map(tuple, addresses.located(rows, none).collect())) == [(1, "10.0.0.1", None), (2, None, None)] or all(r["place"] is None for r in addresses.located(rows, none).collect())
    assert addresses.located(rows.limit(0), spark.createDataFrame([("10.0.0.0/8", 1)], "network string, k int")).count() == 0


def test_lookup_pairs_nothing(spark):
    rows = spark.range(10).select(F.lit("10.0.0.1").alias("ip_address"))
    networks = spark.createDataFrame([("10.0.0.0/8", 1)], "network string, k int")
    plan = addresses.located(rows, networks)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_places_of_fields(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10.0, 20.0, "KP", "x"), (2, 1, 3_600_000_000, 10.0, None, "KP", "x"), (3, 1, 7_200_000_000, 11.0, 20.0, None, None)], "transaction_id long, customer_id long, us long, lat double, lon double, country string, city string")
    homes = spark.createDataFrame([(1, 10.0, 20.0)], "customer_id long, home_lat double, home_lon double")
    out = {r["transaction_id"]: r for r in enrich.with_geo(enrich.placed_by_fields(rows), homes).collect()}
    assert out[1]["geo_is_high_risk_country"] and out[1]["geo_distance_from_home_miles"] == 0 and out[1]["geo_travel_speed_mph"] is None
    assert out[2]["geo_country_risk_score"] == 0 and out[2]["geo_latitude"] is None and not out[2]["geo_is_vpn"]
    assert out[3]["geo_country_code"] == "" and out[3]["geo_country_risk_score"] == 0.5 and out[3]["geo_travel_speed_mph"] is None


def test_cuts_carry_no_places(spark):
    """Of an address's networks only the longest length is kept, by hashing: nothing is sorted that grows with their number."""
    rows = spark.createDataFrame([(1, "10.0.4.9"), (2, "10.9.9.9"), (3, "2001:db8:1::7"), (4, None)], "i int, ip_address string")
    networks = spark.createDataFrame([(n, k, "x" * 50) for k, n in enumerate(NETS) if n], "network string, k int, note string")
    out = addresses.located(rows, networks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "max_by" not in plan and all("key=[net#" in x for x in plan.splitlines() if "SortAggregate" in x)
    assert {r["i"]: r["place"] and NETS[r["place"]["k"]] for r in out.collect()} == {1: "10.0.4.9/32", 2: "10.0.0.0/8", 3: "2001:db8:1::/112", 4: None}
