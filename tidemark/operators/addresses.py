"""Places of IP addresses: the longest network that holds an address, found by joins on prefixes.

An address is 128 bits in two longs; version 4 fills the upper 32 of the first. A network is the number of its leading
bits and those bits, the rest being zero. An address is cut to every length that networks of its version have, and each
cut is looked up by equality, so networks may lie within one another and no range is ever compared with all others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .skew import join_frequent
from .validate import not_ip

#: Bits of version 4 and 6.
BITS = {4: 32, 6: 128}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` stated once, however often ``then`` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(text: Column) -> Column:
    """Version 6 as 32 hexadecimal digits; ``text`` must be well-formed."""
    pair = lambda octets, i: F.lpad(F.hex(octets[i].try_cast("int")), 2, "0")
    in_groups = lambda octets: F.concat(pair(octets, 0), pair(octets, 1), F.lit(":"), pair(octets, 2), pair(octets, 3))
    tail = r"\d+\.\d+\.\d+\.\d+$"
    words = F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_replace(text, tail, ""), _let(F.split(F.regexp_extract(text, f"({tail})", 1), r"\."), in_groups))).otherwise(text)
    filled = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")

    def joined(sides: Column) -> Column:
        left, right = filled(sides[0]), filled(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        return F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)

    return F.array_join(F.transform(_let(F.split(words, "::"), joined), lambda x: F.lpad(x, 4, "0")), "")


def parsed(text: Column) -> Column:
    """A struct of ``family`` (4 or 6), ``hi`` and ``lo``; null for what is no address.

    Version 4 inside version 6 (``::ffff:a.b.c.d``) counts as version 4. White space around an address doesn't count."""
    zero = F.lit(0).cast("bigint")
    four = lambda n: F.struct(F.lit(4).alias("family"), F.shiftleft(n, 32).alias("hi"), zero.alias("lo"))
    half = lambda digits, at: F.conv(F.substring(digits, at, 16), 16, -10).try_cast("bigint")  # noqa: E731  signed
    number = lambda x: F.aggregate(F.split(x, r"\."), zero, lambda a, octet: a * 256 + octet.try_cast("bigint"))
    six = lambda digits: F.struct(F.lit(6).alias("family"), half(digits, 1).alias("hi"), half(digits, 17).alias("lo"))
    plain = lambda x: F.when((x["hi"] == 0) & (F.shiftrightunsigned(x["lo"], 32) == 0xFFFF), four(x["lo"].bitwiseAND(0xFFFFFFFF))).otherwise(x)
    read = lambda x: F.when(F.coalesce(not_ip(x), F.lit(True)), F.lit(None)).when(~F.contains(x, F.lit(":")), four(number(x))).otherwise(_let(_let(_digits(x), six), plain))
    return _let(F.trim(text), read)


def _mask(length: Column) -> Column:
    """The long whose first ``length`` bits are set, of any ``length`` from below 0 to above 64."""
    masks = F.array(*[F.lit(-(1 << 64 - n) if n else 0).cast("bigint") for n in range(65)])
    return F.get(masks, F.greatest(F.lit(0), F.least(F.lit(64), length)))


def parsed_network(text: Column) -> Column:
    """A struct of ``family``, ``length``, ``hi`` and ``lo`` of ``address/length``; bits behind the length are cleared.

    Null for what is none; without a length it is one address."""
    before = F.substring_index(text, "/", 1)

    def cut(x: Column) -> Column:
        most = F.when(x["a"]["family"] == 4, 32).otherwise(128)
        inside = F.contains(before, F.lit(":")) & (x["a"]["family"] == 4)  # version 4 inside version 6
        length = F.when(~F.contains(text, F.lit("/")), most).when(inside, x["n"] - 96).otherwise(x["n"])
        return _let(F.struct(x["a"].alias("a"), length.alias("n"), most.alias("most")), masked)

    def masked(x: Column) -> Column:
        net = F.struct(x["a"]["family"].alias("family"), x["n"].alias("length"), x["a"]["hi"].bitwiseAND(_mask(x["n"])).alias("hi"), x["a"]["lo"].bitwiseAND(_mask(x["n"] - 64)).alias("lo"))
        return F.when(x["a"].isNotNull() & (x["n"] >= 0) & (x["n"] <= x["most"]), net)

    return _let(F.struct(parsed(before).alias("a"), F.regexp_extract(text, r"^[^/]*/(\d{1,3})$", 1).try_cast("int").alias("n")), cut)


def located(rows: DataFrame, networks: DataFrame, address: str = "ip_address", network: str = "network") -> DataFrame:
    """``rows`` with ``place``, a struct of the other columns of ``networks`` for the longest one that holds the address.

    Null where no network does, or the address is null or ill-formed. Networks given twice count once, with the least
    values; ill-formed ones are left out. Each distinct text is read once, whatever the number of its rows. Each address
    is looked up as at most 33 and 129 cuts (as many as there are lengths), of which only the longest length is kept, in
    a number; then the place is fetched for that one, and meets the address's rows, those of frequent addresses without a
    shuffle. Lengths are all that comes to the driver. Spark broadcasts the networks where they are few."""
    columns = [c for c in networks.columns if c != network]
    given = networks.select(F.col(network).alias("text"), F.struct(*columns).alias("place")).repartition("text").groupBy("text").agg(F.min("place").alias("place"))
    read = cut(given.select(parsed_network(F.col("text")).alias("net"), "place")).filter("net is not null")
    keys = ["family", "length", "hi", "lo"]
    nets = read.groupBy("net").agg(F.min("place").alias("place")).select("net.*", "place")
    lengths: dict[int, list[int]] = {4: [], 6: []}
    for r in read.select("net.family", "net.length").distinct().collect():
        lengths[r["family"]].append(r["length"])
    of = {family: F.array(*[F.lit(n) for n in sorted(found)]).cast("array<int>") for family, found in lengths.items()}
    upper, lower = F.col("hi").bitwiseAND(_mask(F.col("length"))).alias("hi"), F.col("lo").bitwiseAND(_mask(F.col("length") - 64)).alias("lo")

    def places(texts: DataFrame) -> DataFrame:
        """``__text`` and ``place`` of the distinct ``texts`` that some network holds."""
        numbers = texts.filter("__ip is not null").select("__text", "__ip.*")
        cuts = numbers.select("*", F.explode(F.when(F.col("family") == 4, of[4]).otherwise(of[6])).alias("length"))
        cuts = cuts.select("__text", F.col("hi").alias("all_hi"), F.col("lo").alias("all_lo"), "family", "length", upper, lower)
        longest = cuts.join(read.select("net.*").distinct(), keys).groupBy("__text", "family", F.col("all_hi").alias("hi"), F.col("all_lo").alias("lo")).agg(F.max("length").alias("length"))
        return longest.select("__text", "family", "length", upper, lower).join(nets, keys).select("__text", "place")

    keyed = rows.withColumn("__text", _let(F.col(address), lambda x: F.trim(x)))  # noqa: PLW0108  F.trim itself would be given the index
    some, none = keyed.filter("__text is not null"), keyed.filter("__text is null").withColumn("place", F.lit(None).cast(nets.schema["place"].dataType))
    counted = cut(some.groupBy("__text").agg(F.count("*").alias("n")).withColumn("__ip", parsed(F.col("__text"))))
    found = join_frequent(some, places, counted, ["__text"])
    return found.drop("__text").unionByName(none.drop("__text"))
