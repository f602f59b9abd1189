"""Cleaning, masking and parsing of strings as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Timestamp patterns, tried in this order: fixed values. The third and fourth take an offset.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S][XXX][XX]",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
)


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode composition, which has no built-in."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def no_controls(x: Column) -> Column:
    """Without control characters other than new line and tab."""
    return F.regexp_replace(x, r"[\p{Cc}&&[^\n\t]]", "")


def squeezed(x: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def no_tags(x: Column) -> Column:
    """Without markup tags."""
    return F.regexp_replace(x, "<[^>]+>", "")


def masked_email(x: Column) -> Column:
    """First letter and domain only."""
    return F.when(x.contains("@"), F.concat(F.substring(x, 1, 1), F.lit("***@"), F.substring_index(x, "@", -1))).otherwise("***")


def masked_tail(x: Column, shown: int = 4) -> Column:
    """Stars, then the last ``shown`` characters."""
    return F.when(F.length(x) <= shown, F.repeat(F.lit("*"), F.length(x))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(x) - shown), F.right(x, F.lit(shown))))


def masked_ip(x: Column) -> Column:
    """IPv4 with its last part hidden."""
    return F.regexp_replace(x, r"\.\d{1,3}$", ".***")


def key_of(*columns: Column) -> Column:
    """SHA-256 over lower-case trimmed values with bars between; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in columns]), 256)


def short_hash(x: Column, n: int = 16) -> Column:
    """The first ``n`` hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, n)


def amount(x: Column) -> Column:
    """A number written 1.234,56 or 1,234.56 or 123,45, with any currency sign; null if it isn't one."""
    bare = F.regexp_replace(F.trim(x), r"[^0-9.,\-]", "")
    plain = F.when(bare.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"), F.translate(F.replace(bare, F.lit(".")), ",", ".")).when(bare.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(bare, F.lit(","))).when(bare.rlike(r"^-?\d+,\d+$"), F.translate(bare, ",", ".")).otherwise(bare)
    return F.round(plain.try_cast("double"), 4)


def timestamp(x: Column) -> Column:
    """Digits alone are epoch seconds, or milliseconds if over ten billion; else the first pattern that fits; else null.

    Without an offset the time is UTC (the session's zone must be). Of the patterns of digits alone none is ever
    reached."""
    value = F.trim(x)
    number = value.try_cast("double")
    digits = F.timestamp_micros(F.when(number > 1e10, number * 1e3).otherwise(number * 1e6).try_cast("bigint"))
    read = reduce(lambda a, f: F.coalesce(a, F.try_to_timestamp(value, F.lit(f))), TIMESTAMP_FORMATS[1:], F.try_to_timestamp(value, F.lit(TIMESTAMP_FORMATS[0])))
    return F.when(value.rlike("^[0-9]+$"), digits).otherwise(read)


def bucket_of(test: Column, user: Column, buckets: int = 10_000) -> Column:
    """A sticky place in 0..buckets-1: the SHA-256 of test and user as an integer, by ``buckets``."""
    digest = F.sha2(F.concat_ws(":", test, user), 256)
    digits = F.transform(F.split(digest, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0).cast("bigint"), lambda a, d: (a * 16 + d) % buckets)


#: Types of devices that are known: fixed values.
DEVICE_TYPES = ("mobile", "desktop", "tablet", "pos", "atm")


def device_type(x: Column) -> Column:
    """The type in lower case, ``unknown`` for any other."""
    return F.when(F.lower(x).isin(*DEVICE_TYPES), F.lower(x)).otherwise("unknown")


def fingerprint(*parts: Column) -> Column:
    """16 hex digits over the parts with bars between."""
    return short_hash(F.concat_ws("|", *parts))


def anonymous(x: Column) -> Column:
    """A stand-in that is the same for the same value."""
    return F.concat(F.lit("ANON-"), F.upper(short_hash(x, 12)))
