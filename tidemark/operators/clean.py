"""Cleaning and normalising of raw transaction records, as Column expressions and frames of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import reference as ref

#: Fields of which equal values make a record a duplicate; fields that are trimmed, lowered and raised: fixed values.
IDEMPOTENCY = ("external_transaction_id", "account_id", "transaction_amount", "transaction_timestamp")
TRIMMED = ("external_transaction_id", "account_id", "customer_id", "merchant_id", "merchant_name", "merchant_category_code", "transaction_currency", "card_last_four", "ip_address", "device_id", "geo_country", "geo_city")
LOWERED = ("transaction_type", "channel", "card_type", "device_type")
RAISED = ("transaction_currency", "geo_country")
#: What missing or blank fields are filled with: fixed values.
DEFAULTS = {"transaction_currency": "USD", "channel": "online", "is_international": False, "device_type": "unknown"}


def dedup_key(*fields: str) -> Column:
    """SHA-256 over the trimmed, lowered fields with bars between; null counts as empty."""
    return text.key_of(*[F.col(f) for f in fields])


def first_of(rows: DataFrame, order: list[str], fields: tuple[str, ...] = IDEMPOTENCY) -> DataFrame:
    """``rows`` with ``is_duplicate``: whether an earlier row in ``order`` has the same key."""
    w = Window.partitionBy(dedup_key(*fields)).orderBy(*order)
    return rows.withColumn("is_duplicate", F.row_number().over(w) > 1)


def imputed(c: Column, value: object) -> Column:
    """``value`` for null, or for a string of white space."""
    return F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(value)).otherwise(c)


def within(c: Column, bound: float) -> Column:
    """A number (or its text) between minus and plus ``bound``, else null."""
    value = c.try_cast("double")
    return F.when(value.between(-bound, bound), value)


def amount(c: Column) -> Column:
    """A number from its text: 1.234,56 and 123,45 and 1,234.56, with currency signs and white space; null if it isn't one."""
    bare = F.regexp_replace(c, r"[$ €£¥₹\s]", "")
    plain = F.when(bare.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = plain.when(bare.contains(",") & ~bare.contains("."), F.replace(bare, F.lit(","), F.lit(".")))
    plain = plain.when(bare.contains(",") & bare.contains("."), F.replace(bare, F.lit(","), F.lit("")))
    return F.round(plain.otherwise(bare).try_cast("double"), 4)


def cleaned(rows: DataFrame, order: list[str]) -> DataFrame:
    """Every row with ``is_duplicate`` and ``changes``, and its fields cleaned unless it is a duplicate.

    Steps in order: control characters, white space, case, times (to ISO text in UTC), defaults, numbers, tags. A step's
    change is told as ``step:field``. Amounts and times that can't be read stay as they are; coordinates become null."""
    rows = first_of(rows, order)
    fields = [c for c in rows.columns if c not in (*order, "is_duplicate")]
    kinds = dict(rows.dtypes)
    strings = [c for c in fields if kinds[c] == "string"]
    value = {c: F.col(c) for c in fields}
    told = []

    def step(name: str, names: Iterable[str], change: Callable[[str, Column], Column]) -> None:
        for c in names:
            if c in value:
                new = change(c, value[c])
                told.append(F.when(~value[c].eqNullSafe(new), F.lit(f"{name}:{c}")))
                value[c] = new

    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    step("encoding_fixed", strings, lambda _, v: text.no_controls(v))
    step("whitespace_trimmed", [c for c in TRIMMED if kinds.get(c) == "string"], lambda _, v: text.squeezed(v))
    step("lowercased", LOWERED, lambda _, v: F.lower(v))
    step("uppercased", RAISED, lambda _, v: F.upper(v))
    step("date_parsed", ["transaction_timestamp"], lambda _, v: F.coalesce(F.date_format(text.timestamp(v), iso), v))
    step("imputed", DEFAULTS, lambda c, v: imputed(v, DEFAULTS[c]))
    step("amount_cleaned", [c for c in ("transaction_amount",) if kinds.get(c) == "string"], lambda _, v: F.coalesce(amount(v).cast("string"), v))
    step("coordinate_cleared", ["geo_latitude", "geo_longitude"], lambda c, v: within(v, 90 if c == "geo_latitude" else 180))
    step("html_stripped", strings, lambda _, v: text.no_tags(v))
    same = F.col("is_duplicate")
    changes = F.filter(F.array(*told), lambda x: x.isNotNull())
    return rows.select(*order, "is_duplicate", *[F.when(same, F.col(c)).otherwise(value[c]).alias(c) for c in fields], F.when(same, F.array(F.lit("duplicate_detected"))).otherwise(changes).alias("changes"))


def currency(c: Column) -> Column:
    """The code of a currency's name, else the trimmed value in capitals."""
    bare = F.trim(c)
    return F.coalesce(ref.mapped(ref.CURRENCY_ALIASES, F.lower(bare)), F.upper(bare))


def in_dollars(value: Column, code: Column, to: str = "USD") -> Column:
    """An amount in another currency, to 4 places; null if a rate is unknown."""
    value = value.try_cast("double")
    return F.round(F.when(F.upper(code) == to, value).otherwise(value * ref.mapped(ref.RATES, F.upper(code)) / F.lit(ref.RATES.get(to))), 4)


def country(c: Column) -> Column:
    """The two-letter code of a country's name or other code; two letters in capitals; anything else as it was."""
    bare = F.trim(c)
    return F.coalesce(ref.mapped(ref.COUNTRY_ALIASES, F.lower(bare)), F.when(bare.rlike(r"^\p{L}{2}$"), F.upper(bare)), ref.mapped(ref.COUNTRY_ALIASES, F.upper(bare)), c)


def merchant_category(c: Column) -> Column:
    """The name of a category code; codes 3000 to 3999 that aren't listed are those of 3000."""
    bare = F.trim(c)
    return F.coalesce(ref.mapped(ref.MCC_NAMES, bare), F.when(bare.rlike("^3[0-9]{3}$"), F.lit(ref.MCC_NAMES.get("3000"))))


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """The canonical value of an alias; a value that is its own alias, or has none, stays as it was."""
    bare = F.lower(F.trim(c))
    found = ref.mapped(aliases, bare)
    return F.when(found != bare, found).otherwise(c)


def normalised(rows: DataFrame) -> DataFrame:
    """``rows`` with canonical currency, country, type, channel and card, ``transaction_amount_usd`` and ``mcc_category``.

    A missing currency counts as dollars for the conversion."""
    code = currency(F.col("transaction_currency"))
    return rows.withColumns({
        "transaction_currency": code,
        "transaction_amount_usd": in_dollars(F.col("transaction_amount"), F.coalesce(code, F.lit("USD"))),
        "geo_country": country(F.col("geo_country")),
        "mcc_category": merchant_category(F.col("merchant_category_code")),
        "transaction_type": canonical(F.col("transaction_type"), ref.TYPE_ALIASES),
        "channel": canonical(F.col("channel"), ref.CHANNEL_ALIASES),
        "card_type": canonical(F.col("card_type"), ref.CARD_ALIASES),
    })


#: Characters shown at the end of a masked field: fixed values.
SHOWN = {"card_number": 4, "card_last_four": 4, "phone": 4, "phone_number": 4}


def masked(field: str, c: Column) -> Column:
    """A personal field's value, masked by its name: mail, numbers, addresses and devices in part, the rest wholly."""
    whole = F.lit("***MASKED***")
    if field in ("email", "email_address"):
        out = F.when(c.contains("@"), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.regexp_extract(c, r"^[^@]*@(.*)$", 1))).otherwise(whole)
    elif field in SHOWN:
        n = SHOWN[field]
        out = F.when(F.length(c) > n, F.concat(F.repeat(F.lit("*"), F.length(c) - n), F.right(c, F.lit(n)))).otherwise(whole)
    elif field == "ip_address":
        out = F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", ".***")).otherwise(whole)
    elif field == "device_id":
        out = F.when(F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.lit("***"), F.right(c, F.lit(4)))).otherwise(whole)
    else:
        out = whole
    return F.when(c.isNull() | (c == ""), F.lit("***")).otherwise(out)


#: What is blacked out in running text, in this order: fixed values.
PERSONAL = {
    "EMAIL": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "PHONE": r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b",
}


def scrubbed(c: Column) -> Column:
    """A text without mail addresses, social security, card and telephone numbers."""
    for name, pattern in PERSONAL.items():
        c = F.regexp_replace(c, pattern, f"***REDACTED_{name}***")
    return c
