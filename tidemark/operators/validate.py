"""Record validation as Column expressions that give arrays of errors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "field string, rule string, severity string"


def issue(field: str, rule: str, severity: str = "error") -> Column:
    """One finding."""
    return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def blank(c: Column) -> Column:
    """Null, or a string of white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


#: Rules of one field: kind -> test that is true where the value breaks it. Nulls break only ``required``.
def broken(field: str, kind: str, value: Any) -> Column:
    """Whether a field breaks a rule."""
    c = F.col(field)
    tests = {
        "required": lambda: blank(c),
        "min_length": lambda: F.length(c) < value,
        "max_length": lambda: F.length(c) > value,
        "allowed": lambda: ~c.isin(*value),
        "pattern": lambda: ~c.rlike(f"^(?:{value})"),
        "minimum": lambda: c.try_cast("double") < value,
        "maximum": lambda: c.try_cast("double") > value,
        "number": lambda: c.try_cast("double").isNull(),
        "timestamp": lambda: F.try_to_timestamp(c.cast("string")).isNull(),
        "ipv4": lambda: ~c.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$"),
    }
    if kind not in tests:
        raise ValueError(f"unknown rule {kind!r}")
    return tests[kind]() if kind == "required" else c.isNotNull() & F.coalesce(tests[kind](), F.lit(False))


def validated(df: DataFrame, spec: dict[str, dict[str, Any]], cross: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """``df`` with ``issues`` (every finding) and ``is_valid`` (no finding of severity error).

    ``spec`` maps fields to rules; ``cross`` maps a rule's name to a Column that is true where a row breaks it, and its
    severity. A null verdict doesn't break a rule."""
    found = [F.when(broken(field, kind, value), issue(field, kind)) for field, kinds in spec.items() for kind, value in kinds.items()]
    found += [F.when(F.coalesce(test, F.lit(False)), issue("record", name, severity)) for name, (test, severity) in (cross or {}).items()]
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.withColumn("issues", issues).withColumn("is_valid", ~F.exists("issues", lambda x: x["severity"] == "error"))


def transaction_rules(as_of: Column, round_over: float = 1000, high_value: float = 50_000) -> dict[str, tuple[Column, str]]:
    """Rules across a transaction's fields; times are in microseconds and ``as_of`` is the present."""
    amount = F.col("amount").cast("double")
    return {
        "pos_needs_merchant": ((F.col("channel") == "pos") & F.col("merchant_id").isNull(), "warning"),
        "round_amount": ((amount > round_over) & (amount == F.floor(amount)), "warning"),
        "high_value": (amount > high_value, "warning"),
        "paired_coordinates": (F.col("lat").isNull() != F.col("lon").isNull(), "error"),
        "future": (F.col("us") > as_of + 300_000_000, "error"),
        "stale": (F.col("us") < as_of - 90 * 86_400_000_000, "error"),
    }


def not_number(body: Column, path: str) -> Column:
    """Whether a variant's entry is there and is no number; texts of digits and booleans are none."""
    kind = F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    return ~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$")


def not_boolean(body: Column, path: str) -> Column:
    """Whether a variant's entry is there and is no boolean."""
    return F.schema_of_variant(F.try_variant_get(body, path, "variant")) != "BOOLEAN"


#: Addresses of version 4, and of version 6 with at most one run of zeros left out and perhaps version 4 at the end.
_PART = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_PART}(\.{_PART}){{3}}"


def not_ip(c: Column) -> Column:
    """Whether a text is no IP address of version 4 or 6."""
    tail = rf"([0-9A-Fa-f]{{1,4}}|{_V4})"
    group = "[0-9A-Fa-f]{1,4}"
    words = F.regexp_replace(c, _V4 + "$", "0:0")  # as two groups
    full = words.rlike(rf"^({group}:){{7}}{group}$")
    short = words.rlike(rf"^(({group}:)*{group})?::(({group}:)*{group})?$") & (F.size(F.filter(F.split(words, ":"), lambda x: x != "")) <= 7)
    return ~(c.rlike(rf"^{_V4}$") | (c.rlike(rf":{tail}?$|::$|:") & (full | short)))


def not_iso(c: Column) -> Column:
    """Whether a text is no ISO 8601 date or time: extended or basic, with or without an offset."""
    day = r"(\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])|\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]))"
    clock = r"([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d+)?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d){0,2})?"
    return c.isNotNull() & ~(c.rlike(rf"^{day}(.{clock})?$") & F.try_to_date(F.regexp_replace(F.substring(c, 1, 10), r"^(\d{4})-?(\d\d)-?(\d\d).*$", "$1-$2-$3"), "yyyy-MM-dd").isNotNull())


def coerced(rows: DataFrame, fields: dict[str, tuple[str, Any, tuple[Any, ...] | None]]) -> DataFrame:
    """``fields`` cast to a type (null if they can't be), null where an enumeration lacks them, then given a default."""

    def one(name: str) -> Column:
        kind, default, allowed = fields[name]
        c = F.col(name).try_cast(kind)
        if allowed is not None:
            c = F.when(c.isin(*allowed), c)
        return c if default is None else F.coalesce(c, F.lit(default))

    return rows.withColumns({name: one(name) for name in fields})


def gated(rows: DataFrame, good: Column, minimum: float) -> DataFrame:
    """``verdict``, ``n``, ``failed`` of a batch; an error inside Spark if the share of good rows is under ``minimum``. An
    empty batch passes."""
    failed = F.count(F.when(~F.coalesce(good, F.lit(False)), 1))
    n = F.count("*")
    enough = (n == 0) | ((n - failed) / F.greatest(n, F.lit(1)) >= minimum)
    return rows.agg(F.when(enough, F.lit("ok")).otherwise(F.raise_error(F.lit("too few good rows in the batch")).cast("string")).alias("verdict"), n.alias("n"), failed.alias("failed"))


def routed(rows: DataFrame, stages: dict[str, tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all stages, and the others with ``failed_stage`` (the first they fail) and ``policy``.

    ``stages`` maps names, in order, to a test that is true where a row fails, and a policy: ``skip`` sends the row to the
    second frame, ``halt`` stops the job with an error."""
    name, policy = F.lit(None).cast("string"), F.lit(None).cast("string")
    for stage, (fails, what) in reversed(stages.items()):
        if what not in ("skip", "halt"):
            raise ValueError(f"unknown policy {what!r}")
        fails = F.coalesce(fails, F.lit(False))
        told = F.lit(stage) if what == "skip" else F.raise_error(F.lit(f"stage {stage} failed")).cast("string")
        name, policy = F.when(fails, told).otherwise(name), F.when(fails, F.lit(what)).otherwise(policy)
    marked = rows.withColumns({"failed_stage": name, "policy": policy})
    return marked.filter("failed_stage is null").drop("failed_stage", "policy"), marked.filter("failed_stage is not null")


def feature_quality(rows: DataFrame, required: list[str], ranges: dict[str, tuple[float, float]], most_missing: float = 0.2) -> DataFrame:
    """``missing`` and ``out_of_range`` features of each row, and ``accepted``: whether no larger a share than ``most_missing``
    is missing. NaN counts as missing."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    missing = sum((number(c).isNull().cast("int") for c in required), F.lit(0))
    outside = sum((F.coalesce(~number(c).between(*r), F.lit(False)).cast("int") for c, r in ranges.items()), F.lit(0))
    return rows.withColumns({"missing": missing, "out_of_range": outside, "accepted": missing / max(len(required), 1) <= most_missing})


def model_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    """``x``: the named columns in order as doubles; 0 for what is missing, no number or no column."""
    return rows.withColumn("x", F.array(*[F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in names]))


def cross_field_rules(as_of: Column, home: str = "USA", refund_limit: float = 50_000, tolerance_seconds: int = 300, max_age_days: int = 90) -> dict[str, tuple[Column, str]]:
    """Rules across a raw transaction's fields, by name, each true where a row breaks it, with its severity; ``us`` and
    ``as_of`` are microseconds. A missing flag counts as not international."""
    c = F.col
    return {
        "international_flag_matches_country": (c("geo_country").isNotNull() & (c("geo_country") != home) & ~F.coalesce(c("is_international"), F.lit(False)), "warning"),
        "card_last_four_required_for_card_transactions": (c("card_type").isNotNull() & c("card_last_four").isNull(), "warning"),
        "ip_required_for_online": ((c("channel") == "online") & c("ip_address").isNull(), "warning"),
        "geo_coordinates_paired": (c("geo_latitude").isNull() != c("geo_longitude").isNull(), "error"),
        "pos_requires_merchant": ((c("channel") == "pos") & c("merchant_id").isNull(), "warning"),
        "atm_no_merchant_category": ((c("channel") == "atm") & ~c("transaction_type").eqNullSafe("withdrawal"), "warning"),
        "refund_amount_limit": ((c("transaction_type") == "refund") & (c("transaction_amount") > refund_limit), "error"),
        "future_timestamp_check": (c("us") > as_of + tolerance_seconds * 1_000_000, "error"),
        "stale_timestamp_check": (c("us") < as_of - max_age_days * 86_400_000_000, "error"),
    }
