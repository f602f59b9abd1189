"""Upserts and slowly changing dimensions on tables that can only be rewritten."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k] == right[k] for k in keys))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """MERGE: matched rows take the source's ``update`` columns (all by default), unmatched source rows are added.

    Keys must be unique in ``source``; a null key matches nothing. Columns that only one side has are null elsewhere."""
    update = [c for c in source.columns if c not in keys] if update is None else update
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns], F.lit(True).alias("__s_is"))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__s_{k}") for k in keys))
    kept = target.join(s, on, "left").select(*[F.when(F.col("__s_is"), F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns])
    new = source.join(target.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], insert: list[str], allowed: list[str] | None = None) -> DataFrame:
    """MERGE with its columns as parameters: matched rows take ``update`` from the source; rows that match nothing are added
    with ``insert`` (null elsewhere), or not at all if it is empty.

    Names must be plain identifiers of both tables and, where ``allowed`` is given, on that list; keys can't be updated
    (``ValueError``). Of source rows with one key a single one is taken; a null key matches nothing."""
    for name in (*keys, *update, *insert):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or (allowed is not None and name not in allowed) or name not in source.columns or name not in target.columns:
            raise ValueError(f"{name!r} is no column that a merge may name")
    if not keys or set(keys) & set(update):
        raise ValueError("a merge needs keys, and leaves them as they are")
    once, there = source.dropDuplicates(keys), target.select(*keys).distinct()
    merged = upsert(target, once.join(there, keys, "left_semi"), keys, update)
    return merged.unionByName(once.join(there, keys, "left_anti").select(*insert), allowMissingColumns=True) if insert else merged


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING; of source rows with the same key one goes in."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def delete(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE by key."""
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def incremental(source: DataFrame, state: DataFrame, table: str, watermark: str) -> DataFrame:
    """Rows of ``source`` beyond the bookmark of ``table`` in ``state`` (table_name, high); all rows if there is none."""
    high = state.filter(F.col("table_name") == table).agg(F.max("high").alias("__high"))
    # one row
    return source.join(F.broadcast(high), F.col("__high").isNull() | (F.col(watermark) > F.col("__high"))).drop("__high")


def scd2(dimension: DataFrame, source: DataFrame, key: str, tracked: list[str], as_of: Column, null_safe: bool = False) -> DataFrame:
    """Close current rows whose tracked values changed and add new current rows for changed and unseen keys.

    ``dimension`` has the key, the tracked columns, ``valid_from``, ``valid_to`` and ``is_current``. Values are compared
    with ``<>``, where null never differs; ``null_safe`` compares nulls as values."""
    current = dimension.filter("is_current").select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in tracked])
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__{c}")) if null_safe else F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False)) for c in tracked))
    changed = source.join(current, F.col(key) == F.col("__k"), "left").filter(F.col("__k").isNull() | differs).select(key, *tracked)
    marks = changed.select(F.col(key).alias("__c")).distinct()
    closing = F.col("is_current") & F.col("__c").isNotNull()
    old = dimension.join(marks, F.col(key) == F.col("__c"), "left").select(key, *tracked, "valid_from", F.when(closing, as_of).otherwise(F.col("valid_to")).alias("valid_to"), (F.col("is_current") & ~closing).alias("is_current"))
    new = changed.select(key, *tracked, as_of.alias("valid_from"), F.lit(None).cast(dimension.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("is_current"))
    return old.unionByName(new)


def looked_back(rows: DataFrame, us: str, now: DataFrame, span_us: int) -> DataFrame:
    """Rows of the last ``span_us`` microseconds before ``now`` (one row, column ``now``)."""
    return rows.join(F.broadcast(now), F.col(us) >= F.col("now") - span_us).drop("now")  # one row


def upsert_dimension(dimension: DataFrame, batch: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Members of ``batch`` put into a dimension: known ones count one batch more, new ones start at one; nulls are no members."""
    members = batch.select(*keys).dropna().distinct().withColumn("__in", F.lit(True))
    joined = dimension.join(members, keys, "full")
    known = F.col(counter)
    return joined.select(*keys, F.when(known.isNull(), F.lit(1)).when(F.col("__in"), known + 1).otherwise(known).alias(counter))


def insert_new_null_safe(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``source`` whose keys, nulls counting as values, ``target`` lacks, added to it."""
    new = source.select(*keys).distinct()
    have = target.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return target.unionByName(new.join(have, same, "left_anti"), allowMissingColumns=True)


def missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose keys ``target`` lacks (LEFT JOIN ... IS NULL)."""
    return source.join(target.select(*keys), keys, "left_anti")


def replace_where(table: DataFrame, source: DataFrame, where: Column) -> DataFrame:
    """DELETE ... WHERE and INSERT of the source's rows that meet the same condition; a null verdict deletes nothing."""
    return table.filter(~F.coalesce(where, F.lit(False))).unionByName(source.filter(where))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: rows that meet ``where`` beside the source's row of their key take ``values``; keys are unique in
    ``source``."""
    hit = F.coalesce(where, F.lit(False))
    joined = target.join(source, keys, "left")
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows of deleted keys."""
    return {name: delete(df, gone, keys) for name, df in tables.items()}


def load_checks(staged: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """``staged`` and ``loaded`` rows, null keys, and whether all are loaded and none is null."""
    a = staged.agg(F.count("*").alias("staged"), F.count(F.when(F.col(key).isNull(), 1)).alias("null_keys"))
    b = loaded.agg(F.count("*").alias("loaded"))
    return a.crossJoin(b).select("staged", "loaded", "null_keys", ((F.col("staged") == F.col("loaded")) & (F.col("null_keys") == 0)).alias("passed"))  # one row each
