"""Where a row's value stands among the earlier rows of its key, for keys of any size.

A frequent key is cut twice at approximate quantiles: its time into stretches, its values into ranges. Of the earlier rows
with no larger value, those in earlier stretches and lower ranges are told by a small table of counts; what is left lies
in the row's own stretch or in its own range, and stretches and ranges are tasks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than one in ``PARTS`` of all rows is frequent, so there are fewer than ``PARTS`` such keys, which have
#: fewer than 2 * ``PARTS`` stretches together, twice as many ranges, and at most 4 * ``PARTS``^2 counts.
PARTS = 256
#: Keys of at most so many rows never are.
SELDOM = 100_000
#: Rows that a task has at most on average, as partitions that Spark joins by their packed size may be many times that in memory.
A_TASK = 500_000


def _below(cuts: str, x: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < x)), F.lit(0))


def _cut(rows: DataFrame, key: str, value: str, time: str, parts: int, seldom: int) -> DataFrame | None:
    """``__hot``, ``__times`` and ``__values`` (the ends of its stretches and ranges) for each frequent key; None without any."""
    counts = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__all"))
    least = max(seldom, (counts.agg(F.sum("__all")).first()[0] or 0) // parts)
    hot = counts.filter(F.col("__all") > F.lit(least)).withColumn("__want", F.ceil(F.col("__all") / least))
    if hot.isEmpty():
        return None
    of_hot = rows.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.col(value).alias("__value")).join(F.broadcast(hot), F.col("__key").eqNullSafe(F.col("__hot")))
    steps = [i / parts for i in range(1, parts)]
    ends = of_hot.groupBy("__hot").agg(F.max("__want").alias("__want"), *[F.percentile_approx(f"__{c}", steps, 20 * parts).alias(f"__{c}s") for c in ("time", "value")])

    def picked(c: str) -> Column:  # as many as the key's share of the rows asks for
        last = F.least(F.col("__want"), F.lit(parts)) - 1
        at = F.transform(F.sequence(F.lit(1), last), lambda i: F.floor(i * parts / F.least(F.col("__want"), F.lit(parts))).cast("int"))
        return F.coalesce(F.array_distinct(F.transform(at, lambda i: F.get(c, i - 1))), F.array().cast(ends.schema[c].dataType))

    return ends.select("__hot", picked("__times").alias("__times"), picked("__values").alias("__values"))


def _placed(rows: DataFrame, key: str, value: str, time: str, cuts: DataFrame | None) -> DataFrame:
    """``rows`` with stretch ``__s`` and range ``__b`` (a cut's own value is a range by itself, an odd one; -1: null), how
    many bits a stretch's number has (``__bits``), ``__gone`` (rows of earlier stretches) and ``__less`` (those of lower ranges,
    or of this one, if odd)."""
    if cuts is None:
        return rows.withColumns({"__s": F.lit(0), "__b": F.lit(0), "__bits": F.lit(0), "__gone": F.lit(0).cast("long"), "__less": F.lit(0).cast("long")})
    at = 2 * _below("__values", F.col(value)) + F.coalesce(F.array_contains("__values", F.col(value)), F.lit(False)).cast("int")
    there = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(at)
    bits = F.coalesce(F.ceil(F.log2(F.size("__times") + 1)).cast("int"), F.lit(0))
    rows = rows.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("__hot")), "left")
    rows = rows.withColumns({"__split": F.col("__times").isNotNull(), "__s": _below("__times", F.col(time)), "__b": there, "__bits": bits}).drop("__hot", "__times", "__values")
    cells = rows.filter("__split").groupBy(F.col(key).alias("__hot"), F.col("__s").alias("__s2"), F.col("__b").alias("__b2")).agg(F.count("*").alias("__n"))
    sizes = cuts.select("__hot", F.size("__times").alias("__last_s"), (2 * F.size("__values")).alias("__last_b"))
    grid = sizes.select("__hot", F.explode(F.sequence(F.lit(0), "__last_s")).alias("__s2"), "__last_b").select("__hot", "__s2", F.explode(F.sequence(F.lit(-1), "__last_b")).alias("__b2"))
    same = F.col("g.__hot").eqNullSafe(F.col("c.__hot")) & (F.col("g.__s2") == F.col("c.__s2")) & (F.col("g.__b2") == F.col("c.__b2"))
    grid = grid.alias("g").join(cells.alias("c"), same, "left").select("g.*", F.coalesce("c.__n", F.lit(0)).alias("__n"))
    line = Window.partitionBy("__hot", "__s2")
    known = F.when(F.col("__b2") >= 0, F.col("__n")).otherwise(0)
    lower = F.sum(known).over(line.orderBy("__b2").rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("__b2") % 2 != 1, known).otherwise(0)
    earlier = Window.partitionBy("__hot", "__b2").orderBy("__s2").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"__lower": lower, "__whole": F.sum("__n").over(line)})
    grid = grid.select("__hot", "__s2", "__b2", F.sum("__lower").over(earlier).alias("__less"), F.sum("__whole").over(earlier).alias("__gone"))
    met = F.col(key).eqNullSafe(F.col("__hot")) & (F.col("__s") == F.col("__s2")) & (F.col("__b") == F.col("__b2"))
    out = rows.join(F.broadcast(grid), met, "left").drop("__hot", "__s2", "__b2", "__split")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("__less", "__gone")})


def dealt(rows: DataFrame, key: str, value: str, order: tuple[str, ...], parts: int = PARTS, seldom: int = SELDOM) -> DataFrame:
    """Each row of ``rows`` once for each bit of its number ``__p`` within its stretch (``__level`` 0 and up) and of the
    stretch's number ``__s`` (-1 and down): those before a number fall into one block of 2^l for each bit l that is set in it,
    the left half of the block of 2^(l+1) that it is in. ``__cell`` and ``__block`` name the block; what a row carries is in
    ``__row``, at level 0 alone."""
    placed = _placed(rows, key, value, order[0], _cut(rows, key, value, order[0], parts, seldom))
    stretch = Window.partitionBy(key, "__s")
    numbered = placed.withColumn("__p", F.row_number().over(stretch.orderBy(*order)) - 1)
    numbered = numbered.withColumn("__top", F.floor(F.log2(F.greatest(F.max("__p").over(stretch), F.lit(1)))).cast("int"))
    inside = F.sequence(F.lit(0), "__top")
    across = F.when((F.col("__bits") > 0) & (F.col("__b") % 2 == 0), F.sequence(F.lit(-1), -F.col("__bits"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    levels = F.when(F.col(value).isNull(), F.array(F.lit(0))).otherwise(F.concat(inside, across))
    out = numbered.withColumn("__level", F.explode(levels))
    own = F.col("__level") >= 0
    out = out.withColumns({"__bit": F.when(own, F.col("__level")).otherwise(-1 - F.col("__level")), "__at": F.when(own, F.col("__p")).otherwise(F.col("__s"))})
    payload = F.when(F.col("__level") == 0, F.struct(*[F.col(f"`{c}`") for c in rows.columns], "__gone", "__less"))
    return out.select(
        F.col(key).alias("__key"), F.col(value).alias("__value"), "__s", "__p", "__level", F.when(own, F.col("__s")).otherwise(F.col("__b")).alias("__cell"),
        F.expr("shiftright(__at, __bit + 1)").alias("__block"), F.expr("(shiftright(__at, __bit) & 1) = 1").alias("__right"), payload.alias("__row"),
    )


def _tasks(rows: DataFrame, key: str) -> int:
    """Tasks for the rows looked at, at most one for each bit of a row's number within its key; 0 where Spark's own will do."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    looks = counts.agg(F.sum(F.col("__n") * (F.floor(F.log2(F.col("__n"))) + 1))).first()[0] or 0
    needed = -(-looks // A_TASK)
    return needed if needed > rows.sparkSession.sparkContext.defaultParallelism else 0


def share_not_above(rows: DataFrame, key: str, value: str, *order: str, parts: int = PARTS, seldom: int = SELDOM) -> DataFrame:
    """``rows`` with ``share``: the part of a key's earlier rows in ``order`` whose ``value`` is no larger; null for the first.

    A null value is larger than none and no larger than none. Null keys are one key. ``order`` begins with a number and
    must be total. A row is looked at once for each bit of its number (see ``dealt``), among the rows of a block in order
    of value, with key, number and value alone; the rest of it moves twice. The largest task has about one in ``parts`` of
    all rows, but for rows of one key at one instant, which stay together. Time grows with n log n; nothing is gathered."""
    w = Window.partitionBy("__key", "__cell", "__level", "__block").orderBy("__value").rangeBetween(Window.unboundedPreceding, 0)
    left = F.when(~F.col("__right") & F.col("__value").isNotNull(), 1)
    looks = dealt(rows, key, value, order, parts, seldom)
    tasks = _tasks(rows, key)
    looks = looks.repartition(tasks, "__key", "__cell", "__level", "__block") if tasks else looks
    counted = looks.withColumn("__n", F.when(F.col("__right"), F.count(left).over(w)))
    counted = counted.repartition(tasks, "__key", "__s", "__p") if tasks else counted
    found = counted.groupBy("__key", "__s", "__p").agg(F.sum("__n").alias("__near"), F.first("__row", ignorenulls=True).alias("__row"))
    below = F.coalesce("__near", F.lit(0)) + F.col("__row.__less")
    share = F.try_divide(below.cast("double"), F.col("__row.__gone") + F.col("__p"))
    return found.select(*[F.col(f"__row.`{c}`") for c in rows.columns], share.alias("share"))
