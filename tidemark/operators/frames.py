"""The three look-back frames and what is computed over them.

Time is a bigint column of microseconds, so frames are plain RANGE frames: one shuffle by key serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SECOND = 1_000_000


def before(key: str, us: str, seconds: int) -> WindowSpec:
    """[t - W, t): rows before the current instant."""
    return Window.partitionBy(key).orderBy(us).rangeBetween(-seconds * SECOND, -1)


def history(key: str, us: str, seconds: int) -> WindowSpec:
    """[t - W, t]: also rows of the same instant; callers take the current row out."""
    return Window.partitionBy(key).orderBy(us).rangeBetween(-seconds * SECOND, 0)


def around(key: str, us: str, seconds: int) -> WindowSpec:
    """[t - W, t + W]."""
    return Window.partitionBy(key).orderBy(us).rangeBetween(-seconds * SECOND, seconds * SECOND)


def prior(key: str, *order: str) -> WindowSpec:
    """All earlier rows in a total order."""
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def sums_within(rows: DataFrame, key: str, us: str, wanted: dict[str, tuple[Column, int]]) -> DataFrame:
    """``rows`` with the sum of a value within [t - W, t] for each of ``wanted``: name -> (value, seconds); null where no value
    there is one. Values must be whole numbers or decimals, so that what was added can be taken away.

    A value is added at its row and taken away W later by a row of its own; the answer is a running sum, so no frame is
    summed anew for each row: time is linear in the rows of a key but for sorting. Rows without a time see one another."""
    own = F.struct(F.col(us).alias("__at"), F.lit(True).alias("__own"), *[F.struct(v.alias("v"), F.when(v.isNotNull(), 1).otherwise(0).alias("n")).alias(f"__{n}") for n, (v, _) in wanted.items()])
    steps = [own]
    for seconds in sorted({s for _, s in wanted.values()}):
        end = F.col(us) + seconds * SECOND + 1
        gone = [F.when(F.lit(s == seconds), F.struct((-v).cast(rows.select(v).schema[0].dataType).alias("v"), F.when(v.isNotNull(), -1).otherwise(0).alias("n"))).alias(f"__{n}") for n, (v, s) in wanted.items()]
        steps.append(F.when(end.isNotNull(), F.struct(end.alias("__at"), F.lit(False).alias("__own"), *gone)))
    events = rows.withColumn("__step", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull()))).select(*rows.columns, "__step.*")
    running = Window.partitionBy(key, F.col("__at").isNull()).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    out = {n: F.when(F.sum(f"__{n}.n").over(running) > 0, F.sum(f"__{n}.v").over(running)) for n in wanted}
    return events.withColumns(out).filter("__own").select(*rows.columns, *wanted)


def distinct_counts(rows: DataFrame, key: str, us: str, wanted: dict[str, tuple[str, int]], inclusive: bool = True) -> DataFrame:
    """``rows`` with the number of distinct values of a column within [t - W, t] for each of ``wanted``: name ->
    (column, seconds). Within [t - W, t) if not ``inclusive``. Null and the empty string aren't values.

    A value counts from a row that has none of its kind within W before it to W after the last one of such a row's run.
    Those beginnings and ends become rows of +1 and -1 whose running sum is the answer, so that no frame is gathered: time
    is linear in the rows of a key but for sorting, and one shuffle by ``key`` serves all steps."""
    rows = rows.repartition(key)
    steps = [F.struct(F.col(us).alias("at"), F.lit(True).alias("own"), *[F.col(f"__first_{n}").cast("long").alias(n) for n in wanted])]
    for name, (column, seconds) in wanted.items():
        w = Window.partitionBy(key, column).orderBy(us)
        there, span = F.coalesce(F.col(column).cast("string") != "", F.lit(False)), seconds * SECOND
        before_, after = F.lag(us).over(w), F.lead(us).over(w)
        rows = rows.withColumns({f"__first_{name}": there & (before_.isNull() | (before_ < F.col(us) - span)), f"__last_{name}": there & (after.isNull() | (after > F.col(us) + span))})
        steps.append(F.when(F.col(f"__last_{name}"), F.struct((F.col(us) + span + int(inclusive)).alias("at"), F.lit(False).alias("own"), *[F.lit(-1 if n == name else 0).cast("long").alias(n) for n in wanted])))
    kept = [c for c in rows.columns if not c.startswith(("__first_", "__last_"))]
    events = rows.withColumn("__step", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull()))).select(*kept, "__step.*")
    running = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return events.withColumns({n: F.coalesce(F.sum(n).over(running), F.lit(0)) for n in wanted}).filter("own").select(*kept, *wanted)


def distinct_until(rows: DataFrame, key: str, us: str, column: str, now: int, windows: dict[str, int]) -> DataFrame:
    """``key`` and ``distinct_<name>`` for each window: the distinct values of ``column`` in [now - seconds, now).

    Values are compared as strings; null and the empty string aren't values. A key without any has zeros. One row a key
    and value is left after the first aggregation, so windows cost nothing more."""
    value = F.col(column).cast("string")
    there = F.coalesce(value != "", F.lit(False)) & (F.col(us) < now)
    last = rows.groupBy(key, F.when(there, value).alias("__value")).agg(F.max(F.when(there, F.col(us))).alias("__last"))
    return last.groupBy(key).agg(*[F.count_if(F.col("__last") >= now - seconds * SECOND).alias(f"distinct_{name}") for name, seconds in windows.items()])


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1; the last one if there are fewer) of ``size`` rows in ``order``, which must be total.

    The rows are counted; then each task keeps no more than the rows up to the page's end."""
    last = max((rows.count() + size - 1) // size, 1)
    return rows.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def velocity(txns: DataFrame, key: str = "customer_id") -> DataFrame:
    """Counts and sums over 1 and 5 minutes, 1 and 24 hours, and distinct merchants and countries, the current row
    included."""
    out = distinct_counts(txns, key, "us", {"merchants_1h": ("merchant_id", 3600), "merchants_24h": ("merchant_id", 86400), "countries_24h": ("country", 86400)})
    for name, seconds in (("1m", 60), ("5m", 300), ("1h", 3600), ("24h", 86400)):
        w = history(key, "us", seconds)
        out = out.withColumns({f"n_{name}": F.count("*").over(w), f"sum_{name}": F.sum("amount").over(w).cast("double")})
    return out


def windowed_stats(txns: DataFrame, key: str, as_of: Column, spans: dict[str, int]) -> DataFrame:
    """Count, sum, mean, sample deviation (0 below two rows), least and largest amount in [as_of - W, as_of) for each key:
    one pass over the rows of the longest span."""
    def inside(seconds: int) -> Column:
        return (F.col("us") >= as_of - seconds * SECOND) & (F.col("us") < as_of)

    amount = F.col("amount").cast("double")
    parts = []
    for name, seconds in spans.items():
        ok = inside(seconds)
        total = F.sum(F.when(ok, F.col("amount"))).cast("double")
        n = F.count(F.when(ok, 1))
        parts += [n.alias(f"n_{name}"), F.coalesce(total, F.lit(0.0)).alias(f"sum_{name}"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias(f"mean_{name}"), F.round(F.coalesce(F.stddev_samp(F.when(ok, amount)), F.lit(0.0)), 6).alias(f"sd_{name}"), F.coalesce(F.min(F.when(ok, amount)), F.lit(0.0)).alias(f"least_{name}"), F.coalesce(F.max(F.when(ok, amount)), F.lit(0.0)).alias(f"largest_{name}"), F.count_distinct(F.when(ok & F.col("country").isNotNull() & (F.col("country") != ""), F.col("country"))).alias(f"countries_{name}")]
    return txns.groupBy(key).agg(*parts)
