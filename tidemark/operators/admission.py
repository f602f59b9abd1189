"""Limits whose verdicts depend on what was let through before.

Only where more rows come than a limit allows do verdicts depend on one another. Time is cut into stretches as long as
the limit looks back; runs of stretches in which some row finds the limit reached, even if all rows before it were let
through, are folded in order, each run by itself and as a stream that holds no more than the limit's own number of
times. All other rows pass. A key that is full without a pause is one run, as its verdicts form one chain. Which
stretches these are is told by counts of cells, so that no frame is counted anew for each row."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def _stretch(at: Column, length: int) -> Column:
    return F.call_function("div", at - F.pmod(at, F.lit(length)), F.lit(length))


def _busy(rows: DataFrame, keys: list[str], at: str, span: int, most: int, length: int, pause: bool) -> DataFrame:
    """``keys`` and ``__stretch`` of the stretches of ``length`` in which a key may have more than ``most`` rows within ``span``,
    with the next ones if a ``pause`` follows.

    Rows are counted by cells of ``span``: a row and those it looks back at lie in one cell and the one before."""
    cell = F.expr(f"({at} - pmod({at}, {span}L)) div {span}L")
    cells = rows.groupBy(*keys, cell.alias("__cell")).agg(F.count("*").alias("__n"))
    pair = Window.partitionBy(*keys).orderBy("__cell").rangeBetween(-1, 0)
    here = F.col("__cell") * span
    last = _stretch(here + 2 * span - 1, length) + int(pause)  # also rows that don't count themselves, behind the last that does
    full = cells.withColumn("__near", F.sum("__n").over(pair)).filter(F.col("__near") > most)
    return full.select(*keys, F.explode(F.sequence(_stretch(here, length), last)).alias("__stretch")).distinct()


def limited(rows: DataFrame, keys: list[str], at: str, order: str, most: int, seconds: int, counts: Column | None = None, storm: tuple[int, int] | None = None, name: str = "why") -> DataFrame:
    """``rows`` with ``name``: null where fewer than ``most`` earlier rows of the key within ``seconds`` were let through
    and count, else ``full``, or ``storm``.

    Rows come in order of ``at`` (microseconds) and ``order``. A row that this limit lets through counts if ``counts``
    says so (always without it); what is turned away doesn't. ``storm`` is a number and a pause in seconds: where
    that many count but the limit isn't reached, the row and all within the pause behind it are turned away. A null key
    is a key of its own. Two shuffles by key and stretch, whatever the length of time; runs are told apart from one row a
    stretch. Columns that begin with ``__`` are reserved."""
    span, pause = seconds * SECOND, (storm[1] if storm else 0) * SECOND
    length, least = max(span, pause), min(most, storm[0]) if storm else most
    source = rows.withColumns({"__open": F.lit(True) if counts is None else F.coalesce(counts, F.lit(False)), "__stretch": _stretch(F.col(at), length)})
    busy = _busy(source.filter("__open"), keys, at, span, least if counts is None else least - 1, length, bool(pause))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__stretch"))
    runs = busy.withColumn("__island", F.col("__stretch") - place)
    runs = runs.groupBy(*keys, "__island").agg(F.min("__stretch").alias("__run"), F.max("__stretch").alias("__end"))
    runs = runs.select(*[F.col(k).alias(f"__key_{k}") for k in keys], "__run", F.explode(F.sequence(F.col("__run") - 1, F.col("__end"))).alias("__of"))  # with the stretch before
    same = F.col("__stretch") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    joined = source.join(runs, same, "left").drop("__of", *[f"__key_{k}" for k in keys])
    fields = [f for f in joined.schema.fields if f.name in rows.columns]
    chained = joined.filter("__run is not null").repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", at, order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent, until = None, deque(), None
        for batch in batches:
            out = []
            parts = [batch.column(c).to_pylist() for c in (*keys, "__run")]
            for *key, now, counted in zip(*parts, batch.column("__at_us").to_pylist(), batch.column("__open").to_pylist(), strict=True):
                if key != last:
                    last, until = key, None
                    sent.clear()
                while sent and now - sent[0] >= span:
                    sent.popleft()
                why = None
                if until is not None and now < until:
                    why = "storm"
                elif len(sent) >= most:
                    why = "full"
                elif storm and len(sent) >= storm[0]:
                    why, until = "storm", now + pause
                elif counted:
                    sent.append(now)
                out.append(why)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(out, pa.string())], [*[f.name for f in fields], name])

    schema = T.StructType([*fields, T.StructField(name, T.StringType())])
    folded = chained.withColumn("__at_us", F.col(at)).mapInArrow(fold, schema)
    free = joined.filter("__run is null").select(*[f.name for f in fields], F.lit(None).cast("string").alias(name))
    return folded.union(free)


def throttled(alerts: DataFrame, store: Callable[[DataFrame], DataFrame], limits: dict[str, tuple[int, int]], storm: tuple[int, int] | None = None) -> DataFrame:
    """``alert_id`` and ``reason``: null for alerts that are sent, else the first limit that was full: storm, total,
    account or rule.

    ``limits`` has a number and its seconds for ``total``, ``account`` and ``rule``. Alerts are taken in order of
    ``created_us`` and ``alert_id``; only those sent count. Stretches of time in which no limit can be full pass. Runs of the
    others are folded once, each as a stream that holds no more than was sent within the limits' times: by account or
    by rule where no other limit can be full in the run, else as one chain in one task, as each verdict may hang on all
    those before it. ``store`` keeps the alerts, which are read twice."""
    kinds = {"total": [], "account": ["account_id"], "rule": ["rule_id"]}
    spans, pause = {n: limits[n][1] * SECOND for n in kinds}, (storm[1] if storm else 0) * SECOND
    length = max(*spans.values(), pause)
    rows = store(alerts.select("alert_id", "account_id", "rule_id", F.col("created_us").alias("at"))).withColumn("__stretch", _stretch(F.col("at"), length))
    busy = None
    for name, keys in kinds.items():
        one = name == "total"
        found = _busy(rows.filter("rule_id is not null") if name == "rule" else rows, keys, "at", spans[name], min(limits[name][0], storm[0]) if one and storm else limits[name][0], length, one and bool(pause))
        found = found.select("__stretch", F.lit(name).alias("__kind")).distinct()
        busy = found if busy is None else busy.union(found)
    stretches = busy.groupBy("__stretch").agg(F.collect_set("__kind").alias("__kinds"))
    stretches = stretches.withColumn("__island", F.col("__stretch") - F.row_number().over(Window.orderBy("__stretch")))  # one row a stretch
    runs = stretches.groupBy("__island").agg(F.min("__stretch").alias("__run"), F.max("__stretch").alias("__end"), F.array_distinct(F.flatten(F.collect_list("__kinds"))).alias("__kinds"))
    of = runs.select("__run", F.when(F.size("__kinds") == 1, F.get("__kinds", F.lit(0))).otherwise("total").alias("__kind"), F.explode(F.sequence(F.col("__run") - 1, F.col("__end"))).alias("__stretch"))
    joined = rows.join(of, "__stretch", "left")
    by = F.when(F.col("__kind") == "account", F.col("account_id").cast("string")).when(F.col("__kind") == "rule", F.col("rule_id").cast("string"))
    chained = joined.filter("__run is not null").withColumn("__by", by)
    order = ("__run", "__by", "at", "alert_id")
    chained = chained.select(*order, "account_id", "rule_id").repartition("__run", "__by").sortWithinPartitions(*order)
    kind = rows.schema["alert_id"].dataType
    folded = chained.mapInArrow(_throttle(limits, spans, storm), T.StructType([T.StructField("alert_id", kind), T.StructField("reason", T.StringType())]))
    return folded.union(joined.filter("__run is null").select("alert_id", F.lit(None).cast("string")))


def _throttle(limits: dict[str, tuple[int, int]], spans: dict[str, int], storm: tuple[int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fold of ``throttled`` over rows of chains in order. Held is what was sent within a limit's time."""
    total, accounts, rules = (limits[n][0] for n in ("total", "account", "rule"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, until = None, None
        sent, by_account, by_rule = deque(), deque(), deque()  # times; with the account, with the rule
        n_account, n_rule = {}, {}

        def forget(held: deque, counts: dict, before: int) -> None:
            while held and held[0][0] <= before:
                old = held.popleft()[1]
                if counts[old] == 1:
                    del counts[old]
                else:
                    counts[old] -= 1

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("__run", "__by", "at", "account_id", "rule_id")]
            for run, by, now, account, rule in zip(*columns, strict=True):
                if (run, by) != chain:
                    chain, until = (run, by), None
                    for held in (sent, by_account, by_rule, n_account, n_rule):
                        held.clear()
                if until is not None and now < until:
                    out.append("storm")
                    continue
                while sent and now - sent[0] >= spans["total"]:
                    sent.popleft()
                if len(sent) >= total:
                    out.append("total")
                    continue
                if storm and len(sent) >= storm[0]:
                    until = now + storm[1] * SECOND
                    out.append("storm")
                    continue
                forget(by_account, n_account, now - spans["account"])
                forget(by_rule, n_rule, now - spans["rule"])
                why = None
                if n_account.get(account, 0) >= accounts:
                    why = "account"
                elif rule is not None and n_rule.get(rule, 0) >= rules:
                    why = "rule"
                else:
                    sent.append(now)
                    by_account.append((now, account))
                    n_account[account] = n_account.get(account, 0) + 1
                    if rule is not None:
                        by_rule.append((now, rule))
                        n_rule[rule] = n_rule.get(rule, 0) + 1
                out.append(why)
            yield pa.RecordBatch.from_arrays([batch.column("alert_id"), pa.array(out, pa.string())], ["alert_id", "reason"])

    return fold
