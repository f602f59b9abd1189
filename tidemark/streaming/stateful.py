"""Stores of alerts, rules and devices as streams: keyed state with timers, read and written row by row of a key.

Rows of a micro-batch are taken in order of time. A row that comes late, but before the watermark, sees what its own
time allows as far as it is still held; rows told before aren't told again. Watermarks clear what no row can need."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The session's state store is RocksDB meanwhile, which state with timers and several variables needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _rows(frames: Iterator[pd.DataFrame], *order: str) -> list[Any]:
    """All rows of a key in a batch, in order."""
    return list(pd.concat(list(frames)).sort_values(list(order), kind="stable").itertuples(index=False))


def _ms(us: int) -> int:
    """The first millisecond that isn't before ``us``."""
    return -(-us // 1000)


class _Times(StatefulProcessor):
    """Times of a key, cleared by a timer once they are older than ``span`` and ``delay`` allow."""

    def __init__(self, span: int, delay: int):
        self.span, self.delay = span, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "at long")

    def _held(self) -> list[int]:
        return sorted(x[0] for x in self.times.get()) if self.times.exists() else []

    def _keep(self, times: list[int]) -> None:
        if not times:
            return
        kept = times[bisect_left(times, times[-1] - self.span - self.delay) :]
        self.times.put([(t,) for t in kept])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(_ms(times[-1] + self.span) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


class Suppression(_Times):
    """Whether an alert's account was looked at within ``span`` before: see ``suppressed``."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        marks, out = self._held(), []
        batch = _rows(rows, "at", "is_alert")
        marks = sorted(marks + [r.at for r in batch if not r.is_alert])
        for r in batch:
            if r.is_alert:
                before = bisect_right(marks, r.at)
                out.append((r.alert_id, key[0], bool(before) and r.at - marks[before - 1] <= self.span))
        self._keep(marks)
        yield pd.DataFrame(out, columns=["alert_id", "account_id", "suppressed"])


def suppressed(events: DataFrame, minutes: int = 120, late: str = "5 minutes") -> DataFrame:
    """``alert_id``, ``account_id``, ``suppressed`` of a stream of alerts (``is_alert`` 1) and changes of status (0).

    ``events`` has ``account_id``, ``at`` (microseconds), ``ts`` (the same as a timestamp), ``alert_id`` and ``is_alert``. An
    account's state is the changes of the last ``minutes`` and the delay."""
    processor = Suppression(minutes * 60 * SECOND, int(pd.Timedelta(late).total_seconds()) * SECOND)
    return events.withWatermark("ts", late).groupBy("account_id").transformWithStateInPandas(processor, "alert_id long, account_id long, suppressed boolean", "Append", "EventTime")


class RuleVelocity(_Times):
    """Whether a key has more rows within ``span`` than allowed: see ``rule_velocity``."""

    def __init__(self, span: int, delay: int, most: int, least_amount: float | None):
        super().__init__(span, delay)
        self.most, self.bound = most, least_amount

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, "at", "transaction_id")
        times = sorted(self._held() + [r.at for r in batch if self.bound is None or r.amount <= self.bound])
        out = [(r.transaction_id, bisect_right(times, r.at) - bisect_left(times, r.at - self.span) > self.most) for r in batch]
        self._keep(times)
        yield pd.DataFrame(out, columns=["transaction_id", "many"])


def rule_velocity(txns: DataFrame, key: str, max_count: int, seconds: int, amount_threshold: float | None = None, late: str = "5 minutes") -> DataFrame:
    """``transaction_id`` and ``many``: whether more than ``max_count`` rows of the key (only those of at most
    ``amount_threshold``) lie within ``seconds`` up to the row. ``txns`` has ``at``, ``ts``, ``amount`` (double)."""
    processor = RuleVelocity(seconds * SECOND, int(pd.Timedelta(late).total_seconds()) * SECOND, max_count, amount_threshold)
    return txns.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, "transaction_id long, many boolean", "Append", "EventTime")


class Escalation(StatefulProcessor):
    """The way of a bucket's alerts up their policies' levels: see ``escalations``."""

    def __init__(self, policies):
        self.ends = {p["id"]: [sum(p["timeouts"][: k + 1]) * 60 * SECOND for k in range(len(p["timeouts"]))] for p in policies}
        self.policies = policies

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "alert_id long, created_us long, policy string, passed int")

    def _held(self) -> dict[int, tuple[int, str, int]]:
        return {r[0]: (r[1], r[2], r[3]) for r in self.records.get()} if self.records.exists() else {}

    def _keep(self, held: dict[int, tuple[int, str, int]]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.records.put([(alert, *record) for alert, record in held.items()])
            self.handle.registerTimer(_ms(min(created + self.ends[policy][passed] for created, policy, passed in held.values())))
        else:
            self.records.clear()

    def _until(self, held: dict[int, tuple[int, str, int]], alert: int, now: int, out: list) -> bool:
        """Go up the levels whose time is over at ``now``; whether the alert is still open."""
        created, policy, passed = held[alert]
        ends = self.ends[policy]
        while passed < len(ends) and created + ends[passed] <= now:
            passed += 1
            over = passed == len(ends)
            out.append((alert, policy, min(passed + 1, len(ends)), "timed_out" if over else "escalated", created + ends[passed - 1]))
        if passed == len(ends):
            del held[alert]
            return False
        held[alert] = (created, policy, passed)
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        for r in _rows(rows, "at", "is_ack"):
            if not r.is_ack:
                policy = next((p["id"] for p in self.policies if p["enabled"] and r.severity in p["severities"]), None)
                if policy is not None and r.alert_id not in held:
                    held[r.alert_id] = (r.at, policy, 0)
                    out.append((r.alert_id, policy, 1, "pending", r.at))
            elif r.alert_id in held and self._until(held, r.alert_id, r.at, out):
                _, policy, passed = held.pop(r.alert_id)
                out.append((r.alert_id, policy, passed + 1, "acknowledged", r.at))
        self._keep(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        for alert in list(held):
            self._until(held, alert, timerValues.getCurrentWatermarkInMs() * 1000, out)  # no row before the watermark comes any more
        self._keep(held)
        yield self._frame(out)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["alert_id", "policy", "level", "state", "at"])

    def close(self) -> None:
        pass


#: Groups that alerts are dealt to by their ids: a call of Python and a read of state serves all alerts of one.
BUCKETS = 1024


def escalations(events: DataFrame, policies, late: str = "5 minutes", buckets: int = BUCKETS) -> DataFrame:
    """``alert_id``, ``policy``, ``level``, ``state`` and ``at`` of every step of every alert: pending, escalated (at the end
    of a level's time), timed_out (at the last one's) or acknowledged.

    ``events`` has ``alert_id``, ``at``, ``ts``, ``severity`` and ``is_ack`` (0: the alert, 1: somebody took it). A timer fires
    when the watermark passes a level's end; a row that comes first takes the steps due by its own time, so steps don't
    depend on how rows are dealt to batches. State ends with the alert's last step. Alerts without a policy have none.
    State and timer are kept by bucket: its open alerts and the first of their levels' ends. A task holds a batch's
    rows and the open alerts of one bucket at a time."""
    keyed = events.withColumn("bucket", F.pmod(F.xxhash64("alert_id"), F.lit(buckets)))
    return keyed.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(Escalation(policies), "alert_id long, policy string, level int, state string, at long", "Append", "EventTime")


class Devices(StatefulProcessor):
    """What a device's past says: see ``devices``."""

    def __init__(self, new_us: int, many: int):
        self.new_us, self.many = new_us, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "n long, since long")
        self.customers = handle.getMapState("customers", "customer_id long", "first_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, since = self.past.get() if self.past.exists() else (0, None)
        met = {k[0] for k in self.customers.keys()} if self.customers.exists() else set()  # noqa: SIM118  a state, no dict
        out = []
        for r in _rows(rows, "at", "transaction_id"):
            known, age = r.customer_id in met, 0 if since is None else r.at - since
            fresh, trust = since is None or age < self.new_us, 0.3 if n == 0 else min(1.0, 0.5 + 0.01 * (n * (n + 1) / 2 - 1))
            risk = (0.3 if not known else 0.15 if fresh else 0.0) + (0.3 if len(met) >= self.many else 0.0) + max(0.0, 0.2 * (1 - trust))
            out.append((r.transaction_id, known, fresh, age / (86_400 * SECOND), len(met), trust, min(1.0, risk)))
            n, since = n + 1, r.at if since is None else min(since, r.at)
            if not known:
                met.add(r.customer_id)
                self.customers.updateValue((r.customer_id,), (r.at,))
        self.past.update((n, since))
        yield pd.DataFrame(out, columns=["transaction_id", "known", "is_new", "age_days", "accounts", "trust", "risk"])

    def close(self) -> None:
        pass


def devices(txns: DataFrame, new_days: float = 1.0, many: int = 3, late: str = "5 minutes") -> DataFrame:
    """``transaction_id``, ``known``, ``is_new``, ``age_days``, ``accounts``, ``trust`` and ``risk`` of a stream's rows that have a
    ``device_id``, by the rules of ``enrich.with_device``. State is a device's count, first time and customers."""
    processor = Devices(int(new_days * 86_400 * SECOND), many)
    schema = "transaction_id long, known boolean, is_new boolean, age_days double, accounts long, trust double, risk double"
    return txns.filter(F.col("device_id").isNotNull()).withWatermark("ts", late).groupBy("device_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def replayed(rows: DataFrame, shape, path: str) -> DataFrame:
    """``rows`` written as a table, streamed from there through ``shape`` to its end, and read back."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/in")
    with keyed_state(spark):
        stream = shape(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/marks").format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
