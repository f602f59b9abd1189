"""Streams with timers over several batches, with late rows, against the rules on all rows at once."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.streaming import stateful

M = 60_000_000
#: Added to all times, as the first watermark is the epoch.
EPOCH = 1000 * M


@pytest.fixture
def play(spark, tmp_path):
    """Batches given one by one, as files; the rows that come out."""

    def run(batches, schema, shape):
        source = tmp_path / "in"
        for k, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema).withColumn("at", F.col("at") + EPOCH).withColumn("ts", F.timestamp_micros("at"))
            df.coalesce(1).write.mode("append").parquet(str(source))
            with stateful.keyed_state(spark):
                stream = shape(spark.readStream.schema(df.schema).parquet(str(source)))
                stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "marks")).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        return [tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()]

    return run


def test_escalation_timers(play):
    """An alert rises by timers when other alerts push the watermark on, and a tardy acknowledgement counts by its own time."""
    at = lambda m: m * M
    batches = [
        [(1, at(0), "critical", 0), (2, at(1), "low", 0), (3, at(2), "high", 0)],
        [(4, at(40), "medium", 0), (1, at(36), "critical", 1)],
        [(3, at(38), "high", 1), (4, at(41), "medium", 1), (4, at(300), "medium", 1), (5, at(301), "critical", 0)],
        [(6, at(500), "high", 0)],
        [(7, at(510), "low", 0)],
    ]
    got = play(batches, "alert_id long, at long, severity string, is_ack int", lambda s: stateful.escalations(s, lifecycle.POLICIES))
    assert got
    steps = {}
    for alert, _, level, state, when in sorted(got, key=lambda r: (r[0], r[4], r[2])):
        steps.setdefault(alert, []).append((level, state, (when - EPOCH) // M))
    assert steps[1] == [(1, "pending", 0), (2, "escalated", 5), (3, "escalated", 20), (3, "acknowledged", 36)]
    assert steps[3] == [(1, "pending", 2), (2, "escalated", 17), (2, "acknowledged", 38)]
    assert steps[4] == [(1, "pending", 40), (1, "acknowledged", 41)]
    assert steps[5] == [(1, "pending", 301), (2, "escalated", 306), (3, "escalated", 321), (4, "escalated", 351), (4, "timed_out", 411)]
    assert 2 not in steps and 7 not in steps and steps[6] == [(1, "pending", 500)]


def test_suppression_over_batches(play):
    """A change counts in later batches until the pause is over; a late alert sees the change before its own time."""
    batches = [
        [(1, 10 * M, None, 0), (1, 12 * M, 100, 1), (1, 9 * M, 101, 1), (2, 12 * M, 102, 1)],
        [(1, 60 * M, None, 0), (1, 11 * M, 103, 1), (1, 131 * M, 104, 1)],
        [(1, 181 * M, 105, 1), (2, 182 * M, 106, 1)],
        [(1, 179 * M, 107, 1), (1, 400 * M, 108, 1)],
    ]
    got = play(batches, "account_id long, at long, alert_id long, is_alert int", lambda s: stateful.suppressed(s, 120))
    assert {r[0]: r[2] for r in got} == {100: True, 101: False, 102: False, 103: True, 104: True, 105: False, 106: False, 107: True, 108: False}


def test_rule_velocity_over_batches(play):
    batches = [[(1, 7, 0, 5.0), (2, 7, M, 900.0), (3, 7, 2 * M, 1.0)], [(4, 7, 61 * M, 2.0), (5, 7, 61 * M, 2.0), (6, 8, 61 * M, 2.0)], [(7, 7, 200 * M, 1.0)]]
    got = play(batches, "transaction_id long, account_id long, at long, amount double", lambda s: stateful.rule_velocity(s, "account_id", 2, 3600, 100.0))
    assert dict(got) == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_devices_over_batches(play):
    day = 86_400_000_000
    batches = [[(1, 1, 0, 5), (2, 1, M, 5), (3, 2, 2 * M, 5), (9, 4, M, None)], [(4, 3, 2 * day, 5), (5, 1, 2 * day + 1, 5), (6, 9, 2 * day + 2, 6)]]
    got = {r[0]: r[1:] for r in play(batches, "transaction_id long, customer_id long, at long, device_id long", stateful.devices)}
    assert [got[i][:2] for i in (1, 2, 3, 4, 5, 6)] == [(False, True), (True, True), (False, True), (False, False), (True, False), (False, True)]
    assert [got[i][3] for i in (1, 2, 3, 4, 5, 6)] == [0, 1, 1, 2, 3, 0] and got[5][5] == pytest.approx(0.3 + 0.2 * (1 - 0.59)) and 9 not in got


def test_escalations_are_kept_by_bucket(play):
    """Alerts share calls, state and timers by bucket; steps are those of each alert."""
    batches = [[(i, i * M // 10, "critical" if i % 2 else "high", 0) for i in range(300)], [(i, 31 * M, "high", 1) for i in range(0, 300, 4)], [(999, 500 * M, "low", 0)]]
    got = play(batches, "alert_id long, at long, severity string, is_ack int", lambda s: stateful.escalations(s, lifecycle.POLICIES, buckets=3))
    assert {r[0] for r in got} == set(range(300))
    steps = {}
    for alert, _, level, state, when in got:
        steps.setdefault(alert, []).append((when - EPOCH, level, state))
    for i in range(300):
        at, waits = i * M // 10, (5, 15, 30, 60) if i % 2 else (15, 30, 60)
        ends, want = [at + sum(waits[: k + 1]) * M for k in range(len(waits))], [(at, 1, "pending")]
        ack = 31 * M if i % 4 == 0 else None
        due = [e for e in ends if ack is None or e <= ack]
        want += [(e, min(k + 2, len(ends)), "timed_out" if k + 1 == len(ends) else "escalated") for k, e in enumerate(due)]
        want += [(ack, len(due) + 1, "acknowledged")] if ack is not None and len(due) < len(ends) else []
        assert sorted(steps[i]) == sorted(want)
