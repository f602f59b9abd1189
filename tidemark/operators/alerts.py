"""Alert gates whose decisions depend on earlier decisions, folded in time order for each key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Minutes since the last alert that was sent within which the same key is a duplicate.
DEDUP_MINUTES = 60
#: Alerts an account may send within an hour.
PER_ACCOUNT = 5


def fold(rows: Iterator[tuple[int, str]], minutes: int = DEDUP_MINUTES, cap: int = PER_ACCOUNT) -> Iterator[str]:
    """The gate's verdict for an account's alerts (time in microseconds, dedup key) in order.

    A duplicate is measured from the last alert sent with its key; duplicates and throttled alerts send nothing. Keeps
    at most ``cap`` times and one time for each key sent within the span."""
    sent: dict[str, int] = {}
    order: deque[tuple[int, str]] = deque()
    recent: deque[int] = deque()
    for us, key in rows:
        while order and us - order[0][0] >= minutes * 60_000_000:
            then, old = order.popleft()
            if sent.get(old) == then:
                del sent[old]
        if key in sent and us - sent[key] < minutes * 60_000_000:
            yield "duplicate"
            continue
        while recent and us - recent[0] >= HOUR:
            recent.popleft()
        if len(recent) >= cap:
            yield "throttled"
            continue
        sent[key] = us
        order.append((us, key))
        recent.append(us)
        yield "sent"


def gate(alerts: DataFrame) -> DataFrame:
    """``alert_id``, ``account_id``, ``verdict``; keys are account, rule ('none' if null) and severity.

    Rows of one account stay in one group: the state is an account's, which no system can split; sorting is done by
    Spark before the fold, which streams over the partition."""
    n = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = alerts.select("account_id", "created_us", "alert_id", F.concat_ws("|", F.coalesce("rule_id", F.lit("none")), "severity").alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, gate_ = None, None
        queue: deque[tuple[int, str]] = deque()
        for batch in batches:
            verdicts = []
            for a, us, key in zip(batch["account_id"], batch["created_us"], batch["key"], strict=True):
                if a != account:
                    account, queue = a, deque()
                    gate_ = fold(iter(queue.popleft, None))
                queue.append((us, key))
                verdicts.append(next(gate_))
            yield pd.DataFrame({"alert_id": batch["alert_id"], "account_id": batch["account_id"], "verdict": verdicts})

    dealt = rows.repartition(n, "account_id").sortWithinPartitions("account_id", "created_us", "alert_id")
    return dealt.mapInPandas(run, "alert_id long, account_id long, verdict string")


#: Allowed moves of an alert's life: fixed values.
TRANSITIONS = {
    "open": ("investigating", "resolved", "false_positive"),
    "investigating": ("resolved", "false_positive", "open"),
    "resolved": (),
    "false_positive": (),
}


def allowed(frm: str = "from_status", to: str = "to_status") -> Column:
    """Whether a move is in ``TRANSITIONS``."""
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat_ws(">", frm, to).isin(*pairs)
