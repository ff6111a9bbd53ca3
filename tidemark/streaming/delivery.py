"""Subscriptions and digests as state: the same small steps fold a user's events in batch and in a stream.

A user's state is a handful of numbers and a queue of at most KEEP adverts, so state is bounded whatever the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP, WARMUP_S, RETRY_S, DAY_S, HOUR_S = 3, 600, 300, 86_400, 3_600
#: First digests after a change of filters within a day, and the hours between digests at first.
WARMUPS, INTERVAL_H = 3, 2

DUE = "user_id long, at long, reason string, items string"
STATE = "queue array<long>, warmup_at long, next_at long, interval_s long, day_from long, used long"


def subscriptions(events: DataFrame) -> DataFrame:
    """user_id, state, applied, ignored from events (user_id, event_id, ts, event_type).

    checkout makes vip; cancel makes cancelling; resume makes a cancelling one vip again; delete makes free. Before the
    first checkout nobody is known, so other events are ignored, as are a cancel while cancelling and a resume while not.
    A state is what the last event that sets it left, and whether a resume came after it: windows do, without a fold.
    """
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sets = F.col("event_type").isin("checkout", "cancel", "delete")
    e = events.withColumn("known", F.max((F.col("event_type") == "checkout").cast("int")).over(by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    e = e.withColumn("period", F.sum(F.when((F.col("known") == 1) & sets, 1).otherwise(0)).over(by_user))
    in_period = Window.partitionBy("user_id", "period").orderBy("ts", "event_id")
    before = in_period.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("left", F.first("event_type").over(in_period.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    e = e.withColumn("resumed", F.coalesce(F.max((F.col("event_type") == "resume").cast("int")).over(before), F.lit(0)))
    now = F.when((F.col("left") == "cancel") & ((F.col("resumed") == 1) | (F.col("event_type") == "resume")), "vip").when(F.col("left") == "cancel", "cancelling").when(F.col("left") == "checkout", "vip").otherwise("free")
    e = e.withColumn("state", F.when(F.col("period") > 0, now).otherwise("free"))
    earlier = F.coalesce(F.lag("state").over(by_user), F.lit("free"))
    resume = (F.col("event_type") == "resume") & (earlier == "cancelling")
    used = (F.col("known") == 1) & (F.when(F.col("event_type") == "resume", resume).when(F.col("event_type") == "cancel", earlier != "cancelling").otherwise(True))
    e = e.withColumn("used", used)
    return e.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count_if("used").alias("applied"), F.count_if(~F.col("used")).alias("ignored"))


def fresh() -> dict:
    return {"queue": [], "warmup_at": -1, "next_at": -1, "interval_s": INTERVAL_H * HOUR_S, "day_from": -1, "used": 0}


def step(s: dict, kind: str, at: int, value: int) -> tuple[str, list[int]] | None:
    """Apply an event at second `at` to a state; returns (reason, adverts) if it makes a digest go out.

    match queues an advert, the last KEEP stay. filter asks for a first digest soon, some times a day. interval sets the hours
    between digests and shortens a longer wait. tick sends what is due: a first digest before any regular one. With an
    empty queue, value (an advert from stock, 0 for none) fills in; if there is none a first digest is tried again soon
    and a regular one waits for its next turn.
    """
    if kind == "match":
        if value not in s["queue"]:
            s["queue"] = [*s["queue"], value][-KEEP:]
    elif kind == "filter":
        if s["day_from"] < 0 or at - s["day_from"] >= DAY_S:
            s["day_from"], s["used"] = -1, 0
        if s["used"] < WARMUPS:
            s["warmup_at"] = at + WARMUP_S
    elif kind == "interval":
        s["interval_s"] = value * HOUR_S
        if s["next_at"] > at + s["interval_s"]:
            s["next_at"] = at + s["interval_s"]
    elif kind == "tick":
        first = s["warmup_at"] >= 0
        if at < (s["warmup_at"] if first else s["next_at"]):
            return None
        items = s["queue"] or ([value] if value else [])
        if not items and first:
            s["warmup_at"] = at + RETRY_S
            return None
        s["next_at"] = at + s["interval_s"]
        if not items:
            return None
        if first:
            if s["day_from"] < 0:
                s["day_from"] = at
            s["warmup_at"], s["used"] = -1, s["used"] + 1
        s["queue"] = []
        return "first" if first else "cycle", items
    return None


def _fold(user: int, rows: pd.DataFrame, s: dict) -> pd.DataFrame:
    out = []
    for at, kind, value in zip(rows["at"], rows.kind, rows.value, strict=True):
        if due := step(s, kind, int(at), int(value)):
            out.append((user, int(at), due[0], ",".join(map(str, due[1]))))
    return pd.DataFrame(out, columns=["user_id", "at", "reason", "items"])


def digests(events: DataFrame) -> DataFrame:
    """user_id, at, reason, items of every digest of events (user_id, event_id, at, kind, value): a fold per user in order."""
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _fold(key[0], group.sort_values(["at", "event_id"]), fresh())

    return events.groupBy("user_id").applyInPandas(run, DUE)


def digest_stream(stream: DataFrame) -> DataFrame:
    """The same over a stream, whose batches are in order of time: state lives between batches."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(fresh(), state.get, strict=True)) if state.exists else fresh()
        s["queue"] = [int(x) for x in s["queue"]]
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = _fold(key[0], rows, s)
        state.update(tuple(s.values()))
        yield out

    return stream.groupBy("user_id").applyInPandasWithState(run, DUE, STATE, "append", GroupStateTimeout.NoTimeout)


def unseen(stream: DataFrame, sent: DataFrame, keys: tuple[str, ...] = ("user_id", "listing_id")) -> DataFrame:
    """Rows of a stream, or a table, that were not sent before: the seen-set is a table, so it needs no state."""
    return stream.join(sent.select(*keys).distinct(), list(keys), "left_anti")
