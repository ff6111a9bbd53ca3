"""State with timers: digests that go out when they are due, a relay of alerts that expires, and a sink that repeats nothing.

Timers are of event time: they fire when the watermark passes them, for users without any new event as well. Inside a
batch an event sees all that was due before it, so the outcome does not depend on how events are cut into batches, as
long as batches come in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_S, DAY_S = 3_600, 86_400
#: Adverts that wait, seconds from new filters to a first digest, seconds after which an empty one is tried again, and first
#: digests in a day from the first of them.
KEEP, WARMUP_S, RETRY_S, WARMUPS = 3, 600, 300, 2
#: Alerts that a relay keeps, and seconds after the last one when it forgets them.
RELAY, RELAY_S = 50, DAY_S
#: Users whose ids differ in these last bits only share a value of state: at most 16.
SHARD_BITS = 4


@dataclass
class Turn:
    """When a user's digests are due, in seconds; -1 for never. A due time with nothing to send stays where it is, as the start of
    a grid of later tries, and has no timer until there is something."""

    queue: str = ""
    first_at: int = -1
    next_at: int = -1
    interval_s: int = 2 * HOUR_S
    day_from: int = -1
    used: int = 0

    STATE = "queue string, first_at long, next_at long, interval_s long, day_from long, used long"
    OUT = "user_id long, at long, reason string, items string"

    def due(self) -> int:
        """When the next digest goes out as things are; -1 for never."""
        times = [t for t in (self.first_at, self.next_at) if t >= 0]
        return min(times) if times and self.queue else -1

    def fire(self, at: int) -> list[tuple]:
        first = self.first_at == at
        items, self.queue = self.queue, ""
        self.next_at = at + self.interval_s
        if first:
            if self.day_from < 0 or at - self.day_from >= DAY_S:
                self.day_from, self.used = at, 0
            self.first_at, self.used = -1, self.used + 1
        return [(at, "first" if first else "cycle", items)]

    def apply(self, kind: str, at: int, value: int) -> list[tuple]:
        waiting = self.queue.split(",") if self.queue else []
        if kind == "match" and str(value) not in waiting:
            if not waiting:  # tries that found nothing have passed; the next one counts
                for name, step in (("first_at", RETRY_S), ("next_at", self.interval_s)):
                    t = getattr(self, name)
                    if 0 <= t < at:
                        setattr(self, name, t + -(-(at - t) // step) * step)
            self.queue = ",".join([*waiting, str(value)][-KEEP:])
        elif kind == "filter":
            if self.day_from < 0 or at - self.day_from >= DAY_S or self.used < WARMUPS:
                self.first_at = at + WARMUP_S
            if self.next_at < 0:
                self.next_at = at + self.interval_s
        elif kind == "interval":
            self.interval_s = value * HOUR_S
            if self.next_at > at + self.interval_s:
                self.next_at = at + self.interval_s
        return []


@dataclass
class Relay:
    """Alerts that wait for someone who can send them: the last RELAY of them, until RELAY_S after the last one."""

    queue: str = ""
    gone_at: int = -1

    STATE = "queue string, gone_at long"
    OUT = "user_id long, at long, reason string, items string"

    def due(self) -> int:
        return self.gone_at

    def fire(self, at: int) -> list[tuple]:
        items, self.queue, self.gone_at = self.queue, "", -1
        return [(at, "expired", items)]

    def apply(self, kind: str, at: int, value: int) -> list[tuple]:
        if kind == "alert":
            self.queue = ",".join([*(self.queue.split(",") if self.queue else []), str(value)][-RELAY:])
            self.gone_at = at + RELAY_S
        elif kind == "drain" and self.queue:
            items, self.queue, self.gone_at = self.queue, "", -1
            return [(at, "sent", items)]
        return []


def fold(s: Turn | Relay, events: list[tuple[int, str, int]]) -> list[tuple]:
    """Apply events (at, kind, value), in order, and all that is due up to each of them."""
    out = []
    for at, kind, value in events:
        while 0 <= s.due() <= at:
            out += s.fire(s.due())
        out += s.apply(kind, at, value)
    return out


class _Processor(StatefulProcessor):
    """One value of state for a shard of users, and one timer: when the first of them is due next. Calls, values and timers cost far
    more than events do, so a user has none alone."""

    def __init__(self, kind: type) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"timer long, users array<struct<user_id long, {self.kind.STATE}>>")

    def _load(self) -> tuple[int, dict[int, Turn | Relay]]:
        """The timer that is set, -1 for none, and what is known of each user."""
        timer, users = self.state.get() or (-1, ())
        return timer, {user: self.kind(*values) for user, *values in users}

    def _save(self, timer: int, users: dict[int, Turn | Relay]) -> None:
        due = min((t for s in users.values() if (t := s.due()) >= 0), default=-1)
        self.state.update((due, [(user, *astuple(s)) for user, s in users.items()]))
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer * 1000)
            if due >= 0:
                self.handle.registerTimer(due * 1000)

    def _given(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["user_id", "at", "reason", "items"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, users = self._load()
        columns = ("user_id", "at", "event_id", "kind", "value")
        events = sorted((int(user), int(at), int(event), kind, int(value)) for part in rows for user, at, event, kind, value in zip(*(part[c].tolist() for c in columns), strict=True))
        out = []
        for user, mine in groupby(events, itemgetter(0)):
            s = users.setdefault(user, self.kind())
            out += [(user, *x) for x in fold(s, [(at, kind, value) for _, at, _, kind, value in mine])]
        self._save(timer, users)
        yield from self._given(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, users = self._load()
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        for user, s in users.items():
            while 0 <= s.due() * 1000 <= passed:  # all whose own timer would fire now
                out += [(user, *x) for x in s.fire(s.due())]
        self._save(-1, users)  # Spark removes the timer that has fired
        yield from self._given(out)

    def close(self) -> None:
        pass


def timed(stream: DataFrame, kind: type = Turn) -> DataFrame:
    """user_id, at, reason, items that a Turn or Relay of each user gives out over a stream (user_id, event_id, at, kind,
    value): what is due goes out when the watermark has passed it, whether or not its user has another event."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the one that keeps timers
    events = stream.withColumns({"ts": F.timestamp_seconds("at"), "shard": F.shiftright("user_id", SHARD_BITS)}).withWatermark("ts", "0 seconds")
    return events.groupBy("shard").transformWithStateInPandas(_Processor(kind), kind.OUT, "append", "EventTime")


def deliver(stream: DataFrame, folder: str, checkpoint: str, after: Callable[[int], None] | None = None) -> None:
    """Run a stream of digests over what is there, and write its messages under folder: html, and text for where that is
    refused. A batch's messages are one folder of its number, written anew if the batch is repeated after a failure, so
    each message is there once. after(batch) is called once a batch is written."""

    def write(batch: DataFrame, number: int) -> None:
        lines = F.transform(F.split("items", ","), lambda x: F.concat(F.lit("advert "), x))
        title = F.initcap("reason")
        html = F.concat(F.lit("<b>"), title, F.lit("</b>\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<i>"), x, F.lit("</i>"))), "\n"))
        batch.select("user_id", "at", "reason", html.alias("html"), F.concat(title, F.lit("\n"), F.array_join(lines, "\n")).alias("text")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if after:
            after(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def delivered(spark, folder: str) -> DataFrame:
    """The messages that deliver() has written."""
    return spark.read.schema("user_id long, at long, reason string, html string, text string").parquet(folder)
