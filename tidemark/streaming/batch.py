"""Stateful rules of delivery as folds over a user's events in order of time; each is the batch twin of a stream."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import exact_sum


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), exact_sum(F.col("value")).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_DAY_US = 86_400_000_000


def budget(events: DataFrame, per_day: int, purposes: dict[str, int]) -> DataFrame:
    """Events that a daily budget admits: the first of each purpose up to its cap, and of those the first up to the
    day's. Counting per purpose first makes rollbacks needless."""
    day = F.to_date("ts")
    caps = F.create_map(*[F.lit(x) for pair in purposes.items() for x in pair])
    first = events.where(F.col("event_type").isin(*purposes)).withColumn("day", day)
    own = F.row_number().over(Window.partitionBy("day", "event_type").orderBy("ts", "event_id"))
    within = first.withColumn("own", own).where(F.col("own") <= caps[F.col("event_type")])
    whole = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    return within.withColumn("whole", whole).where(F.col("whole") <= per_day)


def _fold(events: DataFrame, f, schema: str) -> DataFrame:
    """Per user a fold over events in order; a user's events of the period are one group's rows, ids and times only."""
    slim = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"), "event_type", "value")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return f(group.sort_values(["us", "event_id"]))

    return slim.groupBy("user_id").applyInPandas(run, schema)


def rate_limit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """event_id, allowed: a window starts at the first hit after the last one ended and admits `most` hits."""
    def f(g: pd.DataFrame) -> pd.DataFrame:
        start, n, out = None, 0, []
        for us in g.us:
            if start is None or us - start >= seconds * 1_000_000:
                start, n = us, 0
            n += 1
            out.append(n <= most)
        return pd.DataFrame({"user_id": g.user_id, "event_id": g.event_id, "allowed": out})

    return _fold(events, f, "user_id long, event_id long, allowed boolean")


def cooldown(events: DataFrame, seconds: int) -> DataFrame:
    """event_id of alerts that are sent: an alert of a kind is held back until the last one sent is old enough."""
    def f(g: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, int] = {}
        out = []
        for us, kind, event_id in zip(g.us, g.event_type, g.event_id, strict=True):
            if kind not in last or us - last[kind] >= seconds * 1_000_000:
                last[kind] = us
                out.append(event_id)
        return pd.DataFrame({"user_id": [g.user_id.iloc[0]] * len(out), "event_id": out})

    return _fold(events, f, "user_id long, event_id long")


def bounded_queue(events: DataFrame, keep: int) -> DataFrame:
    """What each user's queue holds and delivers: clicks put an item in, keeping the last `keep`; purchases take one out."""
    def f(g: pd.DataFrame) -> pd.DataFrame:
        queue: deque[int] = deque(maxlen=keep)
        delivered = 0
        for kind, event_id in zip(g.event_type, g.event_id, strict=True):
            if kind == "click":
                queue.append(event_id)
            elif kind == "purchase" and queue:
                queue.popleft()
                delivered += 1
        return pd.DataFrame({"user_id": [g.user_id.iloc[0]], "delivered": [delivered], "waiting": [",".join(map(str, queue))]})

    return _fold(events, f, "user_id long, delivered long, waiting string")


def gap_reset(events: DataFrame, gap_days: int) -> DataFrame:
    """user_id, event_id, used: a counter that starts over after a gap, not after a rolling period: SQL windows do."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce(F.col("ts") - F.lag("ts").over(by_user) > F.expr(f"interval {gap_days} days"), F.lit(True))
    marked = events.withColumn("period", F.sum(fresh.cast("int")).over(by_user))
    return marked.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id", "period").orderBy("ts", "event_id")).alias("used"))


def request_quotas(events: DataFrame, per_day: int = 40, per_week: int = 280, lookups: int = 3, grace: int = 1) -> DataFrame:
    """user_id, event_id, admitted, looked_up of requests (event_type ask, lookup or broken) under coupled quotas.

    A request is refused if the day's or the week's count is full; a refused one counts for nothing. Counts of the day and its
    lookups start over when the day differs from that of the last admitted request, the week's when that is over seven
    days ago: a week of steady requests never starts over. An admitted lookup is carried out while the day has lookups
    left, one for a broken link by the day's grace as well.
    """
    def f(g: pd.DataFrame) -> pd.DataFrame:
        last, day, week, used, spared, out = None, 0, 0, 0, 0, []
        for us, kind in zip(g.us, g.event_type, strict=True):
            new_day, new_week = last is None or us // _DAY_US != last // _DAY_US, last is None or us - last > 7 * _DAY_US
            today, this_week = 0 if new_day else day, 0 if new_week else week
            if today >= per_day or this_week >= per_week:
                out.append((False, False))
                continue
            if new_day:
                used = spared = 0
            last, day, week = us, today + 1, this_week + 1
            looked = kind != "ask" and (used < lookups or (kind == "broken" and spared < grace))
            if looked and used < lookups:
                used += 1
            elif looked:
                spared += 1
            out.append((True, looked))
        return pd.DataFrame({"user_id": g.user_id, "event_id": g.event_id, "admitted": [a for a, _ in out], "looked_up": [b for _, b in out]})

    return _fold(events, f, "user_id long, event_id long, admitted boolean, looked_up boolean")
