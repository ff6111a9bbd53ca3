"""Delivery windows on the wall clock of one zone, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Madrid"


def wall_clock(ts: Column, zone: str = ZONE) -> Column:
    """The local time of a UTC timestamp, as a timestamp."""
    return F.from_utc_timestamp(ts, zone)


def iso_weekday(ts: Column) -> Column:
    return (F.weekday(ts) + 1).cast("int")


def hour_in(hour: Column, start: Column, end: Column) -> Column:
    """start <= hour < end; a window with start after end goes over midnight, one with equal ends is never open."""
    return F.when(start < end, (hour >= start) & (hour < end)).when(start > end, (hour >= start) | (hour < end)).otherwise(False)


def window_open(local: Column, days: Column, start: Column, end: Column) -> Column:
    """Whether a digest may go at this local time; no days mean all days."""
    return ((F.size(days) == 0) | F.array_contains(days, iso_weekday(local))) & hour_in(F.hour(local), start, end)


def next_opening(local: Column, days: Column, start: Column, end: Column) -> Column:
    """The first full hour from local on at which the window is open, within 14 days; local itself if it is open now.

    The rest of today has one first open hour, and all other days have one, so the next day is looked for and not the hour.
    Only where the zone's clock is changed within those days, hours are tried one by one.
    """
    hour, now, today = F.date_trunc("hour", local), F.hour(local), iso_weekday(local)
    seconds, every = F.unix_seconds(hour), F.size(days) == 0

    def first(least: Column) -> Column:
        """The first open hour of a day from `least` on."""
        later = F.greatest(start, least)
        return F.when(start < end, F.when(later < F.least(end, F.lit(24)), later)).when(start > end, F.when(least < end, least).when(later < 24, later))

    ahead = F.array_min(F.transform(F.filter(days, lambda d: d.between(1, 7)), lambda d: F.pmod(d - today - 1, F.lit(7)) + 1))
    by_today = F.when(every | F.array_contains(days, today), first(now + 1))
    by_day = F.when(every, 1).otherwise(ahead) * 24 + first(F.lit(0))
    by_day = F.timestamp_seconds(seconds + (F.coalesce(by_today, by_day) - now) * 3600)
    later = F.transform(F.sequence(F.lit(1), F.lit(14 * 24)), lambda k: F.timestamp_seconds(seconds + k * 3600))
    by_hour = F.array_min(F.filter(later, lambda t: window_open(t, days, start, end)))
    steady = F.hour(F.timestamp_seconds(seconds + 14 * 86_400)) == now
    return F.when(window_open(local, days, start, end), local).when(steady, by_day).otherwise(by_hour)


def business_hours(local: Column) -> Column:
    return (iso_weekday(local) <= 5) & F.hour(local).between(8, 20)


# Hours at which a delivery window may start and end, intervals in hours, and the defaults.
START_HOURS, END_HOURS, INTERVALS = (7, 8, 9, 10, 11, 12), (19, 20, 21, 22, 23), (1, 2, 3, 4)
DEFAULT_START, DEFAULT_END, DEFAULT_INTERVAL = 8, 21, 2


def nearest(hour: Column, allowed: tuple[int, ...]) -> Column:
    """The allowed hour nearest to hour, the earlier of two."""
    return F.array_min(F.transform(F.array(*map(F.lit, allowed)), lambda h: F.struct(F.abs(h - hour), h.alias("h"))))["h"]


def clamped_preferences(days: Column, start: Column, end: Column, interval: Column) -> Column:
    """struct(days, start, end, interval) with what can't be replaced: no valid day means all days, null hours mean the
    defaults, others go to the nearest allowed ones."""
    valid = F.array_sort(F.array_distinct(F.filter(F.coalesce(days, F.array().cast("array<int>")), lambda d: d.between(1, 7))))
    first = nearest(F.coalesce(start, F.lit(DEFAULT_START)), START_HOURS)
    return F.struct(
        F.when(F.size(valid) == 0, F.array(*map(F.lit, range(1, 8)))).otherwise(valid).alias("days"),
        first.alias("start"),
        nearest(F.coalesce(end, F.lit(DEFAULT_END)), END_HOURS).alias("end"),
        F.when(interval.isin(*INTERVALS), interval).otherwise(DEFAULT_INTERVAL).alias("interval"),
    )


def preferences_fingerprint(p: Column) -> Column:
    """A text that changes if and only if clamped preferences do."""
    return F.to_json(F.struct(F.array_sort(p["days"]).alias("days"), p["start"].alias("start"), p["end"].alias("end"), p["interval"].alias("interval")))
