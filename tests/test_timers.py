"""Streams with timers against a plain loop, over several batches and a restart; the sink after a failure."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemark.plans.streams import timed_events
from tidemark.sources.shared import shared_dir
from tidemark.streaming import timers as T


def plain(rows, kind, end):
    """Digests of each user's events in order, and what is due until the end of the stream."""
    out = set()
    for user in {r.user_id for r in rows}:
        s = kind()
        mine = sorted((r.at, r.event_id, r.kind, r.value) for r in rows if r.user_id == user)
        found = T.fold(s, [(at, k, v) for at, _, k, v in mine])
        while 0 <= s.due() <= end:
            found += s.fire(s.due())
        out |= {(user, *x) for x in found}
    return out


@pytest.mark.parametrize("kind", [T.Turn, T.Relay])
def test_timers_over_batches_and_a_restart(spark, small, tmp_path, kind):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timed_events(events, kind).persist()
    times = sorted(r.at for r in rows.collect())
    cuts = [times[0], *(times[len(times) * k // 3] for k in (1, 2)), times[-1] + 1]
    folder = f"{shared_dir(spark)}/{tmp_path.name}-{kind.__name__}"
    for k in range(3):  # each run starts anew from the checkpoint
        rows.where(F.col("at").between(cuts[k], cuts[k + 1] - 1)).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        T.deliver(T.timed(stream, kind), f"{folder}/out", f"{folder}/checkpoint")
    got = T.delivered(spark, f"{folder}/out").collect()
    want = plain(rows.collect(), kind, times[-1])
    assert {(r.user_id, r.at, r.reason, ",".join(x.removeprefix("advert ") for x in r.text.split("\n")[1:])) for r in got} == want
    assert len(got) == len(want) > 10 and {x[2] for x in want} == ({"first", "cycle"} if kind is T.Turn else {"sent", "expired"})


def test_a_repeated_batch_gives_each_message_once(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timed_events(events, T.Turn)
    folder = f"{shared_dir(spark)}/sink"
    rows.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    calls = []

    def fail_once(batch):
        calls.append(batch)
        if len(calls) == 1:
            raise RuntimeError("lost after the write, before the commit")

    with pytest.raises(Exception, match="lost after the write"):
        T.deliver(T.timed(stream), f"{folder}/out", f"{folder}/checkpoint", fail_once)
    T.deliver(T.timed(stream), f"{folder}/out", f"{folder}/checkpoint", fail_once)
    assert calls[:2] == [0, 0]
    got = [(r.user_id, r.at, r.reason) for r in T.delivered(spark, f"{folder}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == {x[:3] for x in plain(rows.collect(), T.Turn, max(r.at for r in rows.collect()))}


class Store:
    """A handle and a value of state that count what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.remove(ms)


def test_users_of_a_shard_share_calls_and_fire_when_due():
    store, users = Store(), range(16)
    p = T._Processor(T.Turn)
    p.init(store)
    rows = [(u, 10 * u + k, 100 + 10 * u + k, kind, u) for u in users for k, kind in enumerate(("filter", "match"))]
    part = pd.DataFrame(rows, columns=["user_id", "event_id", "at", "kind", "value"]).sample(frac=1, random_state=1)
    assert list(p.handleInputRows((0,), iter([part[:9], part[9:]]), TimerValues(0, 0))) == []
    assert store.calls == 3 and store.timers == {700_000}  # one value read, one written, one timer for 16 users
    fired = []
    for mark in (700_000, 749_999, 750_000, 900_000):  # due are 700, 710, ..., 850
        while (at := min(store.timers, default=mark + 1)) <= mark:
            fired += [(r.user_id, r.at) for out in p.handleExpiredTimer((0,), TimerValues(0, mark), ExpiredTimerInfo(at)) for r in out.itertuples()]
            store.timers.discard(at)  # as Spark does
        assert sorted(fired) == [(u, 700 + 10 * u) for u in users if 700 + 10 * u <= mark // 1000]
    assert store.timers == set()
    late = pd.DataFrame([(3, 999, 20_000, "match", 5)], columns=part.columns)
    assert list(p.handleInputRows((0,), iter([late]), TimerValues(0, 0))) == [] and store.timers == {(730 + 7_200 * 3) * 1000}  # the next of the cycles of user 3


def test_rules_of_a_turn():
    s = T.Turn()
    assert T.fold(s, [(0, "filter", 0), (100, "match", 5), (650, "match", 6)]) == [(600, "first", "5")]
    assert (s.next_at, s.queue, s.used) == (600 + 7_200, "6", 1)
    assert T.fold(s, [(9_000, "match", 7)]) == [(7_800, "cycle", "6")]
    s = T.Turn()
    assert T.fold(s, [(0, "filter", 0), (1_000, "match", 1), (5_000, "match", 2)]) == [(1_200, "first", "1")]  # tried at 600 and 900, sent at the next try
    assert T.fold(s, [(5_100, "filter", 0), (5_200, "match", 3), (5_800, "filter", 0)]) == [(5_700, "first", "2,3")] and s.first_at == -1  # the third of the day is refused
    assert T.fold(s, [(1_200 + 86_400, "filter", 0)]) == [] and s.first_at == 1_200 + 86_400 + 600
    s = T.Relay()
    assert T.fold(s, [(k, "alert", k) for k in range(60)] + [(100, "drain", 0), (200, "alert", 9), (200 + T.RELAY_S, "drain", 0)]) == [(100, "sent", ",".join(map(str, range(10, 60)))), (200 + T.RELAY_S, "expired", "9")]
