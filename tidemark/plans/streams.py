"""Queries: windows, quotas, queues and subscriptions over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.shared import shared_dir
from ..streaming import batch as B
from ..streaming import delivery as L
from ..streaming import live
from ..streaming import timers as T
from .registry import Data, query


def _events(d: Data):
    return d.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 240 MINUTE GROUP BY ALL")
def lookback_window(d: Data):
    e = _events(d)
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 240 minutes")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_counts(d: Data):
    return B.tumbling(_events(d), "1 hour", "event_type")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding_counts(d: Data):
    return B.sliding(_events(d), "2 hours", "1 hour")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(d: Data):
    return B.sessions(_events(d), "6 hours")


@query("""WITH events AS (SELECT event_id, event_type, event_id // ((SELECT count(*) FROM events) // 10 + 1) AS batch, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 10 DAY ELSE ts END AS ts FROM events), b AS (SELECT batch, max(ts) AS top FROM events GROUP BY ALL), m AS (SELECT batch, date_trunc('milliseconds', max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) - INTERVAL 3 DAY AS mark FROM b)
SELECT event_type, count(*) AS n, count(*) FILTER (ts <= mark) AS late FROM events JOIN m USING (batch) GROUP BY ALL""")
def late_data_drop(d: Data):
    """Every eleventh event is ten days old when it arrives, in one of ten batches; the ingest drops what its watermark had
    passed when the batch before was planned, which is what Spark's operators hold for late."""
    events = _events(d).withColumn("ts", F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("interval 10 days")).otherwise(F.col("ts")))
    share = events.count() // 10 + 1
    folder = f"{shared_dir(d.spark)}/arrivals-{uuid.uuid4().hex}"
    for k in range(10):  # one file after another, as they would arrive
        events.where(F.floor(F.col("event_id") / share) == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = d.spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = live.ingest(stream, late="3 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    passed = d.spark.read.schema(events.schema).parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("passed"))
    return events.groupBy("event_type").agg(F.count("*").alias("n")).join(passed, "event_type", "left").select("event_type", "n", (F.col("n") - F.coalesce("passed", F.lit(0))).alias("late"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) AS own FROM events WHERE event_type IN ('click', 'error')),
w AS (SELECT *, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS whole FROM p WHERE own <= CASE event_type WHEN 'click' THEN 7 ELSE 4 END) SELECT event_id FROM w WHERE whole <= 9""")
def daily_budget(d: Data):
    return B.budget(_events(d), 9, {"click": 7, "error": 4}).select("event_id")


@query("SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, greatest(count(*) - 3, 0) AS over FROM events GROUP BY ALL")
def quota_day_window(d: Data):
    return _events(d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).withColumn("over", F.greatest(F.col("n") - 3, F.lit(0)))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id)::INT AS used FROM s""")
def quota_gap_reset(d: Data):
    return B.gap_reset(_events(d), 1)


_ROLES = {"signup": "checkout", "error": "cancel", "purchase": "resume", "view": "delete"}


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'checkout' WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'resume' ELSE 'delete' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('signup', 'error', 'purchase', 'view')),
s AS (SELECT user_id, 0::BIGINT AS k, 'unknown' AS state, 0::BIGINT AS applied, 0::BIGINT AS ignored FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT s.user_id, e.k, CASE WHEN kind = 'checkout' THEN 'vip' WHEN state = 'unknown' THEN 'unknown' WHEN kind = 'delete' THEN 'free' WHEN kind = 'cancel' THEN 'cancelling' WHEN state = 'cancelling' THEN 'vip' ELSE state END,
    applied + (kind = 'checkout' OR (state <> 'unknown' AND (kind = 'delete' OR (kind = 'cancel' AND state <> 'cancelling') OR (kind = 'resume' AND state = 'cancelling'))))::BIGINT,
    ignored + (NOT (kind = 'checkout' OR (state <> 'unknown' AND (kind = 'delete' OR (kind = 'cancel' AND state <> 'cancelling') OR (kind = 'resume' AND state = 'cancelling')))))::BIGINT
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, CASE state WHEN 'unknown' THEN 'free' ELSE state END AS state, applied, ignored FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def subscription_state(d: Data):
    roles = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    return L.subscriptions(_events(d).where(F.col("event_type").isin(*_ROLES)).withColumn("event_type", roles[F.col("event_type")]))


def delivery_events(events):
    """Events as a delivery stream: clicks are matches, views are ticks (every seventh with an advert from stock), sign-ups
    new filters, purchases other intervals."""
    kinds = F.create_map(*[F.lit(x) for pair in {"click": "match", "view": "tick", "signup": "filter", "purchase": "interval"}.items() for x in pair])
    value = F.when(F.col("event_type") == "purchase", F.col("event_id") % 8 + 1).when((F.col("event_type") == "view") & (F.col("event_id") % 7 != 0), 0).otherwise(F.col("event_id"))
    return events.where("event_type <> 'error'").select("user_id", "event_id", F.unix_seconds("ts").alias("at"), kinds[F.col("event_type")].alias("kind"), value.alias("value"))


@query()
def digest_delivery(d: Data):
    return L.digests(delivery_events(_events(d)))


def timed_events(events, kind=T.Turn):
    """Events for timers: clicks and views are matches, sign-ups new filters, purchases other intervals; for a relay errors
    and clicks are alerts, sign-ups drain it."""
    names = {"click": "match", "view": "match", "signup": "filter", "purchase": "interval"} if kind is T.Turn else {"error": "alert", "click": "alert", "signup": "drain"}
    kinds = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    value = F.when(F.col("event_type") == "purchase", F.col("event_id") % 8 + 1).otherwise(F.col("event_id"))
    return events.where(F.col("event_type").isin(*names)).select("user_id", "event_id", F.unix_seconds("ts").alias("at"), kinds[F.col("event_type")].alias("kind"), value.alias("value"))


def _run(d: Data, kind: type):
    """A stream with timers over the events that are there, its messages read again from the sink."""
    stream = live.event_stream(d.spark, d.sf_dir, d.table("events").schema)
    folder = f"{shared_dir(d.spark)}/timers-{uuid.uuid4().hex}"
    T.deliver(T.timed(timed_events(stream, kind), kind), f"{folder}/out", f"{folder}/checkpoint")
    return T.delivered(d.spark, f"{folder}/out")


@query()
def digest_timers(d: Data):
    return _run(d, T.Turn)


@query()
def relay_timers(d: Data):
    return _run(d, T.Relay)


@query("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM sent WHERE sent.user_id = events.user_id) AND event_type = 'click'", listings=True)
def unseen_clicks(d: Data):
    return L.unseen(_events(d).where("event_type = 'click'"), d.sent, ("user_id",)).select("event_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, (value * 100)::BIGINT % 50 ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def idempotent_ingest(d: Data):
    key = F.round(F.col("value") * 100).cast("long") % 50
    first = Window.partitionBy("user_id", key).orderBy("ts", "event_id")
    return _events(d).withColumn("r", F.row_number().over(first)).where("r = 1").select("event_id", "user_id")


@query()
def rate_limit_hits(d: Data):
    return B.rate_limit(_events(d), 2, 24 * 3600)


@query()
def cooldown_suppression(d: Data):
    return B.cooldown(_events(d), 3 * 24 * 3600)


@query()
def bounded_queue(d: Data):
    return B.bounded_queue(_events(d), 3)


@query()
def coupled_quotas(d: Data):
    """Every event is a request; purchases look something up, errors report a broken link."""
    kind = F.when(F.col("event_type") == "purchase", "lookup").when(F.col("event_type") == "error", "broken").otherwise("ask")
    return B.request_quotas(_events(d).withColumn("event_type", kind), 3, 9, 1, 1)
