"""Queries that SQL can't express, or not well, against plain loops; streams against their batch twins."""

from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, market, matching
from tidemark.plans import QUERIES
from tidemark.plans.streams import delivery_events
from tidemark.streaming import delivery, live

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def events(spark, small):
    rows = spark.read.parquet(f"{small}/events.parquet").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by.setdefault(r.user_id, []).append(r)
    return by


def test_rate_limit_hits(spark, small, events):
    want = set()
    for user, mine in events.items():
        start, n = None, 0
        for r in mine:
            if start is None or r.ts - start >= DAY:
                start, n = r.ts, 0
            n += 1
            want.add((user, r.event_id, n <= 2))
    got = QUERIES["rate_limit_hits"](spark, small).collect()
    assert {(r.user_id, r.event_id, r.allowed) for r in got} == want and len(got) == len(want)


def test_cooldown_suppression(spark, small, events):
    want = set()
    for user, mine in events.items():
        last = {}
        for r in mine:
            if r.event_type not in last or r.ts - last[r.event_type] >= 3 * DAY:
                last[r.event_type] = r.ts
                want.add((user, r.event_id))
    assert {(r.user_id, r.event_id) for r in QUERIES["cooldown_suppression"](spark, small).collect()} == want


def test_coupled_quotas(spark, small, events):
    """Each request against all admitted before it, counted anew."""
    want = set()
    for user, mine in events.items():
        admitted = []  # (time, counts as lookup, counts as grace, number in its week)
        for r in mine:
            same_day = [a for a in admitted if a[0].date() == r.ts.date()] if admitted and admitted[-1][0].date() == r.ts.date() else []
            in_week = admitted[-1][3] if admitted and r.ts - admitted[-1][0] <= 7 * DAY else 0
            if len(same_day) >= 3 or in_week >= 9:
                want.add((user, r.event_id, False, False))
                continue
            asks = r.event_type in ("purchase", "error")
            lookup = asks and sum(a[1] for a in same_day) < 1
            spared = not lookup and r.event_type == "error" and sum(a[2] for a in same_day) < 1
            admitted.append((r.ts, lookup, spared, in_week + 1))
            want.add((user, r.event_id, True, lookup or spared))
    got = QUERIES["coupled_quotas"](spark, small).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len({w[2:] for w in want}) == 3


def test_bounded_queue(spark, small, events):
    want = set()
    for user, mine in events.items():
        queue, delivered = deque(maxlen=3), 0
        for r in mine:
            if r.event_type == "click":
                queue.append(r.event_id)
            elif r.event_type == "purchase" and queue:
                queue.popleft()
                delivered += 1
        want.add((user, delivered, ",".join(map(str, queue))))
    assert {(r.user_id, r.delivered, r.waiting) for r in QUERIES["bounded_queue"](spark, small).collect()} == want


def test_dedup_greedy(spark, small):
    from tidemark.sources.tables import listing

    rows = listing(spark, small).collect()
    rows.sort(key=lambda r: (r.source_portal, not (r.power_hp or 0) > 0, r.price, -r.updated_at.timestamp(), r.portal_id))
    kept, want = {}, set()
    for r in rows:
        block = kept.setdefault((r.brand_norm, r.model_norm, r.year), [])
        first = next((k for k in block if abs(k.mileage_km - r.mileage_km) <= 1000 and abs(k.price - r.price) / max((k.price + r.price) / 2, 1) <= 0.05), None)
        if first is None:
            block.append(r)
        want.add((r.portal_id, (first or r).portal_id))
    got = QUERIES["dedup_greedy"](spark, small).collect()
    assert {r.portal_id for r in got} == {p for p, _ in want}
    assert {r.portal_id for r in got if r.portal_id == r.kept_id} == {p for p, k in want if p == k}


def test_digest_delivery_in_batch_and_as_a_stream(spark, small, tmp_path):
    raw = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = delivery_events(raw)
    want = {(r.user_id, r.at, r.reason, r["items"]) for r in QUERIES["digest_delivery"](spark, small).collect()}
    states, plain = {}, set()
    for r in sorted(rows.collect(), key=lambda r: (r.at, r.event_id)):
        if due := delivery.step(states.setdefault(r.user_id, delivery.fresh()), r.kind, r.at, r.value):
            plain.add((r.user_id, r.at, due[0], ",".join(map(str, due[1]))))
    assert plain == want and {x[2] for x in want} == {"first", "cycle"}
    ends = [r.at for r in rows.orderBy("at").collect()]
    for k in range(3):
        part = rows.where(F.col("at").between(ends[len(ends) * k // 3] + (1 if k else 0), ends[min(len(ends) - 1, len(ends) * (k + 1) // 3)]))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = live.run_once(delivery.digest_stream(stream), "digests_as_a_stream").collect()
    assert {(r.user_id, r.at, r.reason, r["items"]) for r in got} == want


def test_delivery_rules():
    s = delivery.fresh()
    assert delivery.step(s, "tick", 0, 0) is None and s["next_at"] == 7200  # nothing to send: the next turn
    delivery.step(s, "match", 10, 5)
    assert delivery.step(s, "tick", 100, 0) is None
    delivery.step(s, "interval", 200, 1)
    assert s["next_at"] == 200 + 3600  # a shorter interval shortens the wait
    delivery.step(s, "filter", 300, 0)
    assert delivery.step(s, "tick", 800, 0) is None  # the warm-up has not passed
    assert delivery.step(s, "tick", 900, 0) == ("first", [5]) and s["next_at"] == 900 + 3600 and s["used"] == 1
    delivery.step(s, "filter", 1000, 0)
    assert delivery.step(s, "tick", 1700, 0) is None and s["warmup_at"] == 2000 and s["used"] == 1  # empty: tried again, quota untouched
    assert delivery.step(s, "tick", 2000, 77) == ("first", [77])  # filled from stock
    for at in (3000, 4000):
        delivery.step(s, "filter", at, 0)
        delivery.step(s, "tick", at + 700, 9)
    assert s["used"] == 3 and s["warmup_at"] == -1  # the third was the last of the day
    delivery.step(s, "filter", 900 + 86_400, 0)
    assert s["warmup_at"] == 900 + 86_400 + 600


def test_ranged_values_match_sorting():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        values, weights = rng.integers(0, 20, n), rng.integers(1, 4, n)
        low = rng.integers(0, n, 50)
        high = np.array([rng.integers(x + 1, n + 1) for x in low])
        expanded = [np.sort(np.repeat(values[a:b], weights[a:b])) for a, b in zip(low, high, strict=True)]
        k = np.array([rng.integers(0, len(e)) for e in expanded])
        assert market.ranged_values(values, weights, low, high, k).tolist() == [int(e[i]) for e, i in zip(expanded, k, strict=True)]


def test_alerts_for_anything_are_no_nested_loop(spark):
    cars = spark.createDataFrame([(f"p{i}", "b", f"m{i % 3}", "2.0 TDI", y, 1000 * i, 5000.0, None, 0, "ES") for i, y in enumerate([None, 0, 1900, 1999, 2020, 2050, 2051, 9999])], "portal_id string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string")
    alerts = spark.createDataFrame([(1, 1, None, None), (2, 2, None, 2020), (3, 3, 6000, 1900), (4, 4, None, 2051), (5, 5, 2500, None)], "id long, user_id long, max_km int, min_year int").withColumns({"brand_norm": F.lit(None).cast("string"), "model_norm": F.lit("")})
    got = {}
    found = matching.matches(cars, alerts)
    for r in found.collect():
        got.setdefault(r.a_id, set()).add(r.portal_id)
    assert got == {1: {f"p{i}" for i in range(8)}, 2: {"p4", "p5", "p6", "p7"}, 3: {"p2", "p3", "p4", "p5", "p6"}, 4: {"p6", "p7"}, 5: {"p0", "p1", "p2"}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_alert_tests_everything(spark):
    base = dict(portal_id="p", brand_norm="audi", model_norm="a4", version="2.0 TDI", year=2020, mileage_km=50_000, price=20_000.0, fuel_type="Diesel", power_hp=150, country="ES", engine_norm="2.0 tdi")
    ask = dict(id=1, user_id=1, brand_norm="audi", model_norm="a4", max_price=None, min_year=None, min_power_hp=None, max_km=None, fuel_csv="", country_csv="", engine_csv="", trim_csv="")
    trims = spark.createDataFrame([("Audi", "A4", t) for t in ("Base", "S line", "Black line")], "brand string, model string, trim string")
    car_kind = "portal_id string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string, engine_norm string"
    ask_kind = "id long, user_id long, brand_norm string, model_norm string, max_price double, min_year int, min_power_hp int, max_km int, fuel_csv string, country_csv string, engine_csv string, trim_csv string"
    cases = [
        ({}, {}, True), ({}, {"engine_csv": "2.0 TDI"}, True), ({"engine_norm": "", "version": "A4 2.0 TDI S line"}, {"engine_csv": "2.0 tdi"}, True), ({"engine_norm": ""}, {"engine_csv": "3.0 tdi"}, False),
        ({"fuel_type": None, "version": "S line quattro"}, {"fuel_csv": "Diesel"}, False), ({"fuel_type": None, "version": "2.0 TDI S line"}, {"fuel_csv": "Diesel"}, True), ({"fuel_type": "Unknown"}, {"fuel_csv": "petrol,DIESEL"}, True),
        ({"brand_norm": "bmw"}, {}, False), ({"model_norm": "clase a"}, {"model_norm": "A-Class"}, True), ({"model_norm": "serie 4"}, {"model_norm": "4er"}, True), ({}, {"country_csv": "it,es"}, True), ({"country": None}, {"country_csv": "ES"}, False),
        ({"power_hp": None, "version": "1.5 dCi 115 CV"}, {"min_power_hp": 110}, True), ({"power_hp": 0, "version": "x"}, {"min_power_hp": 110}, False), ({"price": 14_001.0}, {"max_price": 14_000.0}, False), ({"price": None}, {"max_price": 14_000.0}, False),
        ({"year": None}, {"min_year": 2000}, False), ({}, {"max_km": 50_000}, True), ({}, {"max_km": 49_999}, False), ({"mileage_km": None}, {"max_km": 9_999_999}, True), ({"mileage_km": None}, {"max_km": 9_999_998}, False),
        ({"version": "2.0 TDI s-line"}, {"trim_csv": "S line"}, True), ({}, {"trim_csv": "Base"}, True), ({"version": "2.0 Blackline"}, {"trim_csv": "base"}, False), ({}, {"trim_csv": "S line"}, False), ({"brand_norm": "seat"}, {"brand_norm": None, "trim_csv": "Base"}, False),
        ({"version": None}, {"trim_csv": "S line"}, False),
    ]
    cars = spark.createDataFrame([tuple((base | car | {"portal_id": str(k)}).values()) for k, (car, _, _) in enumerate(cases)], car_kind)
    alerts = spark.createDataFrame([tuple((ask | wish | {"id": k, "user_id": k}).values()) for k, (_, wish, _) in enumerate(cases)], ask_kind)
    got = {r.a_id for r in matching.matches(cars, alerts, trims).where("portal_id = cast(a_id as string)").collect()}
    assert got == {k for k, (_, _, fits) in enumerate(cases) if fits}
    totals = {r.id: r.n for r in matching.totals(cars, alerts, trims).collect()}
    assert totals == {r.a_id: r.n for r in matching.matches(cars, alerts, trims).groupBy("a_id").agg(F.count("*").alias("n")).collect()}
