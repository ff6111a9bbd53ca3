"""Operators on small tables with known results, and properties over generated ones."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import dedup, fx, lifecycle, market, stats
from tidemark.operators.predicate import Scope
from tidemark.streaming import live

LISTING = "portal_id string, source_portal string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string, updated_at timestamp"


def listings(spark, rows):
    base = dict(portal_id="p", source_portal="src0", brand_norm="audi", model_norm="a4", version="2.0 TDI", year=2020, mileage_km=50_000, price=20_000.0, fuel_type=None, power_hp=None, country="ES", updated_at=datetime(2024, 1, 1))
    names = [x.split()[0] for x in LISTING.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], LISTING)


def test_scope_fills_fuel_and_power_softly(spark):
    rows = listings(spark, [dict(portal_id="a", version="2.0 TDI S line"), dict(portal_id="b", version="S line quattro"), dict(portal_id="c", fuel_type="Unknown", version="1.5 dCi 115 CV"), dict(portal_id="d", fuel_type="Petrol")])
    assert {r.portal_id for r in rows.where(Scope(fuels=("Diesel",)).matches()).collect()} == {"a", "c"}
    assert {r.portal_id for r in rows.where(Scope(min_power=110).matches()).collect()} == {"c"}
    assert rows.where(Scope().matches()).count() == 4


def test_scope_facets():
    s = Scope(brand="audi", model="a4", fuels=("Diesel",), max_price=1.0, countries=("ES",))
    assert s.without("model").model is None
    later = s.after("fuels", ("Petrol",))
    assert (later.brand, later.model, later.fuels, later.max_price, later.countries) == ("audi", "a4", ("Petrol",), None, ())


def near(a, b):
    return a[1] == b[1] and abs(a[2] - b[2]) <= 1000 and abs(a[3] - b[3]) / max((a[3] + b[3]) / 2, 1) <= 0.05


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"p{i:03}", 2018 + rng.randrange(2), rng.randrange(0, 9000, 250), 10_000 * 1.01 ** rng.randrange(40)) for i in range(120)]
    got = {(r.a_id, r.b_id) for r in dedup.near_pairs(listings(spark, [dict(portal_id=p, year=y, mileage_km=k, price=c) for p, y, k, c in rows])).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}


def test_greedy_keeps_no_near_pair(spark):
    rng = random.Random(4)
    rows = [(f"p{i:03}", 2020, rng.randrange(0, 6000, 500), 10_000.0 + rng.randrange(0, 2000, 100)) for i in range(60)]
    got = {r.portal_id: r.kept_id for r in dedup.greedy(listings(spark, [dict(portal_id=p, year=y, mileage_km=k, price=c) for p, y, k, c in rows])).collect()}
    kept = [r for r in rows if got[r[0]] == r[0]]
    assert not any(near(a, b) for a in kept for b in kept if a[0] < b[0])
    by = {r[0]: r for r in rows}
    assert all(near(by[p], by[k]) for p, k in got.items() if p != k)


def test_merge_of_parts_is_the_whole(spark, small):
    from tidemark.sources.tables import listing

    rows = listing(spark, small)
    merged = {r.brand_norm: (r.n, round(r.avg_price, 4), r.max_km) for r in stats.merge_rollups(rows.groupBy("brand_norm", "model_norm").agg(*stats.summary()), "brand_norm").collect()}
    whole = {r.brand_norm: (r.n, round(r.avg_price, 4), r.max_km) for r in rows.groupBy("brand_norm").agg(*stats.summary()).collect()}
    assert merged == whole


def test_too_few_comparables_have_no_score(spark):
    def scores(n):
        rows = listings(spark, [dict(portal_id=f"p{i}", price=10_000.0 + i) for i in range(n)])
        cars = spark.createDataFrame([("c", "audi", "a4", 2020, 50_000, 8_000.0)], "c_id string, c_brand string, c_model string, c_year int, c_km int, c_price double")
        return market.deal_scores(cars, rows).collect()

    assert scores(5) == []
    assert [(r.sample, r.median, r.pct) for r in scores(6)] == [(6, 10_002.5, 20)]


def test_fx(spark):
    def eur(amount, currency, rate):
        return spark.range(1).select(fx.looks_like_eur(F.lit(amount), F.lit(currency), F.lit(rate))).first()[0]

    assert eur(13_066.0, "HUF", 390.0) and not eur(124_000.0, "SEK", 11.5) and not eur(5_500_000.0, "HUF", 390.0)
    codes = spark.createDataFrame([("SE",), ("rs",), ("AT",), (None,), ("UK",)], "c string").select(fx.currency_of(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["SEK", "RSD", None, None, "GBP"]


def test_tiers_and_prune(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (200,), (201,), (500,), (501,)], "n int").select(lifecycle.tier(F.col("n"))).collect()] == [1, 1, 2, 2, 3]
    files = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2))], "path string, modificationTime timestamp")
    assert [r.path for r in lifecycle.expired_files(files, datetime(2024, 6, 1)).collect()] == ["a"]


def test_backup_round_trip(spark, tmp_path):
    rows = spark.range(10)
    lifecycle.backup(rows, str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump")).count() == 10


def test_streams_agree_with_their_batch_twins(spark, small):
    from tidemark.streaming import batch

    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = live.event_stream(spark, small, schema)
    got = {r.user_id: (r.delivered, r.waiting) for r in live.run_once(live.delivery_queue(stream), "queue", "update").collect()}
    assert got == {r.user_id: (r.delivered, r.waiting) for r in batch.bounded_queue(events, live.KEEP).collect()}
    assert live.run_once(live.ingest(live.event_stream(spark, small, schema)), "ingested").count() == events.select("event_id").distinct().count()
    counted = live.run_once(live.counts(live.event_stream(spark, small, schema)), "counted")
    assert 0 < counted.count() <= batch.tumbling(events, "1 hour", "event_type").count()
