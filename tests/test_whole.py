"""Queries over small tables that earlier subsets left out, against brute force."""

import math
import random
import statistics
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, matching
from tidemark.plans import inventory
from tidemark.plans import matching as plans
from tidemark.plans import scalars

CARS = "portal_id string, brand string, model string, version string, brand_norm string, model_norm string, year int, mileage_km int, price double, country string, updated_at timestamp, url_verified_at timestamp, url string"
DAY = datetime(2024, 1, 1)


def cars(spark, seed, n):
    """Adverts of a few blocks, many of them near each other, with the rows as tuples."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = DAY + timedelta(days=rng.randrange(40))
        rows.append((f"p{i:03}", "B", "M", "V", "b", f"m{rng.randrange(2)}", 2020 + rng.randrange(2), rng.randrange(0, 4000, 300), 10_000.0 * 1.012 ** rng.randrange(10), "ES", day, day if rng.random() < 0.8 else None, f"u{rng.randrange(3 * n)}" if i % 3 else ""))
    return rows, spark.createDataFrame(rows, CARS)


def near(a, b):
    return a[4:7] == b[4:7] and abs(a[7] - b[7]) <= 1000 and abs(a[8] - b[8]) / max((a[8] + b[8]) / 2, 1) <= 0.05


def newest(rows):
    return sorted(rows, key=lambda r: (-r[10].timestamp(), r[0]))


newest_first = newest


def first_distinct(rows, n=3):
    kept = []
    for r in rows:
        if len(kept) < n and not any(near(k, r) for k in kept):
            kept.append(r)
    return [r[0] for r in kept]


def test_every_event_has_its_next_opening(spark):
    start = datetime(2024, 2, 26, 0, 30, 15)
    events = [(k * 37, start + timedelta(minutes=97 * k)) for k in range(200)]

    def opens(t):
        def fits(x):
            return x.isoweekday() in (1, 3) and 9 <= x.hour < 21

        hour = t.replace(minute=0, second=0)
        return str(t if fits(t) else next(x for k in range(1, 337) if fits(x := hour + timedelta(hours=k))))

    table = spark.createDataFrame(events, "event_id long, ts timestamp_ntz")
    got = scalars.next_opening(SimpleNamespace(table=lambda name: table)).collect()
    assert {r.event_id: r.opens for r in got} == {k: opens(t) for k, t in events}
    assert len(got) == len(events) and max(k for k, _ in events) > 3000


def batched(rows):
    """The reference's fold, as it stands."""
    kept, ids, urls = [], set(), set()
    for r in newest(rows):
        if r[0] in ids or r[12] and r[12] in urls:
            continue
        at = next((i for i, k in enumerate(kept) if near(k, r)), None)
        if at is None:
            kept.append(r)
        elif r[8] < kept[at][8]:
            ids.discard(kept[at][0])
            urls.discard(kept[at][12])
            kept[at] = r
        else:
            continue
        ids.add(r[0])
        urls.add(r[12])
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_a_cheaper_advert_replaces_a_near_one_in_a_batch(spark, seed):
    rows, table = cars(spark, seed, 120)
    rows = [(*r[:12], f"{r[5]}/{r[6]}/{r[12]}" if r[12] else "") for r in rows]  # a URL is of one block
    got = dedup.batch(spark.createDataFrame(rows + rows[:20], CARS)).collect()
    want = batched(rows + rows[:20])
    assert sorted(r.portal_id for r in got) == sorted(r[0] for r in want) and len(want) < len(rows) - 10
    assert dedup.batch(table.drop("url")).count() == len(batched([(*r[:12], "") for r in rows]))


def matched(spark, table, users=(1, 2, 3)):
    return table.crossJoin(spark.createDataFrame([(u, 10 * u + k) for u in users for k in range(u)], "a_user_id long, a_id long"))


@pytest.mark.parametrize("seed", range(3))
def test_near_adverts_take_one_place_of_a_digest(spark, seed):
    rows, table = cars(spark, seed, 60)
    got = matching.top_per_user(matched(spark, table)).collect()
    want = first_distinct(newest(r for r in rows if r[11]))
    assert {(r.a_user_id, r.rank, r.portal_id) for r in got} == {(u, k + 1, p) for u in (1, 2, 3) for k, p in enumerate(want)}
    assert len(got) == 3 * len(want)


def test_a_digest_of_copies_alone_is_shorter(spark):
    rows = [(f"p{i}", "B", "M", "V", "b", "m", 2020, 100 * i, 10_000.0, "ES", DAY + timedelta(days=i), DAY, "") for i in range(9)] + [("q", "B", "M", "V", "b", "n", 2020, 0, 9_000.0, "ES", DAY, DAY, "")]
    got = matching.top_per_user(matched(spark, spark.createDataFrame(rows, CARS), [1])).collect()
    assert sorted((r.rank, r.portal_id) for r in got) == [(1, "p8"), (2, "q")]


@pytest.mark.parametrize("seed", range(3))
def test_refill_skips_what_is_like_a_sent_advert(spark, seed):
    rows, table = cars(spark, seed, 60)
    sent = [(u, r[0], DAY + timedelta(hours=7 * j)) for u in (1, 2) for j, r in enumerate(random.Random(seed).sample(rows, 8 * u))]
    alerts = spark.createDataFrame([(u, 10 * u + k) for u in (1, 2, 3) for k in range(u)], "user_id long, id long")
    deliveries = spark.createDataFrame(sent, "user_id long, listing_id string, sent_at timestamp")
    had = matching.had_before(table.withColumns({"fuel_type": F.lit(None).cast("string"), "power_hp": F.lit(0)}), alerts, deliveries)
    got = matching.refill(matched(spark, table), had, deliveries).collect()
    by = {r[0]: r for r in rows}
    want = set()
    for u in (1, 2, 3):
        last = {p: t for v, p, t in sent if v == u}
        fresh = [r for r in newest(rows) if r[11] and not any(by[p][4:7] == r[4:7] and abs(by[p][7] - r[7]) <= 2000 for p in last) and r[0] not in last]
        again = sorted((r for r in rows if r[11] and r[0] in last), key=lambda r: last[r[0]])
        want |= {(u, k + 1, p, 2 if p in last else 1) for k, p in enumerate(first_distinct(fresh + again))}
    assert {(r.a_user_id, r.rank, r.portal_id, r["pass"]) for r in got} == want and len(got) == len(want)


def test_cheap_cars_have_a_score(spark):
    rng = random.Random(5)
    rows = [(f"p{i:03}", "b", f"m{rng.randrange(3)}", 2018 + rng.randrange(4), rng.randrange(0, 200_000, 20_000), float(rng.randrange(2_000, 90_000))) for i in range(200)]
    rows += [("few", "b", "rare", 2020, 0, 50_000.0), ("free", "b", "m0", 2020, 0, 0.0)]
    table = spark.createDataFrame(rows, "portal_id string, brand_norm string, model_norm string, year int, mileage_km int, price double")
    want = set()
    for p, _, m, y, k, c in rows:
        like = [(r[4], r[5]) for r in rows if r[2] == m and abs(r[3] - y) <= 1 and r[5] > 0]
        band = [x for x in like if abs(x[0] - k) <= max(20_000, k * 0.25)]
        used = [x[1] for x in (band if len(band) >= 6 else like)]
        if c > 0 and len(like) >= 6:
            mid = statistics.median(used)
            want.add((p, len(used), mid, math.floor((mid - c) / mid * 100 + 0.5)))
    got = plans.deal_score(SimpleNamespace(listing=table)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 190
    assert {r.c_id for r in plans.deal_score_labels(SimpleNamespace(listing=table)).collect()} == {w[0] for w in want}


def test_dear_adverts_are_written_and_met(spark):
    rows = [("new", "src1", "m", 1_000, 90_000.0), ("dear", "src0", "n", 1_000, 80_000.0), ("near", "src1", "m", 20_000, 50_000.0), ("like", "src0", "m", 20_500, 51_000.0), ("made", "src1", "m", 40_000, 70_000.0), ("had", "src1", "m", 30_000, 70_000.0), ("none", "src1", "m", 7_000, 70_000.0), ("cheap", "src1", "o", 1_000, 9_000.0)]
    table = spark.createDataFrame([(p, s, "b", m, 2020, k, c) for p, s, m, k, c in rows], "portal_id string, source_portal string, brand_norm string, model_norm string, year int, mileage_km int, price double")
    got = {r.portal_id: r.action for r in plans.write_actions(SimpleNamespace(listing=table)).collect()}
    assert got == {"new": "skipped_url", "near": "skipped_near", "made": "created", "had": "updated", "none": "skipped_url", "cheap": "skipped_url"}


def test_catalogs_of_whole_sources_are_compared(spark):
    rows = [("src0", "both", 95_000.0), ("src1", "both", 9_000.0), ("src0", "cheap a", 5_000.0), ("src1", "cheap b", 90_000.0), ("src1", "dear b", 99_000.0), ("src2", "other", 99_000.0)]
    table = spark.createDataFrame([(s, "B", m, "V", p) for s, m, p in rows], "source_portal string, brand string, model string, version string, price double")
    got = {(r.model.removeprefix("B ").removesuffix(" V"), r.side) for r in inventory.catalog_parity(SimpleNamespace(listing=table)).collect()}
    assert got == {("cheap a", "only_a"), ("cheap b", "only_b"), ("dear b", "only_b")}


def test_every_old_dump_is_pruned(spark):
    table = spark.createDataFrame([(k, DAY + timedelta(days=k)) for k in range(1, 30)], "event_id long, ts timestamp_ntz")
    got = {r.path for r in plans.backup_prune(SimpleNamespace(table=lambda name: table)).collect()}
    assert got == {f"dump-{k}" for k in range(1, 22)}


def test_the_text_of_a_digest(spark):
    kind = "a_user_id long, rank int, portal_id string, brand string, model string, version string, year int, price double, mileage_km int, country string"
    top = spark.createDataFrame([(1, 2, "p2", "Seat", "León", None, 2019, 9_500.9, 80_000, "ES"), (1, 1, "p1", "Audi", "A4", "2.0 TDI", 2020, 20_000.0, 50_000, None), (2, 1, "p3", "Kia", "Rio", "1.2", None, 7_000.0, None, "PT")], kind)
    badges = spark.createDataFrame([("p1", "10 % below the market")], "portal_id string, badge string")
    copies = spark.createDataFrame([("p1", 2), ("p2", 1), ("p3", 0)], "portal_id string, n_portals long")
    got = {r.user_id: r.message for r in matching.digest_text(top, badges, copies).collect()}
    assert got[1] == "2 new matches\n#1: Audi A4 2.0 TDI | 2020 | 20000 EUR | 50000 km | 10 % below the market | also on 2 other portals | link p1\n#2: Seat León | 2019 | 9500 EUR | 80000 km | ES | also on 1 other portal | link p2"
    assert got[2] == "1 new match\n#1: Kia Rio 1.2 | 7000 EUR | PT | link p3"


@pytest.mark.parametrize("newest", [(), (1 / 16,), (1 / 50, 1 / 3)])
def test_digests_out_of_the_newest_share_are_the_same(spark, newest):
    rows, table = cars(spark, 5, 150)
    table = table.withColumns({"fuel_type": F.lit(None).cast("string"), "power_hp": F.lit(0)})
    alerts = spark.createDataFrame([(1, 1, "m0", None), (2, 1, "m1", 2021), (3, 2, "m0", None), (4, 3, "m1", 2022), (5, 4, None, 2021)], "id long, user_id long, model_norm string, min_year int").withColumn("brand_norm", F.lit("b"))
    asks = {1: [("m0", 0), ("m1", 2021)], 2: [("m0", 0)], 3: [("m1", 2022)], 4: [(None, 2021)]}
    want = set()
    for user, wishes in asks.items():
        fits = [r for r in newest_first(rows) if r[11] and any(m in (None, r[5]) and r[6] >= y for m, y in wishes)]
        want |= {(user, k + 1, p) for k, p in enumerate(first_distinct(fits))}
    got = matching.top_digests(table, alerts, newest=newest).collect()
    assert {(r.a_user_id, r.rank, r.portal_id) for r in got} == want and len(got) == len(want) > 6
