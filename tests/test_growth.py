"""Work that grows with distinct texts or days, not with rows or hours, gives what the plain way gives; shuffles go with their cuts."""

import collections
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import freetext, text, timewin
from tidemark.operators import dedup, ingest, matching, predicate
from tidemark.sources.shared import cut, with_known


def test_cut_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n and n.endswith(".data")}
    before = shuffled()
    found = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffled() <= before and found.count() == 7


def test_clean_up_by_plain_loops(spark):
    day = datetime(2024, 1, 1)
    rows = [(f"p{k}", "b", "m", 2000, 1000 * (k % 5 * 7), float(1000 + k), f"src{k % 3}", 100 if k % 2 else None, day, [None, "", f"http://x.example/{k % 4}"][k % 3]) for k in range(40)]
    cars = spark.createDataFrame(rows, "portal_id string, brand_norm string, model_norm string, year int, mileage_km int, price double, source_portal string, power_hp int, updated_at timestamp, url string")
    order = {r[0]: (int(r[6][3]), not r[7], r[5], r[0]) for r in rows}
    best = {}
    for r in rows:
        if r[9] and (r[9] not in best or order[r[0]] < order[best[r[9]]]):
            best[r[9]] = r[0]
    want = {r[0]: ("copy_of_url", best[r[9]]) for r in rows if r[9] and best[r[9]] != r[0]}
    kept = []
    for r in sorted((r for r in rows if r[0] not in want), key=lambda r: order[r[0]]):
        by = next((k for k in kept if abs(k[4] - r[4]) <= 1000 and abs(k[5] - r[5]) / ((k[5] + r[5]) / 2) <= 0.05), None)
        want[r[0]] = ("near_duplicate", by[0]) if by else ("keep", r[0])
        kept += [] if by else [r]
    got = {r.portal_id: (r.action, r.kept_id) for r in dedup.clean_up(cars).collect()}
    assert got == want and len({a for a, _ in want.values()}) == 3


@pytest.mark.parametrize("zone", ["UTC", "Europe/Madrid"])
@pytest.mark.parametrize("days,start,end", [((1, 3), 9, 21), ((), 22, 6), ((7,), 22, 6), ((5,), 0, 1), ((), 8, 8), ((2,), 23, 24), ((9,), 9, 10), ((), None, 5)])
def test_next_opening_is_that_of_trying_hours(spark, zone, days, start, end):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        base = int(datetime(2024, 3, 25).timestamp())
        rows = spark.createDataFrame([(base + 3607 * k,) for k in range(0, 400, 3)], "s long").withColumn("t", F.timestamp_seconds("s"))
        list_, a, b = F.array(*map(F.lit, days)).cast("array<int>"), F.lit(start).cast("int"), F.lit(end).cast("int")
        hours = F.transform(F.sequence(F.lit(1), F.lit(336)), lambda k: F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", "t")) + k * 3600))
        plain = F.when(timewin.window_open(F.col("t"), list_, a, b), F.col("t")).otherwise(F.array_min(F.filter(hours, lambda h: timewin.window_open(h, list_, a, b))))
        assert rows.where(~timewin.next_opening(F.col("t"), list_, a, b).eqNullSafe(plain)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbers_in_texts_as_by_three_searches(spark):
    said = ["around 70.000 please", "€ 12500", "12,5k for it 9 km", "80.000 km, about 15.500 euros", "70 kmh ~ 70k", "eur5000 eur", "x9 eur 10k11 kilometros € 3", "1.2.3, 4,5 €", "unos9 k", "2018 Golf 18k", "", None]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    lead, digits, unit = (F.regexp_extract_all(F.lower(F.coalesce("s", F.lit(""))), F.lit(freetext.NUMBER), F.lit(k)) for k in (1, 2, 3))
    plain = F.transform(F.arrays_zip(lead.alias("lead"), digits.alias("digits"), unit.alias("unit")), lambda x: F.struct(x["lead"].alias("lead"), x["digits"].alias("digits"), x["unit"].alias("unit")))
    got = rows.select(freetext._numbers(F.col("s")).cast("string").alias("a"), plain.cast("string").alias("b")).collect()
    assert all(r.a == r.b for r in got) and "12500" in got[1].a


def test_texts_are_worked_out_once(spark):
    rows = spark.createDataFrame([("1", " VW", "Golf", "x 150 CV", 0), ("2", None, None, None, 5), ("3", "Škoda", "3er", "0 TDI", None)], "portal_id string, brand string, model string, version string, power_hp int")
    normed = ingest.with_norms(rows.withColumn("brand_norm", F.lit("old")))
    assert [(r.brand_norm, r.model_norm, r.engine_norm, r.power_hp) for r in normed.orderBy("portal_id").collect()] == [("volkswagen", "golf", "x 150 cv", 150), ("", "", "", 5), ("skoda", "serie 3", "tdi", None)]
    drifted = ingest.drift(rows.withColumns({"brand_norm": F.lit("skoda"), "model_norm": F.lit("golf")}), {"brand_norm": ("brand", text.normalize_brand), "model_norm": ("model", text.normalize_model)})
    assert {r.portal_id: r.drifted for r in drifted.collect()} == {"1": "brand_norm", "2": "brand_norm,model_norm", "3": "model_norm"}
    assert "BroadcastHashJoin" in normed._jdf.queryExecution().executedPlan().toString()


def test_facts_meet_rows_by_a_hash_or_by_their_keys(spark):
    rows = spark.createDataFrame([(k, [None, "a", "b", ""][k % 4], [None, "b", "a"][k % 3]) for k in range(36)], "n int, x string, y string")
    known = rows.select("x", "y").distinct().withColumn("fact", F.concat_ws("/", F.coalesce("x", F.lit("-")), F.coalesce("y", F.lit("-"))))
    by_hash, by_keys = with_known(rows, known, ["x", "y"]), with_known(rows, known, ["x", "y"], most=3)
    assert "_h" in by_hash._jdf.queryExecution().optimizedPlan().toString() and "<=>" in by_keys._jdf.queryExecution().optimizedPlan().toString()
    for got in (by_hash, by_keys):
        assert got.columns == ["n", "x", "y", "fact"] and got.count() == 36
        assert all(r.fact == f"{'-' if r.x is None else r.x}/{'-' if r.y is None else r.y}" for r in got.collect())


@pytest.mark.parametrize("near_km", [None, 2000])
def test_matches_are_counted_by_classes(spark, near_km):
    rng = random.Random(7)
    pick = lambda *xs: rng.choice(xs)
    cars = [(f"c{k}", pick("audi", "bmw", None), pick("a4", "x1", None), pick("2.0 TDI S line", "1.0 TSI Hot", "v8", None), pick(1999, 2010, 2011, None), pick(0, 900, 2900, 4999, None), float(pick(0, 9, 10, 11, 500)) if k % 9 else None, pick("Diesel", "petrol", "", None), pick(None, 0, 99, 100, 150), pick("ES", "fr", None)) for k in range(150)]
    cars += [(f"d{k}", *cars[k % 3][1:]) for k in range(200)]
    kind = "portal_id string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string"
    asks = [(k, k % 9, pick("audi", "bmw", "", None), pick("a4", "", None), pick(10.0, 11.0, None), pick(2000, 2010, None), pick(100, 0, None), pick(900, 9_999_999, None), pick("", "Diesel", "diesel,petrol,x,y", None), pick("", "es,FR", None), pick("", "tdi", "1.0 TSI,v8", None), pick("", "", "S line,Base", "hot", None)) for k in range(60)]
    asked = "id long, user_id long, brand_norm string, model_norm string, max_price double, min_year int, min_power_hp int, max_km int, fuel_csv string, country_csv string, engine_csv string, trim_csv string"
    stock, alerts = spark.createDataFrame(cars, kind), spark.createDataFrame(asks, asked)
    given = [(rng.randrange(9), rng.choice(cars)[0]) for _ in range(40)]
    sent = spark.createDataFrame(given, "user_id long, listing_id string")
    trims = spark.createDataFrame([("audi", "a4", t) for t in ("Base", "S line", "Hot")], "brand string, model string, trim string")
    pairs = [(r.a_id, r.a_user_id, r.portal_id, r.price) for r in matching.matches(stock, alerts, trims).select("a_id", "a_user_id", "portal_id", "price").collect()]
    by_id = {c[0]: c for c in cars}

    def like(a, b):
        return a[0] == b[0] or near_km is not None and None not in (*a[1:3], *a[4:6]) and (*a[1:3], a[4]) == (*b[1:3], b[4]) and b[5] is not None and abs(a[5] - b[5]) <= near_km

    left = collections.Counter(u for _, u, p, _ in pairs if not any(u == v and like(by_id[p], by_id[q]) for v, q in given))
    assert {r.user_id: r.n for r in matching.unsent_counts(stock, alerts, sent, trims, near_km).collect()} == dict(left) and 0 < sum(left.values()) < len(pairs)
    want = {a: (sum(x[0] == a for x in pairs), min(x[2] for x in pairs if x[0] == a), sum(x[3] or 0 for x in pairs if x[0] == a)) for a, *_ in pairs}
    assert {r.id: (r.n, r.least_id, r.total or 0) for r in matching.totals(stock, alerts, trims).collect()} == want
    soft, wants = predicate.with_soft(stock, trims), predicate.with_wants(alerts)
    classes = predicate.with_classes(soft, wants).select("_brand", "_model", "price", "mileage_km", "year", "_power", "_base", *predicate.MET).distinct()
    assert classes.count() <= 150  # 350 adverts


def test_clean_up_takes_no_round_for_each_link_of_a_chain(spark, monkeypatch):
    rows = [(f"p{k:03}", "b", "m", 2000, 1000, 1000 * 1.03**k, "src0", 90, datetime(2024, 1, 1), f"http://x.example/{k}") for k in range(200)]
    cars = spark.createDataFrame(rows, "portal_id string, brand_norm string, model_norm string, year int, mileage_km int, price double, source_portal string, power_hp int, updated_at timestamp, url string")
    cuts = []
    monkeypatch.setattr(dedup, "cut", lambda df: cuts.append(1) or cut(df))
    got = {r.portal_id: r.kept_id for r in dedup.clean_up(cars).collect()}
    assert got == {f"p{k:03}": f"p{k - k % 2:03}" for k in range(200)} and len(cuts) < 10


def test_a_batch_of_one_block_is_folded_once(spark, monkeypatch):
    """A block of more than FOLD adverts, where the first of its neighbourhoods are taken over by cheaper ones again and again."""
    day, km = int(datetime(2024, 1, 1).timestamp()), [7 * k % 9_001 for k in range(21_000)]
    price = [10_000.0 + (k * 7919) % 3_001 for k in range(21_000)]
    cars = spark.range(21_000).select(F.format_string("p%06d", "id").alias("portal_id"), F.lit("b").alias("brand_norm"), F.lit("m").alias("model_norm"), F.lit(2000).alias("year"), (7 * F.col("id") % 9_001).cast("int").alias("mileage_km"), (10_000.0 + F.col("id") * 7919 % 3_001).alias("price"), F.timestamp_seconds(day - F.col("id")).alias("updated_at"))
    kept = []
    for k in range(21_000):
        at = next((i for i, j in enumerate(kept) if abs(km[j] - km[k]) <= 1000 and abs(price[j] - price[k]) / ((price[j] + price[k]) / 2) <= 0.05), None)
        if at is None:
            kept.append(k)
        elif price[k] < price[kept[at]]:
            kept[at] = k
    cuts = []
    monkeypatch.setattr(dedup, "cut", lambda df: cuts.append(1) or cut(df))
    assert sorted(r.portal_id for r in dedup.batch(cars).collect()) == sorted(f"p{k:06}" for k in kept) and len(cuts) < 5


def test_what_grows_with_the_tables_is_not_broadcast(spark, monkeypatch):
    """Files of cut are small, so counts by question, model and mileage went through the driver; a join of them is shuffled."""
    day = datetime(2024, 1, 1)
    cars = spark.createDataFrame([(f"c{k}", "audi", "a4", "2.0 TDI", 2010, 1000 * k, 9.0, "Diesel", 100, "ES", day) for k in range(40)], "portal_id string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string, updated_at timestamp")
    alerts = spark.createDataFrame([(k, k, "audi", 2000 + k % 5, 100.0) for k in range(30)], "id long, user_id long, brand_norm string, min_year int, max_price double")
    sent = spark.createDataFrame([(k, f"c{k}") for k in range(30)], "user_id long, listing_id string")
    planned = []
    monkeypatch.setattr(matching, "cut", lambda df: planned.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = matching.unsent_counts(cars, alerts, sent, near_km=2000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x and "s_cell" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    owned = [x for p in planned for x in p.split("\n") if "Join" in x and ("a_id" in x or "s_user" in x)]
    assert owned and all("SortMergeJoin" in x for x in owned)
    assert {r.user_id: r.n for r in got.collect()} == {k: sum(abs(k - j) > 2 for j in range(40)) for k in range(30)}


def test_a_refill_lists_no_adverts_like_sent_ones(spark, monkeypatch):
    day = datetime(2024, 1, 1)
    cars = spark.createDataFrame([(f"c{k:02}", "audi", f"m{k % 3}", "x", 2010, 1000 * k, 100.0 * 2**k, "Diesel", 100, "ES", day.replace(day=1 + k), day) for k in range(20)], "portal_id string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string, updated_at timestamp, url_verified_at timestamp")
    alerts = spark.createDataFrame([(u, u, "audi") for u in range(3)], "id long, user_id long, brand_norm string")
    sent = spark.createDataFrame([(1, "c19", day), (1, "c15", day), *[(2, f"c{k:02}", day.replace(day=20 - k)) for k in range(20)]], "user_id long, listing_id string, sent_at timestamp")
    monkeypatch.setattr(matching, "had_before", None)  # it lists them
    got = sorted((r.a_user_id, r["rank"], r.portal_id, r["pass"]) for r in matching.refill_of_stock(cars, alerts, sent, least=1).collect())
    first = {0: ["c19", "c18", "c17"], 1: ["c18", "c17", "c16"]}
    assert got == [(u, i + 1, p, 1) for u, ps in first.items() for i, p in enumerate(ps)] + [(2, i + 1, p, 2) for i, p in enumerate(["c19", "c18", "c17"])]
