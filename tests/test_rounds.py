"""Duplicates that are decided by rounds of joins, against plain loops in order."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import dedup
from tidemark.plans import QUERIES

CARS = "portal_id string, source_portal string, brand_norm string, model_norm string, year int, mileage_km int, price double, power_hp int, updated_at timestamp, url string"
DAY = datetime(2024, 1, 1)


def stock(seed, n, ids, urls, models=3):
    rng = random.Random(seed)
    return [
        (f"p{rng.randrange(ids)}", f"src{rng.randrange(5)}", "b", f"m{rng.randrange(models)}", 2020 + rng.randrange(2), rng.choice([None, *range(0, 30_000, 450)]), rng.choice([None, *(10_000.0 * 1.012**k for k in range(10))]), rng.choice([None, 0, 90]), DAY + timedelta(hours=i), rng.choice([None, "", *(f"u{k}" for k in range(urls))]))
        for i in range(n)
    ]


def near(a, b):
    return a[2:5] == b[2:5] and None not in (a[5], b[5], a[6], b[6]) and abs(a[5] - b[5]) <= 1000 and abs(a[6] - b[6]) / max((a[6] + b[6]) / 2, 1) <= 0.05


def batched(rows):
    kept, ids, urls = [], set(), set()
    for r in sorted(rows, key=lambda r: (-r[8].timestamp(), r[0])):
        if r[0] in ids or r[9] and r[9] in urls:
            continue
        at = next((i for i, k in enumerate(kept) if near(k, r)), None)
        if at is None:
            kept.append(r)
        elif r[6] < kept[at][6]:
            ids.discard(kept[at][0])
            urls.discard(kept[at][9])
            kept[at] = r
        else:
            continue
        ids.add(r[0])
        urls.add(r[9])
    return sorted(map(str, kept))


@pytest.mark.parametrize("seed, ids, urls, fold", [(1, 10_000, 10_000, 1_000), (2, 60, 60, 1_000), (3, 200, 40, 20), (4, 10_000, 10_000, 15), (5, 100, 200, 10)])
def test_ids_and_urls_count_over_all_blocks(spark, seed, ids, urls, fold):
    rows = stock(seed, 300, ids, urls)
    got = dedup.batch(spark.createDataFrame(rows, CARS), fold).collect()
    assert sorted(str(tuple(r)) for r in got) == batched(rows)


def test_a_corrected_year_is_one_advert(spark):
    rows = [("p1", "src0", "b", "m", 2018 + k, 9_000, 10_000.0, 1, DAY + timedelta(days=k), "") for k in range(2)] + [(f"q{k}", "src0", "b", f"m{k}", 2020, 9_000, 10_000.0, 1, DAY + timedelta(days=k), "u2") for k in range(2)]
    assert sorted((r.portal_id, r.year) for r in dedup.batch(spark.createDataFrame(rows, CARS), 1).collect()) == [("p1", 2019), ("q1", 2020)]


def preference(r):
    return (dedup.SOURCES.index(r[1]) + 1 if r[1] in dedup.SOURCES else 9, not (r[7] or 0) > 0, r[6] is not None, r[6] or 0, -r[8].timestamp(), r[0])


def plain_greedy(rows):
    kept, out = [], {}
    for r in sorted(rows, key=preference):
        first = next((k for k in kept if near(k, r)), None)
        if first is None:
            kept.append(r)
        out[r[0]] = (first or r)[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_by_rounds(spark, seed):
    rows = list({r[0]: r for r in stock(seed, 400, 10**9, 10)}.values())
    got = dedup.greedy(spark.createDataFrame(rows, CARS)).collect()
    assert {r.portal_id: r.kept_id for r in got} == plain_greedy(rows) and len(got) == len(rows)


def test_clean_up_drops_copies_of_a_url_first(spark):
    rows = list({r[0]: r for r in stock(7, 400, 10**9, 150)}.values())
    best = {}
    for r in sorted(rows, key=preference):
        if r[9]:
            best.setdefault(r[9], r[0])
    copies = {r[0]: ("copy_of_url", best[r[9]]) for r in rows if r[9] and best[r[9]] != r[0]}
    left = plain_greedy([r for r in rows if r[0] not in copies])
    want = copies | {p: ("keep" if p == k else "near_duplicate", k) for p, k in left.items()}
    got = dedup.clean_up(spark.createDataFrame([(*r[:9], f"HTTP://H/{r[9]}/#x" if r[9] and i % 2 else f"http://h/{r[9]}?utm_source=y" if r[9] else r[9]) for i, r in enumerate(rows)], CARS)).collect()
    assert {r.portal_id: (r.action, r.kept_id) for r in got} == want and len(got) == len(want)


def test_rounds_are_few_and_nothing_is_one_task(spark):
    """A block of 30 000 adverts: rounds of joins, and no group of Python rows in the plan."""
    rng = random.Random(1)
    rows = [(f"p{i}", f"src{rng.randrange(4)}", "b", "m", 2020, rng.randrange(300_000), 5_000.0 + rng.randrange(40_000), 90, DAY, "") for i in range(30_000)]
    cars = spark.createDataFrame(rows, CARS)
    edges = [(r.a_id, r.b_id) for r in dedup.near_pairs(cars).collect()]
    order = {r[0]: preference(r) for r in rows}
    directed = [(a, b) if order[a] < order[b] else (b, a) for a, b in edges]
    dropped, rounds = dedup.first_independent(spark.createDataFrame(directed, "first string, then string"))
    gone = set()
    for a, b in sorted(directed, key=lambda e: order[e[0]]):
        if a not in gone:
            gone.add(b)
    assert {r.then for r in dropped.collect()} == gone and 1 < rounds < 20
    assert "Pandas" not in dedup.greedy(cars)._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_meet_once(spark):
    rows = list({r[0]: r for r in stock(3, 300, 10**9, 10)}.values())
    got = [(r.a_id, r.b_id) for r in dedup.near_pairs(spark.createDataFrame(rows, CARS)).collect()]
    assert sorted(got) == sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if near(a, b))


def test_counts_and_rounds_write_no_pairs_down(spark, monkeypatch):
    """Copies of one place, prices under 1, repeated ids, several sources, blocks cut into tiles: against plain loops."""
    rng = random.Random(5)
    rows = stock(11, 250, 10**9, 10) + [(f"c{k}", f"src{k % 3}", "b", "m0", 2020, 9_000, 10_000.0, 90, DAY, "") for k in range(60)]
    rows += [(f"l{k}", rng.choice(["src0", None]), "b", "m0", 2020, 500 * k, rng.choice([0.0, 0.02, 0.96, 0.99, 1.0, 1.04, 3.0, 3.1]), 90, DAY, "") for k in range(40)] + [(f"l{k}", "src1", "b", "m0", 2020, 500 * k + 400, 3.05, 90, DAY, "") for k in range(5)]
    cars = spark.createDataFrame(rows, CARS)
    near_ones = [[b for b in rows if b[0] != a[0] and near(a, b)] for a in rows]
    places, portals = {}, {}
    for a, found in zip(rows, near_ones, strict=True):
        places.setdefault(a[2:7] if None not in a[2:7] else a[0], []).append(a[0])
        n, of = portals.get(a[0], (0, set()))
        portals[a[0]] = (n + len(found), of | {b[1] for b in found if b[1]})
    for counted in (10**6, 40, 1):
        monkeypatch.setattr(dedup, "_near_counts", lambda p, counted=counted, whole=WHOLE: whole(p, counted))
        got = sorted((r.portal_id, r.class_id, r.n_near) for r in dedup.near_links(cars).collect())
        assert got == sorted((a[0], min(places[a[2:7] if None not in a[2:7] else a[0]]), len(found)) for a, found in zip(rows, near_ones, strict=True))
        got = {r.portal_id: (r.n_near, r.n_portals) for r in dedup.near_portals(cars).collect()}
        assert got == {k: (n, len(of)) for k, (n, of) in portals.items() if n}
    once = list({r[0]: r for r in rows}.values())
    assert {r.portal_id: r.kept_id for r in dedup.greedy(spark.createDataFrame(once, CARS)).collect()} == plain_greedy(once)


WHOLE = dedup._near_counts


def test_the_query_of_near_pairs_gives_each_pair(spark, tmp_path):
    """A row per pair of adverts, not a count of them."""
    items = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(k, 1, 1, 1, q, p, "R", "F", DAY) for k, (q, p) in enumerate([(9.0, 1000.0), (9.0, 1000.0), (10.0, 1040.0), (11.0, 1000.0), (9.0, 1080.0), (30.0, 1000.0)])]
    tables = {"lineitem": (rows, items), "part": ([(1, "red", "Brand#1", "PROMO", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")}
    tables |= {"supplier": ([(1, 1)], "s_suppkey long, s_nationkey int"), "nation": ([(1, "NATION_1")], "n_nationkey int, n_name string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    cars = {f"{r[0]}-1-1-1": (r[4], r[5]) for r in rows}
    like = lambda a, b: abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) / ((a[1] + b[1]) / 2) <= 0.05
    want = sorted((a, b) for a in cars for b in cars if a < b and like(cars[a], cars[b]))
    assert sorted(map(tuple, QUERIES["near_dup_pairs"](spark, str(tmp_path)).select("a_id", "b_id").collect())) == want and len(want) == 5


@pytest.mark.parametrize("whole", [10**6, 150, 20, 1])
def test_greedy_goes_through_blocks_in_order(spark, whole):
    """Prices close together, so that each advert waits for a cheaper one: a chain as long as a block, whole and cut into tiles.
    Prices that are no numbers, and those under 1, are no pitfall."""
    rng = random.Random(9)
    rows = [(f"p{k}", "src0", "b", f"m{k % 2}", 2020, rng.choice([0, 900, 1500, 4000]), 5_000.0 * 1.004 ** (k // 2), 90, DAY, "") for k in range(700)]
    rows += [(f"q{k}", f"src{k % 5}", "b", "m0", 2020, rng.choice([-500, 900, None]), rng.choice([-3.0, 0.0, 0.97, 1.01, 5_000.0, 5_100.0, None]), rng.choice([None, 0, 90]), DAY, "") for k in range(120)]
    odd = [(f"n{k}", "src0", "b", "m0", 2020, 900, float(x), 90, DAY, "") for k, x in enumerate(["nan", "nan", "inf", "-inf"])]
    got = dedup.greedy(spark.createDataFrame(rows + odd, CARS), whole).collect()
    assert {r.portal_id: r.kept_id for r in got} == plain_greedy(rows) | {r[0]: r[0] for r in odd} and len(got) == len(rows) + 4
    assert len({r.kept_id for r in got}) > 50
