"""The guarded merge and the verification cycle against plain loops, one advert at a time."""

import random
from datetime import datetime

import pytest

from tidemark.operators import merge

CARS = "portal_id string, url string, brand_norm string, model_norm string, year int, mileage_km int, price double, fuel_type string, power_hp int, url_verified_at timestamp"
THEN, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def near(a, b):
    return tuple(a[2:5]) == tuple(b[2:5]) and None not in a[2:7] and None not in b[2:7] and abs(a[5] - b[5]) <= 1000 and abs(a[6] - b[6]) / max((a[6] + b[6]) / 2, 1) <= 0.05


def car(rng, pid, url, verified=None):
    return (pid, url, "b", rng.choice(["m", "n", None]), 2020, rng.choice([None, *range(0, 9_000, 700)]), rng.choice([None, *(10_000.0 * 1.015**k for k in range(9))]), rng.choice([None, "Diesel", "Petrol"]), rng.choice([None, 90]), verified)


def plain(target, batch):
    """The same rules in a loop; batch has a place in the order as last field."""
    state = {r[0]: list(r) for r in target}
    last, count = {}, {}
    for r in sorted(batch, key=lambda r: r[-1]):
        count[r[0]] = count.get(r[0], 0) + 1
        if r[1] or r[0] not in last or not last[r[0]][1]:
            last[r[0]] = r
    actions = {p: "skipped_url" for p in last}
    rows = sorted((r for r in last.values() if r[1]), key=lambda r: (r[-1], r[0]))
    moves = [r for r in rows if r[0] in state and state[r[0]][1] != r[1]]
    moving, refused = {r[0] for r in moves}, set()
    while True:
        held = {s[1] for p, s in state.items() if p not in moving or p in refused}
        seen, more = set(), set()
        for r in moves:
            if r[0] not in refused:
                if r[1] in held or r[1] in seen:
                    more.add(r[0])
                seen.add(r[1])
        if not more:
            break
        refused |= more
    for r in rows:
        if r[0] in state and r[0] not in refused:
            s = state[r[0]]
            if s[1] != r[1]:
                s[9] = None
            s[1], s[5], s[6] = r[1], r[5], r[6]
            s[7], s[8], s[9] = r[7] or s[7], r[8] or s[8], r[9] or s[9]
            actions[r[0]] = "updated"
    for r in rows:
        if r[0] not in state:
            if any(s[1] == r[1] for s in state.values()):
                actions[r[0]] = "skipped_url"
            elif any(near(s, r) for s in state.values()):
                actions[r[0]] = "skipped_near"
            else:
                actions[r[0]] = "created"
                state[r[0]] = list(r[:-1])
    return {(p, count[p], a) for p, a in actions.items()}, {tuple(s) for s in state.values()}


@pytest.mark.parametrize("seed, stored, given", [(1, 60, 150), (2, 0, 200), (3, 150, 100), (4, 25, 0)])
def test_guarded_merge(spark, seed, stored, given):
    rng = random.Random(seed)
    urls = [f"http://h/{k}" for k in range(2 * stored + 60)]
    target = [car(rng, f"p{i:03}", u, rng.choice([None, THEN])) for i, u in enumerate(rng.sample(urls, stored))]
    batch = [(*car(rng, f"p{rng.randrange(stored + given):03}", rng.choice([None, "", *urls]) if rng.random() < 0.9 else urls[0]), i) for i in range(given)]
    t, b = spark.createDataFrame(target, CARS), spark.createDataFrame(batch, CARS + ", seq int")
    done, after = merge.guarded_merge(t, b, "seq")
    log, state = plain(target, batch)
    assert {tuple(r) for r in done.collect()} == log
    assert {tuple(r) for r in after.collect()} == state and after.count() == len(state) and after.columns == t.columns
    if given and stored == 60:
        assert len({a for *_, a in log}) == 4
        again = merge.guarded_merge(after, b, "seq")
        assert {tuple(r) for r in again.snapshot.collect()} == state
        assert "created" not in {r.action for r in again.actions.collect()}


def test_a_chain_of_refusals_and_copies_of_one_car(spark):
    rng = random.Random(0)
    target = [(f"p{i}", f"http://h/{i}", "b", "m", 2000 + i, 5, 5.0, None, None, THEN) for i in range(4)]
    # 1 wants what 0 keeps, 2 wants what 1 has, 3 wants a new one; then 300 adverts at one place, 300 of one URL
    batch = [(f"p{i}", f"http://h/{i - 1 if i < 3 else 9}", "b", "m", 2000 + i, 5, 5.0, None, None, None, i) for i in (1, 2, 3)]
    batch += [(f"c{i}", f"http://c/{i}", "b", "m", 2020, 5_000, 9_000.0, None, None, None, 10 + rng.randrange(50)) for i in range(300)]
    batch += [(f"u{i}", "http://one", "b", "m", 2021, 5_000 * i, 9_000.0, None, None, None, 10) for i in range(300)]
    batch += [(None, "http://x", "b", "m", 2021, 5, 9.0, None, None, None, 10)]
    done, after = merge.guarded_merge(spark.createDataFrame(target, CARS), spark.createDataFrame(batch, CARS + ", seq int"), "seq")
    log = [r.asDict() for r in done.collect()]
    assert {r["portal_id"]: r["action"] for r in log if (r["portal_id"] or "p")[0] == "p"} == {"p1": "skipped_url", "p2": "skipped_url", "p3": "updated", None: "skipped_id"}
    assert [sum(r["action"] == a for r in log) for a in ("created", "skipped_near", "skipped_url")] == [2, 299, 301]
    assert after.count() == 6 and after.where("portal_id = 'p3' and url_verified_at is null and url = 'http://h/9'").count() == 1


def test_verification(spark):
    rows = [(f"p{i}", f"http://h/{i}", "b", "m", 2020, 1, 1.0, None, None, THEN if i == 7 else None) for i in range(8)] + [("p8", "", "b", "m", 2020, 1, 1.0, None, None, None)]
    probes = [("p0", "ok", None, None), ("p0", "dead", None, None), ("p1", "dead", None, None), ("p2", "soft", "http://S/x/", "ok"), ("p3", "dead", "http://s/x", "ok"), ("p4", None, "http://h/7", "ok"), ("p5", "odd", "http://s/y", "dead"), ("p7", "dead", None, None), ("p8", "ok", None, None), ("zz", "ok", None, None)]
    done, after = merge.verification(spark.createDataFrame(rows, CARS), spark.createDataFrame(probes, "portal_id string, verdict string, seller_url string, seller_verdict string"), NOW)
    assert {tuple(r) for r in done.collect()} == {("p0", "verified"), ("p1", "deleted"), ("p2", "repaired"), ("p3", "deleted"), ("p4", "deleted"), ("p5", "soft")}
    assert {(r.portal_id, r.url, r.url_verified_at, r.soft_at) for r in after.collect()} == {("p0", "http://h/0", NOW, None), ("p2", "http://s/x", NOW, None), ("p5", "http://h/5", None, NOW), ("p6", "http://h/6", None, None), ("p7", "http://h/7", THEN, None), ("p8", "", None, None)}


def plain_cycle(rows, probes):
    """What a cycle does with each advert that waits, advert by advert."""
    norm = lambda u: (u or "").replace("HTTP", "http").replace("//H", "//h").rstrip("/")
    best = {}
    for pid, verdict, seller, said in probes:
        if pid is not None and any(r[0] == pid and r[1] and r[9] is None for r in rows):
            rank = 0 if verdict == "ok" else 1 if said == "ok" and norm(seller) else 3 if verdict == "dead" else 2
            best[pid] = min(best.get(pid, (9, "")), (rank, norm(seller) if rank == 1 else ""))
    free = {}
    for pid, (rank, to) in best.items():
        if rank == 1 and not any(norm(r[1]) == to and r[0] != pid for r in rows):
            free[to] = min(free.get(to, pid), pid)
    return {p: "verified" if k == 0 else "repaired" if k == 1 and free.get(to) == p else "soft" if k == 2 else "deleted" for p, (k, to) in best.items()}, {p: to for p, (_, to) in best.items()}


@pytest.mark.parametrize("small", [True, False])
def test_verification_by_plain_loops(spark, monkeypatch, small):
    if not small:  # as if there were too many repairs to broadcast
        monkeypatch.setattr(merge, "small_side", lambda df: df)
    rng = random.Random(3)
    urls = [None, "", *(x for k in range(12) for x in (f"http://h/{k}", f"HTTP://H/{k}/", f"http://h/{k}/"))]
    rows = [(f"p{i:03}", rng.choice(urls), "b", "m", 2020, 1, 1.0, None, None, rng.choice([None, None, THEN])) for i in (*range(30), 3, 3, 4, 5, 6, 7)] + [(None, "http://h/3", "b", "m", 2020, 1, 1.0, None, None, None)]
    probes = [(rng.choice([None, f"p{rng.randrange(35):03}"]) if rng.random() < 0.2 else f"p{rng.randrange(35):03}", rng.choice([None, "ok", "dead", "soft", "dead"]), rng.choice([*urls, *(f"http://s/{k}" for k in range(9))]), rng.choice([None, "ok", "ok", "dead"])) for _ in range(60)]
    done, after = merge.verification(spark.createDataFrame(rows, CARS), spark.createDataFrame(probes, "portal_id string, verdict string, seller_url string, seller_verdict string"), NOW)
    log, to = plain_cycle(rows, probes)
    assert {r.portal_id: r.action for r in done.collect()} == log and done.count() == len(log) and set(log.values()) == {"verified", "repaired", "soft", "deleted"}
    want = {(r[0], to[r[0]] if log.get(r[0]) == "repaired" else r[1], NOW if log.get(r[0]) in ("verified", "repaired") else r[9], NOW if log.get(r[0]) == "soft" else None) for r in rows if log.get(r[0]) != "deleted"}
    assert {(r.portal_id, r.url, r.url_verified_at, r.soft_at) for r in after.collect()} == want


def test_verification_shuffles_a_table_once(spark):
    rows = spark.createDataFrame([("p1", "http://h/1", "b", "m", 2020, 1, 1.0, None, None, None), ("p2", "http://h/2", "b", "m", 2020, 1, 1.0, None, None, THEN)], CARS)
    probes = spark.createDataFrame([("p1", "dead", "http://h/9", "ok")], "portal_id string, verdict string, seller_url string, seller_verdict string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done, after = merge.verification(rows, probes, NOW)
        assert "hashpartitioning" not in after._jdf.queryExecution().executedPlan().toString()
        assert done.count() == 1 and {(r.portal_id, r.url) for r in after.collect()} == {("p1", "http://h/9"), ("p2", "http://h/2")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merge_works_its_input_out_once(spark):
    rows = [("a", "http://h/1", "b", "m", 2020, 5, 5.0, None, None, THEN)]
    batch = [("", "http://h/2", "b", "m", 2020, 5, 5.0, None, None, None, 1), (None, "http://h/3", "b", "m", 2020, 5, 5.0, None, None, None, 2), ("c", "http://h/4", "n", "m", 2020, 5, 5.0, None, None, None, 3)]
    done, after = merge.guarded_merge(spark.createDataFrame(rows, CARS), spark.createDataFrame(batch, CARS + ", seq int"), "seq")
    for out in (done, after):  # only written steps are read, neither stock nor batch again
        assert "LogicalRDD" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "LocalRelation" not in plan
    assert {tuple(r) for r in done.collect()} == {(None, 2, "skipped_id"), ("c", 1, "created")}


def test_places_near_the_stock_are_counted_not_copied(spark):
    """Each place goes to one task once, not to the nine cells around its own; unknown and odd numbers are near nothing."""
    places = "brand_norm string, model_norm string, year int, mileage_km int, price double"
    stored = [("b", "m", 2020, k, p) for k in (0, 2500, None) for p in (1.0, 100.0, 9_000.0, float("inf"))]
    fresh = [("b", m, 2020, k, p) for m in ("m", "n", None) for k in (900, 1001, 3500, None) for p in (0.96, 94.0, 95.2, 9_400.0, 9_500.0, float("nan"))]

    def near(a, b):
        return a[:3] == b[:3] and None not in (*a, *b) and abs(a[3] - b[3]) <= 1000 and abs(a[4] - b[4]) / max((a[4] + b[4]) / 2, 1) <= 0.05

    found = merge._held(spark.createDataFrame(stored, places), spark.createDataFrame(fresh, places))
    assert sorted(map(tuple, found.collect())) == sorted(f for f in fresh if any(near(f, s) for s in stored))
