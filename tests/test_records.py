"""JSON, key-value and file sources, resumed crawls, adverts out of pages: odd inputs and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import adverts as A
from tidemark.sources import records as R


def test_broken_catalogs_give_no_rows(spark):
    texts = ['{"Audi": {"A4": [{"engine": "2.0 TDI", "aliases": ["20 tdi"], "powerCv": 150}, {"engine": "x"}], "A3": []}}', '{"Audi": {"A4": [', "[1]", "", None, '{"Seat": null}', '{"Audi": {"A4": [{"engine": "2.0 TDI", "powerCv": 150}]}}']
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(map(tuple, R.catalog_of(frame, "text").collect()), key=str) == sorted([("Audi", "A4", 0, "2.0 TDI", ["20 tdi"], 150), ("Audi", "A4", 1, "x", [], None), ("Audi", "A4", 0, "2.0 TDI", [], 150)], key=str)
    assert [r[0] for r in frame.select(R.broken("text")).collect()][:2] == [False, True]


def test_answers(spark):
    texts = ["```json\n{\"fuelType\": \"diesel\", \"powerHp\": 150.5, \"transmission\": \"automatic\"}\n```", '{"powerHp": "150"}', '{"powerHp": -3}', "none", "", None, "}{", '{"fuelType": null}']
    got = [tuple(r.a) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.answered(F.col("t")).alias("a")).collect()]
    assert got == [("Diesel", "Automatic", 151)] + [(None, None, None)] * 7


def test_latest_values_skip_broken_ones(spark):
    rows = spark.createDataFrame([("a", '{"k": 1}', 1), ("a", "{", 2), ("b", None, 1), (None, '{"k": 1}', 1), ("c", '{"k": 5}', 1), ("c", '{"k": 6}', 3), ("c", "", 4)], "key string, value string, at int")
    assert {(r.key, r.value.k) for r in R.latest_values(rows, "k long", "at").collect()} == {("a", 1), ("c", 6)}


def test_files_and_restore(spark, tmp_path):
    for k, name in enumerate(("one.parquet", "two.parquet")):
        spark.range(k + 1).write.parquet(f"{tmp_path}/{name}")
    assert R.restored(spark, str(tmp_path)).count() == 2 and R.restored(spark, str(tmp_path), "one.parquet").count() == 1
    found = R.files(spark, str(tmp_path), "*.parquet").collect()
    assert found and all(r.length > 0 and r.name.startswith("part-") for r in found)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        R.restored(spark, f"{tmp_path}/empty")


def crawl(pages, cursor, run, empty):
    """One run as a loop: visited, first, last, next."""
    end, page, visited, streak = max(pages), cursor, 0, 0
    if page > end:
        return 0, None, None, 1
    while True:
        visited += 1
        streak = 0 if pages.get(page, 0) > 0 else streak + 1
        if page + 1 > end or streak >= empty:
            return visited, cursor, page, 1
        if visited >= run:
            return visited, cursor, page, page + 1
        page += 1


def test_resumed_crawls_as_a_loop(spark):
    rng = random.Random(2)
    lists = {f"l{k}": {p: rng.choice([0, 0, 1, 3]) for p in range(1, rng.randint(2, 60)) if rng.random() < 0.9 or p == 1} for k in range(60)}
    cursors = {name: rng.randint(1, max(pages) + 2) for name, pages in lists.items() if rng.random() < 0.8}
    pages = spark.createDataFrame([(name, p, n) for name, found in lists.items() for p, n in found.items()], "list_id string, page int, n_new int")
    stored = spark.createDataFrame([*cursors.items(), ("gone", 3)], "list_id string, page int")
    got = {r.list_id: tuple(r)[1:] for r in R.resumed(pages, stored, run=8, empty=3).collect()}
    assert got == {name: crawl(found, cursors.get(name, 1), 8, 3) for name, found in lists.items()}


def test_adverts_out_of_odd_pages(spark):
    pages = [
        (1, '<div data-record="a" data-price="9500"><h2><span>Make</span> <span>Seat</span></h2><p>2019 | 45.000 km | Diesel | 150 CV | Manual<p>Precio: 9.000,00 €</div>'),
        (2, "<table data-record=b><tr><td>Año</td><td>2015</td><tr><td>Mileage</td><td>100 miles</td></tr><tr><td>Puissance</td><td>100 kW</td></table><li>Fuel: ?<li>Fuel: Gasolina"),
        (3, "<script>var x = '<li>Year: 2001</li>'</script><p>nothing</p>"),
        (4, None),
        (5, ""),
    ]
    got = {(r.page_id, r.record): tuple(r)[2:] for r in A.records(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {
        (1, "a"): ("Seat", None, None, 2019, 45_000, 9_500.0, "Diesel", "Manual", 150),
        (2, "b"): (None, None, None, 2015, 161, None, None, None, 136),
        (2, ""): (None, None, None, None, None, None, "Petrol", None, None),
    }


def test_details_go_before_cards(spark):
    kind = "record string, " + ", ".join(f"{k} {v}" for k, v in A.FIELDS.items())
    cards = spark.createDataFrame([("a", "Seat", "León", None, 2019, 1, 5.0, None, None, None), ("b", "Kia", None, None, None, None, None, None, None, None)], kind)
    details = spark.createDataFrame([("a", None, "Leon", "FR", None, 2, None, "Petrol", None, None), ("z", "x", None, None, None, None, None, None, None, None)], kind)
    got = {r.record: r for r in A.merged(cards, details).collect()}
    assert set(got) == {"a", "b"} and got["b"].brand == "Kia" and got["b"].model_from is None
    assert (got["a"].brand, got["a"].model, got["a"].version, got["a"].mileage_km, got["a"].fuel) == ("Seat", "Leon", "FR", 2, "Petrol")
    assert (got["a"].brand_from, got["a"].model_from, got["a"].price_from, got["a"].power_hp_from) == ("card", "detail", "card", None)


def test_a_table_may_be_a_folder_of_files(spark, small, tmp_path):
    import os

    from tidemark.plans import QUERIES

    for t in ("nation.parquet", "region.parquet"):
        os.symlink(f"{small}/{t}", tmp_path / t)
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert sorted(map(tuple, QUERIES["folder_files"](spark, folder).collect())) == [("events.parquet", True), ("nation.parquet", True), ("region.parquet", True)]
