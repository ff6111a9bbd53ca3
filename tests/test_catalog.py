"""Engines and trims out of version texts, with the catalog of this repository."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators import matching

CASES = [
    ("audi", "a4", "2.0 TDI S line", None, "2.0 tdi", 150, "catalog"),
    ("audi", "a4", "A4 Avant 2.0", 185, "2.0 tfsi", 185, "catalog"),  # the nearest in power
    ("audi", "a4", "A4 Avant 2.0", None, "2.0 tfsi", 190, "catalog"),  # the brand's preferred family
    ("volkswagen", "golf", "1.5 eTSI 150CV", None, "1.5 tsi", 150, "catalog"),
    ("dacia", "duster", "1.5 Blue dCi 115 CV", None, "1.5 dci", 115, "catalog"),
    ("bmw", "serie 3", "320d xDrive", None, "320d", 190, "catalog"),
    ("peugeot", "208", "AVANTGARDE", None, "", None, None),
    ("nobody", "x", "1.0 TSI Life", None, "1.0 tsi", None, "heuristic"),
    ("nobody", "x", "GTI 245 CV", None, "", 245, "heuristic"),  # only the power is known
]


def test_engine_resolution(spark):
    rows = spark.createDataFrame([(str(i), *c[:4]) for i, c in enumerate(CASES)], "portal_id string, brand_norm string, model_norm string, version string, power_hp int")
    got = {int(r.portal_id): (r.engine_norm, r.engine_power, r.engine_source) for r in C.resolve_engines(rows, C.engine_catalog(spark)).collect()}
    assert got == {i: c[4:] for i, c in enumerate(CASES)}


def test_enrichment_never_overwrites(spark):
    rows = spark.createDataFrame([("a", "audi", "a4", "2.0 TDI", 999, "v8"), ("b", "audi", "a4", "2.0 TDI", 0, "0 tfsi"), ("c", "audi", "a4", "2.0 TDI", None, None)], "portal_id string, brand_norm string, model_norm string, version string, power_hp int, engine_norm string")
    got = {r.portal_id: (r.engine_norm, r.power_hp) for r in C.enriched(rows, C.engine_catalog(spark)).collect()}
    assert got == {"a": ("v8", 999), "b": ("tfsi", 150), "c": ("2.0 tdi", 150)}


@pytest.mark.parametrize(("trim", "text", "fits"), [("FR", "leon fr 1.5", True), ("FR", "frontline", False), ("S line", "2.0 tdi s-line", True), ("R-Line", "rline", True), ("GTI", "golf gti", True), ("", "x", False)])
def test_trims(spark, trim, text, fits):
    assert spark.range(1).select(C.trim_in_text(F.lit(trim), F.lit(text))).first()[0] is fits


def test_alerts_use_the_engines_and_typical_power_of_the_catalog(spark):
    kind = "portal_id string, brand_norm string, model_norm string, version string, year int, mileage_km int, price double, fuel_type string, power_hp int, country string"
    cars = spark.createDataFrame([("typical", "dacia", "duster", "1.5 dCi", 2020, 80_000, 15_000.0, None, None, "ES"), ("said", "dacia", "duster", "1.5 dCi 90 CV", 2020, 80_000, 15_000.0, None, 0, "ES"), ("bare", "dacia", "duster", "Duster 1.0", 2020, 80_000, 15_000.0, None, None, "ES")], kind)
    alerts = spark.createDataFrame([(1, 1, "dacia", 110, ""), (2, 2, "dacia", None, "1.0 TCe")], "id long, user_id long, brand_norm string, min_power_hp int, engine_csv string")
    engines = C.engine_catalog(spark)
    assert {(r.a_id, r.portal_id) for r in matching.matches(cars, alerts, engines=engines).collect()} == {(1, "typical"), (2, "bare")}
    assert matching.matches(cars, alerts).count() == 0


def test_repeated_and_blank_adverts_keep_their_rows(spark):
    rows = [("a", "audi", "a4", "2.0 TDI", None)] * 2 + [(None, None, None, None, None), ("b", "audi", None, "v8", 15)]
    got = C.resolve_engines(spark.createDataFrame(rows, "portal_id string, brand_norm string, model_norm string, version string, power_hp int"), C.engine_catalog(spark)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "2.0 tdi", 150, "catalog")] * 2 + [(None, "", None, None), ("b", "v8", None, "heuristic")], key=str)
