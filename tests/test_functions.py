"""Scalar functions against the values that the blueprint states, and properties they must have."""

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import text as X
from tidemark.functions import timewin as W
from tidemark.functions import urls as U


def one(spark, value, f, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], schema).select(f(F.col("v"))).collect()]


def test_nulls_are_empty_or_unknown(spark):
    assert one(spark, [None], X.normalize_brand) == [""]
    assert one(spark, [None], X.normalize_model) == [""]
    assert one(spark, [None], X.fuel_type) == ["Unknown"]
    assert one(spark, [None], X.transmission) == ["Unknown"]
    assert one(spark, [None], X.version_tokens) == [[]]
    assert one(spark, [None], N.power_cv) == [None]
    assert one(spark, [None, "-", "—", "n/a", "A4"], X.usable_model) == [False, False, False, False, True]


def test_rounding_goes_up_at_halves(spark):
    assert one(spark, [-2.5, 2.5, -2.6, 0.49], N.js_round, "v double") == [-2, 3, -3, 0]


def test_normal_forms_are_fixed_points(spark):
    words = ["AlfaRomeo", "VW", "Škoda", "Mercedes AMG", "Land  Rover", " x ", "Rolls Royce"]
    once = one(spark, words, X.normalize_brand)
    assert one(spark, once, X.normalize_brand) == once
    models = ["4 Series", "A-Class", "G Wagon", "C_Max/Grand", "Mégane"]
    once = one(spark, models, X.normalize_model)
    assert one(spark, once, X.normalize_model) == once


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aAéÉ -_/0.4", max_size=12), min_size=1, max_size=40))
def test_model_normalisation_is_idempotent(spark, names):
    once = one(spark, names, X.normalize_model)
    assert one(spark, once, X.normalize_model) == once


def test_urls(spark):
    urls = ["HTTP://Example.COM/a/?utm_source=x&b=1#f", "https://example.com", "https://example.com/a//", " no url/ ", None]
    assert one(spark, urls, U.normalize_url) == ["http://example.com/a?b=1", "https://example.com/", "https://example.com/a", "no url", ""]
    assert one(spark, ["http://x.com/", "http://x.com/a", "http://x.com?q=1"], U.bare_home) == [True, False, False]
    assert one(spark, ["http://x.com/a?page=3", "http://x.com/a"], U.page_number) == [3, 1]
    assert one(spark, ["http://x.com/a?page=3", "http://x.com/a"], lambda c: U.with_page(c, F.lit(4))) == ["http://x.com/a?page=4", "http://x.com/a?page=4"]


def test_windows(spark):
    ts = [datetime(2024, 3, 31, 0, 59), datetime(2024, 3, 31, 1, 1), datetime(2024, 10, 27, 0, 30), datetime(2024, 10, 27, 1, 30)]
    rows = spark.createDataFrame([(t,) for t in ts], "v timestamp")
    assert [r[0] for r in rows.select(F.hour(W.wall_clock(F.col("v")))).collect()] == [1, 3, 2, 2]
    hours = spark.range(24).select(F.collect_list(F.when(W.hour_in(F.col("id"), F.lit(22), F.lit(6)), F.col("id")))).first()[0]
    assert sorted(hours) == [0, 1, 2, 3, 4, 5, 22, 23]


def test_a_url_in_normal_form_needs_one_look(spark, monkeypatch):
    ends = ["", "/", "/a", "/a/", "/a//b", "/a b/c", "/A/É", "/a\n", "/a/\n", "/a\u2028", "/a?b=1", "/a?utm_source=1", "/a#b", "/?", "/a/?", "/a\\b", "/~a|b", "//"]
    urls = [f"{head}{end}" for head in ("http://h.example:80", "HTTP://h", "http://H", "http://é", "http://É", "x+y://u:p@h", "1http://h", "h", "", "http://", " http://h") for end in ends]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in rows.select(U.normalize_url(F.col("u"))).collect()]
    assert sum(r[0] for r in rows.select(F.col("u").rlike(U._NORMAL)).collect()) > 5
    monkeypatch.setattr(U, "_NORMAL", r"a\bb")
    assert got == [r[0] for r in rows.select(U.normalize_url(F.col("u"))).collect()]
