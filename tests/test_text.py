"""Folding against the canonical decomposition, spellings of a model."""

import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import freetext as T
from tidemark.functions import text as X
from tidemark.operators.predicate import Scope


def test_marks_go_whether_composed_or_not(spark):
    texts = [" ".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4) for a in (*range(0, 0x3000, 64), *range(0xF900, 0x10000, 64), *range(0x11000, 0x11800, 64), *range(0x1D100, 0x1D300, 64))]
    texts += ["Škoda", "Lëón", "Lëón", "Ångström", "ệ", "Straße łódź ø", "", "한국"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low"), X.fold(F.col("t")).alias("got")).collect()
    for r in rows:
        want = "".join(c for c in unicodedata.normalize("NFD", r.low) if unicodedata.category(c)[0] != "M")
        assert unicodedata.normalize("NFD", r.got) == want


def test_spellings_are_the_aliases_and_reach_the_scan(spark, small, tmp_path):
    names = ["4 Series", "A-Class", "G Wagon", "Golf", "serie 4", "Mégane Grand"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select(X.model_aliases(F.col("n")).alias("a"), F.array(*X.model_spellings(F.col("n"))).alias("s")).collect()
    assert all(set(r.a) == set(r.s) for r in got)
    rows.select(F.col("n").alias("model_norm")).write.parquet(f"{tmp_path}/m")
    plan = spark.read.parquet(f"{tmp_path}/m").where(Scope(model="4 Series").hard())._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(model_norm, [4 er,4 series" in plan


def test_specs_are_trimmed_of_blanks_only(spark):
    rows = spark.createDataFrame([("golf 20 tdi", [" 20 ", "tdi"]), ("golf 2 tdi", ["20", "1.0 "]), ("1.0 tsi 10", ["tsi", "10 ", " 1.0"])], "t string, s array<string>")
    assert [r[0] for r in rows.select(T.has_specs(F.col("t"), F.col("s"))).collect()] == [True, False, True]
