"""Names resolved through common keys, against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fuzzy as Z

BRANDS = ["volkswagen", "mercedes-benz", "alfa romeo", "land rover", "audi", "bmw", "seat", "skoda", "chevrolet", "rolls-royce", "peugeot", "renault", "ds automobiles", "lynk & co", "ssangyong / kgm"]
MODELS = ["golf", "golf gti", "leon", "serie 4", "clase a", "a4", "208", "duster", "range rover sport", "i4", "x", "model 3", "3008", "e-tron gt", "grand c4 picasso"]


def spoilt(names, n, seed):
    rng, out = random.Random(seed), set()
    for _ in range(n):
        x = list(rng.choice(names))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(3)] = rng.choice(["", "", "e", "r", "4", " ", "-"])
        out.add("".join(x))
    words = [w for x in names for w in x.split()]
    out |= {" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(n // 2)}
    return sorted(out | set(names) | {"VW", "merc", "landrover", "Mercdes", "", " ", "4er", "A Klasse"})


@pytest.mark.parametrize("names, score, keys", [(BRANDS, Z.brand_score, Z.brand_keys), (MODELS, Z.model_score, Z.model_keys)])
def test_accepted_pairs_have_a_common_key(spark, names, score, keys):
    typed = spark.createDataFrame([(t,) for t in spoilt(names, 160, 1)], "typed string")
    catalog = spark.createDataFrame([(n,) for n in names], "name string")
    every = typed.crossJoin(catalog).where(score(F.col("typed"), F.col("name")) >= Z.ACCEPT)
    met = Z.name_pairs(typed, catalog, "typed", "name", keys)
    assert every.count() > 100 and every.exceptAll(met).isEmpty()
    best = {}
    for r in every.withColumn("s", score(F.col("typed"), F.col("name"))).collect():
        best[r.typed] = min(best.get(r.typed, (0, "")), (-r.s, r.name))
    found = Z.resolve(typed, catalog, "typed", "name", score)
    got = {r.typed: (-r.score, r.best) for r in found.collect() if r.best}
    assert {t: got[t] for t in best} == best
    assert all(s <= -Z.RETRY for t, (s, _) in got.items() if t not in best)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_last_word_is_dropped_once(spark):
    typed = spark.createDataFrame([("duster zzzz qqqq",), ("duster zzzzzz",), ("zzz yyy",), (None,)], "typed string")
    catalog = spark.createDataFrame([("duster xtreme extra",), ("golf",), ("zz top one two",)], "name string")
    got = {r.typed: (r.best, r.score) for r in Z.resolve(typed, catalog, "typed", "name", Z.model_score).collect()}
    assert got[None] == (None, None) and got["zzz yyy"] == (None, None)
    assert Z.resolve(typed.limit(0), catalog, "typed", "name", Z.model_score).count() == 0
