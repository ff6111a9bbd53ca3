"""Search of the stock for what someone describes: names as typed, a window around hints, history left out, one advert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import freetext as T
from ..functions import text as X
from ..sources.shared import cut
from ..sources.tables import small_side
from . import dedup as D
from . import fuzzy as Z

#: Half the windows of year and price around hints.
YEARS, PRICE_SHARE = 2, 0.25
#: Adverts of an ask that are tried first, and then.
STEPS = (4, 64)


def _ladder(diff: Column, steps: tuple, beyond: float, known: Column) -> tuple[Column, Column]:
    points = F
    for most, n in steps:
        points = points.when(diff <= most, n)
    return F.when(known, F.coalesce(points.otherwise(0), F.lit(0))).otherwise(0), known & F.coalesce(diff > beyond, F.lit(True))


def hint_score(price: Column, year: Column, km: Column, of_price: Column, of_year: Column, of_km: Column) -> Column:
    """How well an advert fits hints in columns, null or 0 for none: more points the nearer; -1 if one rules it out."""
    ladders = [
        _ladder(F.abs(price - of_price) / of_price, ((0.08, 120), (0.15, 80), (0.25, 40), (0.35, 5)), 0.35, F.coalesce(of_price > 0, F.lit(False))),
        _ladder(F.abs(year - of_year), ((0, 100), (1, 70), (2, 25)), 2, F.coalesce(of_year > 1990, F.lit(False))),
        _ladder(F.abs(km - of_km) / F.greatest(of_km, F.lit(1)), ((0.15, 40), (0.3, 20), (0.45, 5)), 0.55, F.coalesce(of_km > 0, F.lit(False))),
    ]
    return F.when(reduce(lambda a, b: a | b, [miss for _, miss in ladders]), -1).otherwise(reduce(lambda a, b: a + b, [points for points, _ in ladders]))


def brand_fits(typed: Column, resolved: Column, brand: Column) -> Column:
    """Whether an advert's brand is the one a typed name resolves to, or means the same loosely."""
    return (brand != "") & (F.coalesce(resolved == brand, F.lit(False)) | Z.loosely(X.normalize_brand(typed), brand))


def model_fits(typed: Column, resolved: Column, model: Column) -> Column:
    key = X.normalize_model(model)
    return F.coalesce(resolved.isin(key, X.soft_model(model)), F.lit(False)) | Z.loosely(typed, model)


def is_same_car(typed_brand: Column, brand_best: Column, typed_model: Column, model_best: Column, specs: Column, brand: Column, model: Column, version: Column) -> Column:
    """The gate of a repeated request: brand, model and every hard spec must fit."""
    return brand_fits(typed_brand, brand_best, brand) & model_fits(typed_model, model_best, model) & T.has_specs(version, specs)


def resolved(requests: DataFrame, models: DataFrame) -> DataFrame:
    """requests (brand, model as typed) with brand_best and model_best: names of the stock's catalog (brand, model) that fit
    best; models are looked for among those of the brand. Distinct names are scored once."""
    brands = models.select(F.col("brand").alias("brand_name")).distinct()
    typed = Z.resolve(requests.select(F.col("brand").alias("typed_brand"), F.col("model").alias("typed_model")).distinct(), brands, "typed_brand", "brand_name", Z.brand_score)
    typed = typed.select("typed_brand", "typed_model", F.col("best").alias("brand_best"))
    of_brand = models.select(F.col("brand").alias("of_brand"), F.col("model").alias("model_name")).distinct()
    pairs = Z.name_pairs(typed, of_brand, "typed_model", "model_name", Z.model_keys, ("brand_best", "of_brand"))
    scored = pairs.withColumn("score", Z.model_score(F.col("typed_model"), F.col("model_name"))).where(F.col("score") >= Z.ACCEPT)
    best = scored.groupBy("typed_brand", "typed_model").agg(F.min_by("model_name", F.struct((-F.col("score")).alias("s"), "model_name")).alias("model_best"))
    names = typed.join(best, ["typed_brand", "typed_model"], "left").withColumnsRenamed({"typed_brand": "t_brand", "typed_model": "t_model"})
    same = F.col("brand").eqNullSafe(F.col("t_brand")) & F.col("model").eqNullSafe(F.col("t_model"))
    return requests.join(names, same, "left").drop("t_brand", "t_model")


def search(requests: DataFrame, listings: DataFrame, models: DataFrame, sent: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """request_id, portal_id, score: at most one advert for each request.

    requests: request_id, user_id, brand, model (typed), specs (array), price, year, km (hints or null), again (boolean).
    The stock of the resolved brand and model within the window of the hints; where that is empty, the brand's adverts whose
    model means the typed one loosely. Specs must occur in the version. Unless asked for again, what the user has got is left
    out, and so is what is near it. The best by hint_score, then the newest, then the least id.

    Requests that describe the same car are one ask. Its best few adverts (steps) are tried first by those who ask; who has got all
    of them goes on with more, in the end with all that fit.
    """
    given = resolved(requests, models).select("request_id", "user_id", F.col("brand").alias("q_brand"), F.col("model").alias("q_model"), "brand_best", "model_best", "specs", F.col("price").alias("q_price"), F.col("year").alias("q_year"), F.col("km").alias("q_km"), "again")
    asks = ("q_model", "brand_best", "model_best", "specs", "q_price", "q_year", "q_km")
    given = cut(given.withColumn("ask", F.md5(F.to_json(F.struct(*asks)))))  # requests are few beside the stock
    asked = cut(given.groupBy("ask").agg(*[F.first(c).alias(c) for c in asks]))
    stock = listings.select("portal_id", "brand_norm", "model_norm", "version", "year", "mileage_km", "price", "updated_at")
    order = F.struct((-F.col("score")).alias("s"), (-F.unix_micros("updated_at")).alias("new"), "portal_id")
    fit = _fitting(asked, stock).withColumn("o", order).select("ask", "o", "portal_id", *D.BLOCK, "mileage_km", "price")
    most = max(steps, default=0)
    first = cut(fit.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy("o"))).where(F.col("place") <= most + 1)) if steps else None
    got = sent.select(F.col("user_id").alias("s_user"), F.col("listing_id").alias("s_listing")).distinct()
    cars = stock.drop("version", "updated_at")
    had = got.join(cars, F.col("s_listing") == F.col("portal_id")).select("s_user", F.struct(*cars.columns).alias("old"))
    had = cut(had.join(given.where("not again").select(F.col("user_id").alias("s_user")), "s_user", "left_semi"))
    left, out = given.select("ask", "request_id", "user_id", "again"), []
    for step in (*steps, None):
        those = (fit.join(small_side(left.select("ask").distinct()), "ask", "left_semi") if step is None else first.where(F.col("place") <= step)).join(left, "ask")
        same = reduce(lambda a, b: a & b, [F.col(f"car.{c}") == F.col(f"old.{c}") for c in D.BLOCK])
        gone = those.where("not again").select("request_id", "user_id", F.struct(*cars.columns).alias("car")).join(had, (F.col("user_id") == F.col("s_user")) & same & D.near("car", "old"))
        free = those.join(gone.select("request_id", F.col("car.portal_id").alias("portal_id")).distinct(), ["request_id", "portal_id"], "left_anti")
        best = free.groupBy("request_id").agg(F.min("o").alias("best")).select("request_id", "best.portal_id", (-F.col("best.s")).alias("score"))
        if step is None:
            return reduce(DataFrame.unionByName, [*out, best])
        out.append(cut(best))
        left = cut(left.join(out[-1], "request_id", "left_anti").join(first.where(F.col("place") == step + 1).select("ask"), "ask", "left_semi"))


def _fitting(asked: DataFrame, stock: DataFrame) -> DataFrame:
    """The stock's adverts that fit each ask, with their score."""
    window = (F.col("q_year").isNull() | F.abs(F.col("year") - F.col("q_year")).between(0, YEARS)) & (F.col("q_price").isNull() | F.col("price").between(F.floor(F.col("q_price") * (1 - PRICE_SHARE) + 0.5), F.floor(F.col("q_price") * (1 + PRICE_SHARE) + 0.5)))
    score = hint_score(F.col("price"), F.col("year"), F.col("mileage_km"), F.col("q_price"), F.col("q_year"), F.col("q_km"))
    exact = stock.join(small_side(asked), (F.col("brand_norm") == F.col("brand_best")) & (F.col("model_norm") == F.col("model_best")) & window)
    none = cut(asked.join(exact.select("ask").distinct(), "ask", "left_anti"))
    # Names are compared once each: spellings asked for against the models that the stock has of the brand.
    names = none.select("q_model", F.col("brand_best").alias("n_brand"), "model_best").distinct()
    held = stock.select(F.col("brand_norm").alias("held_brand"), F.col("model_norm").alias("held_model")).distinct()
    meant = names.join(held, F.col("n_brand") == F.col("held_brand")).where(model_fits(F.col("q_model"), F.col("model_best"), F.col("held_model"))).select(F.col("q_model").alias("n_model"), "n_brand", F.col("model_best").alias("n_best"), "held_model")
    asks = none.join(meant, (F.col("q_model") == F.col("n_model")) & (F.col("brand_best") == F.col("n_brand")) & F.col("model_best").eqNullSafe(F.col("n_best")))
    loose = stock.join(small_side(cut(asks)), (F.col("brand_norm") == F.col("brand_best")) & (F.col("model_norm") == F.col("held_model")) & window).select(*exact.columns)
    specs = F.coalesce("specs", F.array().cast("array<string>"))
    return exact.unionByName(loose).where(F.when(F.size(specs) == 0, True).otherwise(T.has_specs(F.col("version"), specs))).withColumn("score", score).where("score >= 0")
