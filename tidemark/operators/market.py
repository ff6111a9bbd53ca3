"""What an advert's price says against comparable ones.

A model's adverts of a year and its neighbours are its slice. Cars of one model, year and mileage have the same
comparables, so each such combination is asked once. A slice is one task's work, as distinct (mileage, price) pairs with
their numbers; all its medians come out of one descent through the bits of the prices' ranks, which is n log n in the
slice's pairs and questions, not their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round

LEAST_SAMPLE, REPORTABLE_PCT, HOT_PCT = 6, 5, 20
BAND_KM, BAND_SHARE = 20_000, 0.25


def ranged_values(ranks: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each question the rank of the k-th (from 0) of the sorted values at positions low to high (exclusive), where a
    value counts as often as its weight. Values part by one bit at a time, zeros first, and questions follow them."""
    found, k = np.zeros(len(low), np.int64), k.astype(np.int64).copy()
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        one = (ranks >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        weight = np.concatenate([[0], np.cumsum(np.where(one, 0, weights))])
        below = weight[high] - weight[low]
        right = k >= below
        found |= right.astype(np.int64) << bit
        k -= np.where(right, below, 0)
        low, high = (np.where(right, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        ranks, weights = ranks[order], weights[order]
    return found


def slice_medians(km: np.ndarray, price: np.ndarray, many: np.ndarray, asked: np.ndarray) -> dict[str, np.ndarray]:
    """n, n_band, all_median and band_median for each asked mileage; NaN mileages are in no band."""
    order = np.argsort(km, kind="stable")
    km, price, many = km[order], price[order], many[order]
    known, n = int((~np.isnan(km)).sum()), int(many.sum())
    values, ranks = np.unique(price, return_inverse=True)
    width = np.maximum(BAND_KM, asked * BAND_SHARE)
    low, high = np.searchsorted(km[:known], asked - width, "left"), np.searchsorted(km[:known], asked + width, "right")
    low, high = np.where(np.isnan(asked), 0, low), np.where(np.isnan(asked), 0, high)
    upto = np.concatenate([[0], np.cumsum(many)])
    in_band = upto[high] - upto[low]
    # The whole slice is one more question.
    low, high, size = np.append(low, 0), np.append(high, len(km)), np.append(in_band, n)
    middle = [ranged_values(ranks, many, low, high, np.maximum(0, k)) for k in ((size - 1) // 2, size // 2)]
    lower, upper = (values[np.minimum(m, len(values) - 1)] for m in middle)
    medians = 0.5 * lower + 0.5 * upper
    return {"n": np.full(len(asked), n), "n_band": in_band, "all_median": np.full(len(asked), medians[-1]), "band_median": medians[:-1]}


def sample_medians(cars: DataFrame, listings: DataFrame) -> DataFrame:
    """brand, model, year, km of distinct cars (c_*), and of the priced adverts of their model within a year: n, n_band (those
    in the mileage band) and both medians. Cars without comparables have no row."""
    stock = listings.where("price > 0").select("brand_norm", "model_norm", "year", F.col("mileage_km").cast("double").alias("km"), F.col("price").cast("double").alias("price"))
    stock = stock.groupBy("brand_norm", "model_norm", "year", "km", "price").agg(F.count("*").alias("many"))
    around = stock.withColumn("year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    asked = cars.select(F.col("c_brand").alias("brand_norm"), F.col("c_model").alias("model_norm"), F.col("c_year").alias("year"), F.col("c_km").cast("double").alias("km")).distinct()
    both = around.unionByName(asked.withColumns({"price": F.lit(None).cast("double"), "many": F.lit(0).cast("long")}))
    keys = ["brand_norm", "model_norm", "year"]

    def medians(group: pa.Table) -> pa.Table:
        km, price, many = (group.column(c).to_numpy() for c in ("km", "price", "many"))
        stock, asked = many > 0, km[many == 0]
        if not stock.any() or not len(asked):
            return pa.Table.from_batches([], pa.schema(out))
        found = slice_medians(km[stock], price[stock], many[stock], asked)
        same = {c: pa.repeat(group.column(c)[0], len(asked)) for c in keys}
        return pa.table(same | {"km": pa.array(asked, from_pandas=True)} | found).cast(pa.schema(out))

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    year = both.schema["year"].dataType.simpleString()
    out = [("brand_norm", pa.string()), ("model_norm", pa.string()), ("year", kinds[year]), ("km", pa.float64()), ("n", pa.int64()), ("n_band", pa.int64()), ("all_median", pa.float64()), ("band_median", pa.float64())]
    return both.where(" and ".join(f"{c} is not null" for c in keys)).groupBy(*keys).applyInArrow(medians, f"brand_norm string, model_norm string, year {year}, km double, n long, n_band long, all_median double, band_median double")


def deal_scores(cars: DataFrame, listings: DataFrame) -> DataFrame:
    """c_id, sample, median, pct: the exact median of comparables in the mileage band if there are enough, else of all;
    cars with too few comparables have no score."""
    priced = cars.where("c_price > 0")
    enough = F.col("n_band") >= LEAST_SAMPLE
    scored = sample_medians(priced, listings).where(F.col("n") >= LEAST_SAMPLE)
    scored = scored.select("brand_norm", "model_norm", "year", "km", F.when(enough, F.col("n_band")).otherwise(F.col("n")).alias("sample"), F.when(enough, F.col("band_median")).otherwise(F.col("all_median")).alias("median"))
    same = (F.col("c_brand") == F.col("brand_norm")) & (F.col("c_model") == F.col("model_norm")) & (F.col("c_year") == F.col("year")) & F.col("c_km").cast("double").eqNullSafe(F.col("km"))
    found = priced.join(scored.where("median > 0"), same)
    return found.select("c_id", "sample", "median", js_round((F.col("median") - F.col("c_price")) / F.col("median") * 100).cast("int").alias("pct"))


def deal_badge(pct: Column, sample: Column) -> Column:
    """A digest's line about a price, in words."""
    ads = F.concat(F.lit("% "), F.when(pct > 0, "below").otherwise("above"), F.lit(" market ("), sample.cast("string"), F.lit(" similar ads)"))
    label = F.concat(F.abs(pct).cast("string"), ads)
    return (
        F.when(F.abs(pct) < REPORTABLE_PCT, "Around market price")
        .when(pct >= HOT_PCT, F.concat(F.lit("Hot deal: "), label))
        .when(pct > 0, F.concat(F.lit("Good deal: "), label))
        .otherwise(F.concat(F.lit("Above market: "), label))
    )
