"""Rollups of the inventory: per model, per trim token, scoped, and merged from parts; faceted counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: A token needs this many adverts to be a row of the rollup.
LEAST_TOKEN = 3


def known_power(c: Column) -> Column:
    return F.when(c > 0, c)


def known_fuel(c: Column) -> Column:
    f = F.trim(c)
    return F.when((f != "") & (F.lower(f) != "unknown"), f)


def exact_sum(c: Column) -> Column:
    """The sum of amounts with at most four decimals, the same in whatever order they are added."""
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def summary() -> list[Column]:
    """count, least, most and average of price, year, mileage and known power (0 if no power is known)."""
    out = [F.count("*").alias("n")]
    for name, col in (("price", F.col("price")), ("year", F.col("year")), ("km", F.col("mileage_km"))):
        mean = exact_sum(col) / F.count(col) if name == "price" else F.avg(col)
        out += [F.min(col).alias(f"min_{name}"), F.max(col).alias(f"max_{name}"), mean.alias(f"avg_{name}")]
    p = known_power(F.col("power_hp"))
    return out + [F.coalesce(F.min(p), F.lit(0)).alias("min_power"), F.coalesce(F.max(p), F.lit(0)).alias("max_power"), F.coalesce(F.avg(p), F.lit(0.0)).alias("avg_power")]


def csv_set(c: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def _parts(listings: DataFrame, *keys: str) -> DataFrame:
    """What summaries are made of, per keys: counts, bounds and exact sums, known fuels and the versions' engines."""
    out = [F.count("*").alias("n"), F.collect_set(known_fuel(F.col("fuel_type"))).alias("fuels")]
    columns = {"price": F.col("price").cast("decimal(18,4)"), "year": F.col("year").cast("long"), "km": F.col("mileage_km").cast("long"), "power": known_power(F.col("power_hp")).cast("long")}
    for name, col in columns.items():
        bound = F.col("price") if name == "price" else known_power(F.col("power_hp")) if name == "power" else F.col("mileage_km" if name == "km" else name)
        out += [F.min(bound).alias(f"min_{name}"), F.max(bound).alias(f"max_{name}"), F.sum(col).alias(f"sum_{name}"), F.count(bound).alias(f"n_{name}")]
    return listings.groupBy(*keys).agg(*out)


def _whole(parts: DataFrame, *keys: str) -> DataFrame:
    """_parts by (brand, model, version, ...) to summaries by keys, with fuels and engines as sorted lists."""
    out = [F.sum("n").alias("n")]
    for name in ("price", "year", "km", "power"):
        mean = F.sum(f"sum_{name}").cast("double") / F.sum(f"n_{name}")
        least, most = F.min(f"min_{name}"), F.max(f"max_{name}")
        if name == "power":
            least, most, mean = F.coalesce(least, F.lit(0)), F.coalesce(most, F.lit(0)), F.coalesce(mean, F.lit(0.0))
        out += [least.alias(f"min_{name}"), most.alias(f"max_{name}"), mean.alias(f"avg_{name}")]
    fuels = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("fuels")))), ",").alias("fuels")
    return parts.groupBy(*keys).agg(*out, fuels, csv_set(F.nullif("engine", F.lit(""))).alias("engines"))


def _by_version(listings: DataFrame) -> DataFrame:
    """_parts of usable models by version, with the version's engine: texts are looked at once each, not once an advert."""
    return _parts(listings.where(X.usable_model(F.col("model_norm"))), "brand_norm", "model_norm", "version").withColumn("engine", X.engine_key(F.col("version")))


def base_rollup(listings: DataFrame) -> DataFrame:
    """One row per usable (brand, model) with its summary, fuels and engines."""
    return _whole(_by_version(listings), "brand_norm", "model_norm")


def _with_tokens(parts: DataFrame, tokens: Column) -> DataFrame:
    return parts.select("*", F.explode(tokens).alias("token"))


def token_rollup(listings: DataFrame, least: int = LEAST_TOKEN) -> DataFrame:
    """One row per (brand, model, token of the version) with at least `least` adverts."""
    tokens = F.filter(X.version_tokens(F.col("version")), lambda t: t != "")
    return _whole(_with_tokens(_by_version(listings), tokens), "brand_norm", "model_norm", "token").where(F.col("n") >= least)


def full_rollup(listings: DataFrame, least: int = LEAST_TOKEN) -> DataFrame:
    """Whole models (token '') and tokens as one table, from one scan."""
    tokens = F.array_prepend(F.filter(X.version_tokens(F.col("version")), lambda t: t != ""), F.lit(""))
    return _whole(_with_tokens(_by_version(listings), tokens), "brand_norm", "model_norm", "token").where((F.col("n") >= least) | (F.col("token") == ""))


def top_tokens(listings: DataFrame, n: int) -> DataFrame:
    """token, n: the most frequent tokens of versions, equal ones by name."""
    versions = listings.groupBy("version").agg(F.count("*").alias("n"))
    tokens = versions.select("n", F.explode(X.version_tokens(F.col("version"))).alias("token"))
    return tokens.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def merge_rollups(rows: DataFrame, *keys: str) -> DataFrame:
    """Rollup rows of parts to rollup rows of the whole: averages are weighted by counts (that of power by the counts of
    parts that know it), bounds of power are of known ones, lists of fuels and engines are united."""
    def weighted(name: str) -> Column:
        return (exact_sum(F.col(f"avg_{name}") * F.col("n")) / F.sum("n")).alias(f"avg_{name}")

    powered = F.when(F.col("avg_power") > 0, F.col("n"))
    out = [F.sum("n").alias("n")]
    for name in ("price", "year", "km"):
        out += [F.min(f"min_{name}").alias(f"min_{name}"), F.max(f"max_{name}").alias(f"max_{name}"), weighted(name)]
    out += [F.coalesce(F.min(known_power(F.col("min_power"))), F.lit(0)).alias("min_power"), F.coalesce(F.max(known_power(F.col("max_power"))), F.lit(0)).alias("max_power")]
    out.append(F.coalesce(exact_sum(F.col("avg_power") * powered) / F.sum(powered), F.lit(0.0)).alias("avg_power"))
    for name in ("fuels", "engines"):
        if name in rows.columns:
            known = F.filter(F.flatten(F.collect_set(F.split(name, ","))), lambda x: x != "")
            out.append(F.array_join(F.sort_array(F.array_distinct(known)), ",").alias(name))
    return rows.groupBy(*keys).agg(*out)


def group_counts(listings: DataFrame, value: Column, name: str) -> DataFrame:
    """How often each value occurs; null and '' don't count."""
    return listings.select(value.alias(name)).where((F.col(name).isNotNull()) & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("n"))


def merged_options(options: DataFrame, key: str, label: str, count: str) -> DataFrame:
    """Options under one key: counts add up, the label of the largest member stands for all."""
    return options.groupBy(key).agg(F.sum(count).alias("n"), F.max_by(label, F.struct(F.col(count), F.col(label))).alias("label"))


def coverage(rows: DataFrame, value: Column, warn_pct: float) -> DataFrame:
    missing = F.count_if(value.isNull())
    pct = 100.0 * missing / F.count("*")
    return rows.agg(F.count("*").alias("n"), missing.alias("n_missing"), pct.alias("missing_pct"), F.when(pct > warn_pct, "warn").otherwise("ok").alias("state"))
