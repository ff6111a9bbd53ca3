"""Records on their way in: validation, derived columns, drift, backfill decisions, catalog generation, self-check."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.urls import normalize_url
from ..sources.tables import small_side
from .predicate import with_facts


def validated(raw: DataFrame, countries: tuple[str, ...] = ()) -> DataFrame:
    """Raw adverts (brand, model, price, mileage_km, year, fuel_type, transmission, url, country, ...) that are usable, with
    cleaned fields where they have them: known fuels and gearboxes by their names, else null; canonical URLs; trimmed
    names; no power of 0. With countries, only adverts from them. What would need a guess stays null."""
    sane = (F.col("price") > 0) & (F.col("mileage_km") > 0) & (F.col("year") > 0)
    if countries:
        sane = sane & X.country_code(F.col("country")).isin(*countries)
    fuel, gears = X.fuel_type(F.col("fuel_type")), X.transmission(F.col("transmission"))
    clean = {
        "brand": F.trim("brand"),
        "model": F.trim("model"),
        "version": F.nullif(F.trim("version"), F.lit("")),
        "price": N.sanitize_price(F.col("price")),
        "power_hp": F.when(F.col("power_hp") > 0, F.col("power_hp")),
        "fuel_type": F.when(fuel != "Unknown", fuel),
        "transmission": F.when(gears != "Unknown", gears),
        "url": normalize_url(F.col("url")),
    }
    usable = raw.where(X.valid_listing(F.col("brand"), F.col("model")) & sane)
    return usable.withColumns({c: v for c, v in clean.items() if c in raw.columns}).where("price is not null")


def with_norms(rows: DataFrame) -> DataFrame:
    """rows with the derived columns that every reader relies on, computed once on the way in, and once for each text."""
    out = with_facts(rows, ["brand", "model"], lambda brand, model: {"_brand": X.normalize_brand(brand), "_model": X.normalize_model(model)})
    out = with_facts(out, ["version"], lambda v: {"_tokens": X.version_tokens(v), "_engine": X.engine_key(F.coalesce(v, F.lit(""))), "_power": N.power_cv(v)})
    return out.withColumns(
        {
            "brand_norm": F.col("_brand"),
            "model_norm": F.col("_model"),
            "version_tokens": F.col("_tokens"),
            "engine_norm": F.col("_engine"),
            "power_hp": F.coalesce(F.when(F.col("power_hp") > 0, F.col("power_hp")), F.col("_power")),
        }
    ).drop("_brand", "_model", "_tokens", "_engine", "_power")


def drift(rows: DataFrame, stored: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """rows whose stored values differ from what the rules give now, with the names of those columns. stored: of each name the
    column that its rule reads and the rule, which is applied once to each distinct text."""
    out = rows
    for name, (source, rule) in stored.items():
        out = with_facts(out, [source], lambda c, name=name, rule=rule: {f"_now_{name}": rule(c)})
    names = F.array(*[F.when(~F.col(name).eqNullSafe(F.col(f"_now_{name}")), F.lit(name)) for name in stored])
    return out.withColumn("drifted", F.array_join(names, ",")).where("drifted <> ''").drop(*[f"_now_{name}" for name in stored])


def needs_enrichment() -> Column:
    """An engine that is missing or has a bogus leading zero, or no known power."""
    e = F.coalesce("engine_norm", F.lit(""))
    return (e == "") | e.startswith("0 ") | e.startswith("0.0 ") | F.col("power_hp").isNull() | (F.col("power_hp") == 0)


def fuel_decision(stored: Column, found: Column, fetched: Column, keep_on_fail: bool) -> Column:
    """keep, update, clear or skip for a stored fuel, given what its page says: fetched is false if it can't be read."""
    missing = stored.isNull() | (F.lower(stored) == "unknown")
    fail = "skip" if keep_on_fail else "clear"
    return F.when(~fetched, F.when(missing & F.lit(not keep_on_fail), "skip").otherwise(fail)).when(found.isNull(), fail).when(found == stored, "keep").otherwise("update")


def generated_catalog(models: DataFrame, curated: DataFrame, model_rules: DataFrame, brand_defaults: DataFrame, generic: str) -> DataFrame:
    """brand, model, engines, level: curated engines go before a rule of the model, before a default of the brand,
    before the generic ones. All sides are catalog tables of some hundred rows."""
    out = models.join(small_side(curated.withColumnRenamed("engines", "c")), ["brand", "model"], "left")
    out = out.join(small_side(model_rules.withColumnRenamed("engines", "r")), ["brand", "model"], "left")
    out = out.join(small_side(brand_defaults.withColumnRenamed("engines", "d")), "brand", "left")
    level = F.when(F.col("c").isNotNull(), "curated").when(F.col("r").isNotNull(), "model").when(F.col("d").isNotNull(), "brand").otherwise("generic")
    return out.select("brand", "model", F.coalesce("c", "r", "d", F.lit(generic)).alias("engines"), level.alias("level"))


def self_check(listings: DataFrame, now: datetime) -> DataFrame:
    """One row: counts, freshness and coverage, each with ok, warn or fail; one pass over the table."""
    n = F.count("*")
    no_power, no_fuel = 100.0 * F.count_if(F.col("power_hp").isNull()) / n, 100.0 * F.count_if(F.col("fuel_type").isNull()) / n
    age = F.floor((F.unix_seconds(F.lit(now)) - F.unix_seconds(F.max("updated_at"))) / 3600)
    return listings.agg(
        n.alias("n"),
        age.alias("age_hours"),
        F.when(age <= 24, "ok").when(age <= 72, "warn").otherwise("fail").alias("freshness"),
        F.when(no_power > 35, "warn").otherwise("ok").alias("power"),
        F.when(no_fuel > 25, "warn").otherwise("ok").alias("fuel"),
        F.when(n == 0, "fail").otherwise("ok").alias("stock"),
    )


def context_defaults(limits: DataFrame) -> DataFrame:
    """Suggested caps of a new filter from a context's averages."""
    return limits.select("*", N.round_price(F.col("avg_price")).alias("max_price_default"), N.js_round(F.col("avg_year")).cast("int").alias("min_year_default"), N.round_mileage(F.col("avg_km")).alias("max_km_default"))


def url_clash(changes: DataFrame, target: DataFrame) -> DataFrame:
    """Repaired URLs (id, url) that another row of target owns already."""
    owner = target.select(F.col("id").alias("_owner"), F.col("url").alias("_url"))
    return changes.join(owner, (F.col("url") == F.col("_url")) & (F.col("id") != F.col("_owner")), "left_semi")
