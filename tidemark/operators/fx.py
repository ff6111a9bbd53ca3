"""Prices in other currencies: which are already euros, conversion, and repair of wrong conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import js_round
from ..sources.tables import small_side

# Countries that pay in euros; currencies of others; plausible prices; least local prices.
EURO = ("AT", "BE", "BG", "CY", "DE", "EE", "ES", "FI", "FR", "GR", "HR", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PT", "SI", "SK", "AD", "MC", "SM", "VA")
CURRENCIES = {
    "SE": "SEK", "DK": "DKK", "NO": "NOK", "IS": "ISK", "CH": "CHF", "GB": "GBP", "UK": "GBP", "PL": "PLN", "CZ": "CZK", "HU": "HUF",
    "RO": "RON", "RS": "RSD", "BA": "BAM", "MK": "MKD", "AL": "ALL", "TR": "TRY", "UA": "UAH", "MD": "MDL",
}
LEAST_EUR, MOST_EUR, COLLAPSE = 800, 800_000, 0.35
LEAST_LOCAL = {"HUF": 400_000, "CZK": 40_000, "ISK": 200_000, "RSD": 100_000, "UAH": 40_000, "MKD": 50_000, "ALL": 100_000, "MDL": 20_000, "TRY": 50_000}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def currency_of(country: Column) -> Column:
    """The currency of a country code, null for euro countries and unknown ones."""
    return F.element_at(_map(CURRENCIES), F.upper(F.trim(F.coalesce(country, F.lit("")))))


def to_eur(amount: Column, currency: Column, rate: Column) -> Column:
    ok = F.coalesce(amount > 0, F.lit(False))
    return F.when(~ok, None).when(F.upper(currency) == "EUR", amount).when(rate > 0, amount / rate)


def looks_like_eur(amount: Column, currency: Column, rate: Column) -> Column:
    """Whether a price that should be local is in euros already."""
    floor = F.element_at(_map({k: float(v) for k, v in LEAST_LOCAL.items()}), F.upper(currency))
    eur = js_round(to_eur(amount, currency, rate))
    collapsed = floor.isNotNull() & amount.between(LEAST_EUR, MOST_EUR) & (eur < amount * COLLAPSE)
    return (
        F.when(amount.isNull() | (amount <= 0) | (F.upper(currency) == "EUR"), True)
        .when(F.coalesce(amount < floor, F.lit(False)), True)
        .when(eur.isNull(), False)
        .when((eur < LEAST_EUR) | (eur > MOST_EUR), True)
        .otherwise(collapsed)
    )


def repaired(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (id, country, price, price_native, price_currency) with action, new_price, new_native, new_currency.

    Repairs go first: a converted price that is implausibly low while the native amount was plausible in euros. Rows
    without a native amount are then converted, marked as euros, skipped (no currency) or failed (no rate). rates
    (currency, rate) is one row per currency, some 150.
    """
    r = rows.withColumn("ccy", currency_of(F.col("country"))).join(small_side(rates.select(F.col("currency").alias("ccy"), "rate")), "ccy", "left")
    native, price = F.col("price_native"), F.col("price")
    foreign = F.col("ccy").isNotNull()
    broken = foreign & native.isNotNull() & (F.coalesce("price_currency", F.lit("")) != "EUR") & (price < LEAST_EUR) & native.between(LEAST_EUR, MOST_EUR)
    pending = native.isNull() & (price > 0)
    eur = js_round(to_eur(price, F.col("ccy"), F.col("rate")))
    action = (
        F.when(broken, "repaired")
        .when(~pending | ~foreign, "skipped")
        .when(F.col("rate").isNull(), "failed")
        .when(looks_like_eur(price, F.col("ccy"), F.col("rate")), "already_eur")
        .otherwise("converted")
    )
    r = r.withColumn("action", action)
    changed = F.col("action")
    return r.select(
        "id",
        "country",
        "action",
        F.when(changed == "repaired", js_round(native).cast("double")).when(changed == "converted", eur.cast("double")).otherwise(price).alias("new_price"),
        F.when(changed == "repaired", js_round(native).cast("double")).when(changed.isin("already_eur", "converted"), price).otherwise(native).alias("new_native"),
        F.when(changed.isin("repaired", "already_eur"), "EUR").when(changed == "converted", F.col("ccy")).otherwise(F.col("price_currency")).alias("new_currency"),
    )


def latest_rates(fetched: DataFrame, now: Column, fallback: DataFrame, stale_days: int = 7) -> DataFrame:
    """currency, rate, source from payloads (fetched_at, rates: map of currency to units for a euro): each currency's rate in
    the last payload that has it, unless that is too old; then, and for currencies in none, that of fallback (currency, rate)."""
    each = fetched.select("fetched_at", F.explode("rates").alias("currency", "rate")).where(F.col("rate") > 0)
    last = each.groupBy("currency").agg(F.max_by("rate", "fetched_at").alias("fetched"), F.max("fetched_at").alias("at"))
    both = last.join(fallback.select("currency", F.col("rate").alias("spare")), "currency", "full")
    fresh = F.coalesce(F.col("at") >= now - F.expr(f"interval {stale_days} days"), F.lit(False))
    rate = F.when(fresh, F.col("fetched")).otherwise(F.coalesce("spare", "fetched"))
    return both.select("currency", rate.alias("rate"), F.when(fresh, "fetched").when(F.col("spare").isNotNull(), "fallback").otherwise("stale").alias("source"))
