"""Numbers: prices, mileages, powers, rounding and option lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: metric horsepower of a kilowatt.
KW_TO_CV = 1.35962


def js_round(c: Column) -> Column:
    """Halves up, towards plus infinity."""
    return F.floor(c + 0.5)


def parse_amount(c: Column) -> Column:
    """The first number of a text with its separators; two digits after the last one are cents and go."""
    first = F.regexp_replace(F.regexp_extract(c, r"\d+(?:[.,\s]\d+)*", 0), r"\s", "")
    digits = F.regexp_replace(F.regexp_replace(first, r"[.,]\d\d$", ""), r"\D", "")
    return F.when(digits != "", digits.cast("long"))


def parse_year(c: Column) -> Column:
    y = F.regexp_extract(c, r"\d{4}", 0)
    return F.when(y != "", y.cast("int"))


def sanitize_price(c: Column) -> Column:
    """Null for what is no price; prices in thousands are scaled up."""
    return F.when(c.isNull() | F.isnan(c) | (c <= 0) | (c > 1e9), None).when(c.between(1, 9) | c.between(10, 99), c * 1000).otherwise(c)


def power_cv(c: Column, allow_bare: bool = False) -> Column:
    """Horsepower named in a text: kilowatts are converted, a bare number counts if it is the whole text."""
    t = F.trim(F.translate(F.coalesce(c, F.lit("")), ",", "."))
    kw = F.regexp_extract(t, r"(?i)(\d+(?:\.\d+)?)\s*k\s*w\b", 1)
    hp = F.regexp_extract(t, r"(?i)(\d+(?:\.\d+)?)\s*(?:cv|ch|hp|ps|bhp|din)\b", 1)
    kws = F.when(kw != "", kw).cast("double")
    hps = js_round(F.when(hp != "", hp).cast("double"))
    out = F.when(kw != "", F.when((kws > 0) & (kws < 2000), js_round(kws * KW_TO_CV))).when(hp != "", F.when((hps > 20) & (hps < 2000), hps))
    if allow_bare:
        bare = F.when(t.rlike(r"^\d{2,4}$"), t).cast("int")
        out = out.when(bare.isNotNull(), F.when((bare > 20) & (bare < 2000), bare))
    return out.cast("int")


def round_up(c: Column, step: int) -> Column:
    return F.when(c <= 0, 0).otherwise(F.ceil(c / step) * step).cast("long")


def round_price(c: Column) -> Column:
    return round_up(c, 1000)


def round_mileage(c: Column) -> Column:
    return round_up(c, 5000)


def approx_count(c: Column) -> Column:
    """A count for a label: exact below 100, else about, with k from ten thousand on."""
    v = F.greatest(F.lit(0), js_round(c))

    def about(step: int, show: int, unit: str) -> Column:
        return F.concat(F.lit("~"), (js_round(v / step) * show).cast("string"), F.lit(unit))

    return F.when(v < 100, v.cast("string")).when(v < 1000, about(10, 10, "")).when(v < 10_000, about(100, 100, "")).when(v < 100_000, about(1000, 1, "k")).otherwise(about(10_000, 10, "k"))


def sane_min_year(c: Column, this_year: int) -> Column:
    return F.when(c.isNull() | (c < 1970), 1970).when(c > this_year + 1, this_year).otherwise(F.floor(c)).cast("int")


def _options(values: list[Column], keep) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.array(*[v.cast("long") for v in values]), keep)))


def price_options(least: Column, avg: Column, most: Column) -> Column:
    return _options([round_price(x) for x in (least, avg * 0.85, avg, avg * 1.15, most)], lambda v: v > 0)


def year_options(least: Column, avg: Column, most: Column, this_year: int) -> Column:
    low = sane_min_year(least, this_year)
    high, mid = F.greatest(low, most), F.greatest(low, js_round(avg))
    return _options([low, mid - 2, mid, mid + 1, high - 1, high], lambda y: (y >= low) & (y <= high) & (y >= 1970))


def mileage_options(least: Column, avg: Column, most: Column) -> Column:
    top = F.least(round_mileage(most), F.lit(300_000))
    return _options([round_mileage(F.greatest(F.lit(0), least)), round_mileage(avg * 0.85), round_mileage(avg), round_mileage(avg * 1.15), top], lambda v: (v > 0) & (v <= 300_000))


def power_options(least: Column, avg: Column, most: Column) -> Column:
    """Floors of the power filter that still leave stock."""
    low = F.when(least > 0, least).otherwise(most)
    mid = F.when(avg > 0, avg).otherwise((low + most) / 2)

    def ten(c: Column) -> Column:
        return F.floor(c / 10) * 10

    values = [ten(low), ten(low) - 20, ten(mid), ten(mid) - 20, ten(most), ten(most) - 20, F.greatest(F.lit(50), ten(low) - 10)]
    return _options(values, lambda v: (v >= 40) & (v <= 800) & (v <= most))


def clamp_page(page: Column, n_items: Column, per_page: int) -> Column:
    """A page number, from 0, that exists: the last one if it is beyond, the first if it is before or missing."""
    last = F.greatest(F.lit(0), F.ceil(n_items / per_page) - 1)
    return F.greatest(F.lit(0), F.least(F.coalesce(page, F.lit(0)), last)).cast("long")
