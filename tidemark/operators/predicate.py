"""Which adverts an alert or a draft filter wants; the same predicate serves facets, matching and search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..sources.shared import cut, with_known
from ..sources.tables import small_side
from . import catalog as C

#: Elements up to which a list is short.
SHORT = 3
#: A mileage cap from which on there is none.
ANY_KM = 9_999_999


def soft_fuel(fuel: Column, version: Column) -> Column:
    """The stated fuel, or the one the version text names; null if neither is known."""
    known = F.nullif(F.trim(X.filled(fuel)), F.lit(""))
    known = F.when(F.lower(known) != "unknown", known)
    inferred = X.fuel_type(version)
    return F.coalesce(known, F.when(inferred != "Unknown", inferred))


def effective_power(power: Column, version: Column) -> Column:
    """The stated power, or the one the version text names."""
    return F.coalesce(F.when(power > 0, power), N.power_cv(version, allow_bare=True))


def engine_fits(engine: Column, wanted: Column) -> Column:
    """Equal, or one contains the other; an empty key fits nothing."""
    return (engine != "") & (wanted != "") & (engine.contains(wanted) | wanted.contains(engine))


@dataclass(frozen=True)
class Scope:
    """A filter; None or an empty tuple is any. Fields of ORDER are facets, chosen in that order."""

    brand: str | None = None
    model: str | None = None
    fuels: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    engines: tuple[str, ...] = ()
    min_power: int | None = None
    max_price: float | None = None
    min_year: int | None = None
    max_km: int | None = None
    extra: tuple = field(default=(), compare=False)

    ORDER = ("brand", "model", "engines", "min_power", "fuels", "max_price", "min_year", "max_km", "countries")

    def without(self, *names: str) -> Scope:
        """The scope with those facets open: what the options of a facet are counted over."""
        return replace(self, **{n: getattr(Scope(), n) for n in names})

    def after(self, name: str, value) -> Scope:
        """The scope with a facet chosen anew; facets chosen after it start over."""
        later = self.ORDER[self.ORDER.index(name) + 1 :]
        return replace(self.without(*later), **{name: value})

    def changed(self, name: str, value) -> Scope:
        """after, as the menu does it: fuels are ticked one by one, so they only clear the countries and leave price, year and
        mileage as they are."""
        return replace(self.without("countries"), fuels=value) if name == "fuels" else self.after(name, value)

    def hard(self) -> Column:
        """What the scan can push down: equalities and ranges on stored columns."""
        tests = [F.lit(True)]
        if self.brand:
            tests.append(F.col("brand_norm") == self.brand)
        if self.model:
            tests.append(F.col("model_norm").isin(*X.model_spellings(F.lit(self.model))))
        if self.countries:
            tests.append(F.upper("country").isin(*[c.upper() for c in self.countries]))
        if self.max_price is not None:
            tests.append(F.col("price") <= self.max_price)
        if self.min_year is not None:
            tests.append(F.col("year") >= self.min_year)
        if self.max_km is not None and self.max_km < ANY_KM:
            tests.append(F.col("mileage_km") <= self.max_km)
        return _all(tests)

    def soft(self) -> Column:
        """What needs derived values: fuel, engine and power are filled from the version text first."""
        tests = [F.lit(True)]
        if self.fuels:
            fuel = F.lower(soft_fuel(F.col("fuel_type"), F.col("version")))
            tests.append(F.coalesce(X.any_of([fuel.contains(f.lower()) for f in self.fuels]), F.lit(False)))
        if self.engines:
            engine = X.engine_key(F.col("version"))
            tests.append(X.any_of([engine_fits(engine, X.engine_key(F.lit(e))) for e in self.engines]))
        if self.min_power:
            tests.append(F.coalesce(effective_power(F.col("power_hp"), F.col("version")) >= self.min_power, F.lit(False)))
        return _all(tests)

    def matches(self) -> Column:
        return self.hard() & self.soft()


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _given(frame: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of frame, null if it has none of that name."""
    return F.col(name) if name in frame.columns else F.lit(None).cast(kind)


def _text_facts(version: Column, engine: Column) -> dict[str, Column]:
    """What a version text says by itself, the stored engine or else the text's, and the forms in which trims are looked for."""
    hay, named, stored = X.norm_text(version), X.fuel_type(version), X.engine_key(engine)
    return {
        "_v_fuel": F.when(named != "Unknown", named), "_v_power": N.power_cv(version, allow_bare=True), "_engine": F.when(stored != "", stored).otherwise(F.coalesce(C.engine_heuristic(version), F.lit(""))),
        "_hay": hay, "_close": F.regexp_replace(hay, r"[\s\-]+", ""), "_alone": F.concat(F.lit(" "), F.regexp_replace(hay, "[^a-z0-9]", " "), F.lit(" ")),
    }


def with_facts(rows: DataFrame, keys: list[str], facts: Callable[..., dict[str, Column]]) -> DataFrame:
    """rows with facts of some columns. Texts repeat, so the expressions, chains of patterns, are worked out once for each
    distinct combination and handed back by with_known."""
    known = rows.select(*keys).distinct()
    return with_known(rows, known.withColumns(facts(*map(F.col, keys))), keys)


def with_soft(listings: DataFrame, trims: DataFrame | None = None, engines: DataFrame | None = None) -> DataFrame:
    """listings with what alerts are tested against, made once per advert: canonical keys, fuel and power filled from the
    version, the stored engine or the one that the version names, and the version's text in the forms in which trims are
    looked for. trims (brand, model, trim) is the catalog: `_base` says that the version names none of its model's. With
    a catalog of engines, blank engines are resolved by it, and power unknown to advert and text is that engine's typical one."""
    known = F.nullif(F.trim(X.filled(F.col("fuel_type"))), F.lit(""))
    out = listings if "engine_norm" in listings.columns else listings.withColumn("engine_norm", F.lit(None).cast("string"))
    out = with_facts(out, ["version", "engine_norm"], _text_facts)
    out = with_facts(out, ["brand_norm", "model_norm"], lambda brand, model: {"_brand": X.normalize_brand(brand), "_model": X.normalize_model(model)})
    out = out.withColumns(
        {
            "_country": F.upper("country"), "_fuel": F.lower(F.coalesce(F.when(F.lower(known) != "unknown", known), F.col("_v_fuel"))),
            "_power": F.coalesce(F.when(F.col("power_hp") > 0, F.col("power_hp")), F.col("_v_power")),
        }
    ).drop("_v_fuel", "_v_power")
    if engines is not None:
        out = C.with_engines(out, engines).withColumns({"_engine": F.when(X.engine_key(F.col("engine_norm")) != "", F.col("_engine")).otherwise(F.col("found_engine")), "_power": F.coalesce("_power", "found_power")})
        out = out.drop("found_engine", "found_power", "found_source")
    if trims is None:
        return out.withColumn("_base", F.lit(False))
    names = F.filter(F.collect_set(X.norm_text(F.col("trim"))), lambda t: (t != "base") & (t != ""))
    known = trims.groupBy(X.normalize_brand(F.col("brand")).alias("_t_brand"), X.normalize_model(F.col("model")).alias("_t_model")).agg(F.transform(names, _needle).alias("_t_names"))
    met = out.join(small_side(known), (F.col("_brand") == F.col("_t_brand")) & (F.col("_model") == F.col("_t_model")), "left")
    return met.withColumn("_base", F.coalesce(~F.exists("_t_names", _named), F.lit(False))).drop("_t_brand", "_t_model", "_t_names")


def _needle(trim: Column) -> Column:
    """A trim in the forms in which it is looked for; trim is normalised text."""
    return F.struct(trim.alias("name"), F.regexp_replace(trim, r"[\s\-]+", "").alias("close"))


def _named(t: Column) -> Column:
    """Whether the version of a with_soft row names a trim: short names alone, others anywhere, spaces and hyphens aside."""
    alone = F.col("_alone").contains(F.concat(F.lit(" "), t["name"], F.lit(" ")))
    anywhere = F.col("_hay").contains(t["name"]) | ((F.length(t["close"]) >= 3) & F.col("_close").contains(t["close"]))
    return (F.col("_hay") != "") & F.when(F.length(t["name"]) <= 2, alone).otherwise(anywhere)


#: What an alert asks for: alerts that agree in these columns are one question.
WANTS = ("brand_norm", "model_norm", "max_price", "min_year", "min_power_hp", "max_km", "fuel_csv", "country_csv", "engine_csv", "trim_csv")


def with_wants(alerts: DataFrame) -> DataFrame:
    """alerts with their lists split and put into canonical form once, before they meet any advert; '' or null is any."""
    def listed(name: str) -> Column:
        return F.filter(F.transform(F.split(X.filled(_given(alerts, name)), ","), F.trim), lambda x: x != "")

    trims = F.filter(F.transform(listed("trim_csv"), X.norm_text), lambda t: t != "")
    return alerts.withColumns(
        {
            "brand_key": X.normalize_brand(_given(alerts, "brand_norm")), "model_key": X.normalize_model(_given(alerts, "model_norm")), "fuels": F.transform(listed("fuel_csv"), F.lower), "countries": F.transform(listed("country_csv"), F.upper),
            "engines": F.filter(F.transform(listed("engine_csv"), X.engine_key), lambda e: e != ""), "trims": F.transform(trims, _needle), "wants_base": F.array_contains(trims, "base"),
            "least_power": F.when(_given(alerts, "min_power_hp", "int") > 0, _given(alerts, "min_power_hp", "int")), "most_price": _given(alerts, "max_price", "double"),
            "least_year": _given(alerts, "min_year", "int"), "most_km": F.when(_given(alerts, "max_km", "int") < ANY_KM, _given(alerts, "max_km", "int")),
        }
    )


def has_short_lists() -> Column:
    """Whether an alert's (a_*) lists have at most SHORT elements each, as nearly all have."""
    return _all([F.size(c) <= SHORT for c in ("a_fuels", "a_engines", "a_trims")])


#: Distinct bounds up to which numbers are put into bands of them.
BOUNDS = 64


def _bands(wants: DataFrame) -> dict[str, Column]:
    """For each number that is tested against bounds the bound that stands for it: the least that is not below it, or the largest that is
    not above it; any bound is met by the one as by the other. With more than BOUNDS of them a number stands for itself."""
    limits = {"price": ("most_price", True), "mileage_km": ("most_km", True), "year": ("least_year", False), "_power": ("least_power", False)}
    found = wants.agg(*[F.slice(F.array_sort(F.collect_set(b)), 1, BOUNDS + 1).alias(b) for b, _ in limits.values()]).first()
    out = {}
    for name, (bound, most) in limits.items():
        kind = dict(wants.dtypes)[bound]
        value, bounds = F.col(name), found[bound]
        if len(bounds) > BOUNDS:
            out[name] = value
            continue
        end = F.lit(float("inf")) if kind == "double" else F.lit(ANY_KM if most else -1).cast(kind)
        stands = F.when(value.isNull(), None)
        for b in bounds if most else bounds[::-1]:
            stands = stands.when(value <= b if most else value >= b, F.lit(b).cast(kind))
        out[name] = stands.otherwise(end if most else F.least(end, F.lit(min(bounds, default=0) - 1).cast(kind)))
    return out


#: What a class of adverts is known by: the elements of alerts' lists that they meet, in with_classes.
MET = ("_met_fuels", "_met_countries", "_met_engines", "_met_trims")


def with_classes(soft: DataFrame, wants: DataFrame, *keep: str) -> DataFrame:
    """with_soft adverts with what tells them apart for some with_wants alerts: bounds in place of numbers (but for keep), and
    for each kind of list the wanted elements that they meet, comma-separated. Elements are met by distinct values, once each."""
    lists = {"fuels": F.col("fuels"), "countries": F.col("countries"), "engines": F.col("engines"), "trims": F.transform("trims", lambda t: t["name"])}
    said = cut(wants.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"_all_{k}") for k, c in lists.items()]))  # one row
    out = soft.withColumns({k: c for k, c in _bands(wants).items() if k not in keep})
    tests = {
        "fuels": (["_fuel"], lambda x: F.coalesce(F.col("_fuel").contains(x), F.lit(False))), "countries": (["_country"], lambda x: F.coalesce(F.col("_country") == x, F.lit(False))),
        "engines": (["_engine"], lambda x: F.coalesce((F.col("_engine") != "") & (F.col("_engine").contains(x) | x.contains(F.col("_engine"))), F.lit(False))),
        "trims": (["_hay", "_close", "_alone"], lambda x: F.coalesce(_named(_needle(x)), F.lit(False))),
    }
    for name, (keys, test) in tests.items():
        met = F.array_join(F.filter(f"_all_{name}", test), ",")
        known = cut(soft.select(*keys).distinct()).crossJoin(F.broadcast(said)).select(*keys, met.alias(f"_met_{name}"))
        out = with_known(out, known, keys)
    return out


def class_matches() -> Column:
    """pair_matches for rows of with_classes, whose met elements are arrays by now."""
    def any_of(names: str, met: str) -> Column:
        return (F.size(names) == 0) | F.coalesce(F.arrays_overlap(names, met), F.lit(False))

    return _all([*_number_tests(), any_of("a_countries", "_met_countries"), any_of("a_fuels", "_met_fuels"), any_of("a_engines", "_met_engines"), (F.size("a_trims") == 0) | (F.coalesce("a_wants_base", F.lit(False)) & F.col("_base")) | F.coalesce(F.arrays_overlap("a_trim_names", "_met_trims"), F.lit(False))])


def _number_tests() -> list[Column]:
    def bound(limit: str, test: Column) -> Column:
        return F.col(limit).isNull() | F.coalesce(test, F.lit(False))

    return [
        bound("a_most_price", F.col("price") <= F.col("a_most_price")), bound("a_least_year", F.col("year") >= F.col("a_least_year")),
        bound("a_most_km", F.col("mileage_km") <= F.col("a_most_km")), bound("a_least_power", F.col("_power") >= F.col("a_least_power")),
    ]


def pair_matches(short: bool = False) -> Column:
    """The test of a joined pair of an advert (with_soft) and an alert (with_wants, its columns behind a_) whose brand and
    model fit. Numbers first; a bound that is set is not met by null. With short lists elements are tested one by one, which
    stays in generated code; a function over a list's elements would take the whole join out of it."""
    def some(names: str, test: Callable[[Column], Column]) -> Column:
        return X.any_of([F.coalesce(test(F.get(names, F.lit(k))), F.lit(False)) for k in range(SHORT)]) if short else F.exists(names, test)

    def any_of(names: str, test: Column) -> Column:
        return F.when(F.size(names) == 0, True).otherwise(F.coalesce(test, F.lit(False)))

    lists = [
        any_of("a_countries", F.array_contains("a_countries", F.col("_country"))),
        any_of("a_fuels", some("a_fuels", lambda f: F.col("_fuel").contains(f))),
        any_of("a_engines", (F.col("_engine") != "") & some("a_engines", lambda e: F.col("_engine").contains(e) | e.contains(F.col("_engine")))),
        any_of("a_trims", (F.col("a_wants_base") & F.col("_base")) | some("a_trims", _named)),
    ]
    return _all(_number_tests() + lists)
