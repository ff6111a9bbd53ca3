"""Catalog lookups: trims of a model in a text, engines named in a version text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..sources.shared import cut, with_known
from ..sources.tables import small_side

# Engine families beside a displacement.
FAMILIES = "tfsi|tdi|tsi|tdci|dci|hdi|bluehdi|ecoboost|ecoblue|puretech|tce|sce|gdi|mpi|vvt-?i|hybrid|etsi"
ALL_FAMILIES = FAMILIES + "|boosterjet|skyactiv|multijet|firefly|twinpower|boxer|dig-t|crdi|t-gdi|e-tech"
CODES = r"\b((?:a|c|e|gla|glb|glc|gle)\s?\d{2,3}\s?d?|[1-8]\d{2}[di]|[dptbm]\d{2,3})\b"
PLAIN_CODES = r"\b((?:a|c|e|gla|glb|glc|gle)\s?\d{2,3}\s?d?|[1-8]\d{2}[di])\b"
CUES = r"\b(?:diesel|petrol|gasoline|hybrid|mhev|phev|hev|cdi|dci|tdi|tfsi|tsi|tce|gdi|crdi|hdi|bluehdi|turbo|boxer|v-?6|v-?8|v-?10|v-?12|w-?12|w-?16|[dptbm]\d{2,3})\b"
# A marketing number with its family, a displacement that a cue makes an engine, cylinders in V and in W.
MARKETING = r"\b([1-9]\d)\s*(tfsi|tdi|tsi|etsi)\b"
CUED_SIZE, V_ENGINE, W_ENGINE = r"\b([1-9]\.\d)\b", r"\bv-?(6|8|10|12)\b", r"\bw-?(12|16)\b"
# Families that a brand prefers for a displacement that several engines share, best first; then any brand's.
BRAND_FAMILIES = {
    "audi": ("tfsi", "tdi", "tsi"),
    "volkswagen": ("tsi", "tdi", "etsi", "mpi"),
    "seat": ("tsi", "tdi", "mpi"),
    "cupra": ("etsi", "tsi", "tdi"),
    "skoda": ("tsi", "tdi", "mpi"),
    "peugeot": ("puretech", "bluehdi", "hdi"),
    "citroen": ("puretech", "bluehdi", "hdi"),
    "ds automobiles": ("puretech", "bluehdi", "hdi"),
    "opel": ("turbo", "diesel"),
    "vauxhall": ("turbo", "diesel"),
    "renault": ("tce", "sce", "dci", "e-tech", "hybrid"),
    "dacia": ("tce", "sce", "dci"),
    "ford": ("ecoboost", "ecoblue", "tdci"),
    "toyota": ("hybrid", "vvt-i"),
    "lexus": ("hybrid",),
    "honda": ("vtec", "hybrid"),
    "hyundai": ("t-gdi", "gdi", "crdi", "hybrid"),
    "kia": ("t-gdi", "gdi", "crdi", "hybrid"),
    "nissan": ("dig-t", "dci", "e-power", "hybrid"),
    "mazda": ("skyactiv-g", "skyactiv-d", "skyactiv"),
    "fiat": ("firefly", "multijet", "hybrid", "t-jet"),
    "alfa romeo": ("hybrid", "multijet", "turbo"),
    "jeep": ("turbo", "multijet"),
    "suzuki": ("boosterjet", "dualjet", "hybrid"),
    "mitsubishi": ("turbo", "hybrid", "diesel"),
    "volvo": ("b3", "b4", "b5", "t5", "t6", "d4"),
    "mini": ("twinpower",),
    "porsche": ("turbo",),
}
DEFAULT_FAMILIES = ("tfsi", "tsi", "etsi", "ecoboost", "puretech", "tce", "t-gdi", "turbo", "hybrid", "tdi", "dci", "bluehdi", "ecoblue", "tdci", "mpi", "sce")

#: A small catalog of our own: brand, model, engine, aliases, typical power; trims by brand and model.
ENGINES = (
    ("audi", "a4", "2.0 TDI", "2.0 tdi,20 tdi", 150), ("audi", "a4", "2.0 TFSI", "2.0 tfsi", 190), ("audi", "a4", "35 TDI", "35 tdi", 163),
    ("volkswagen", "golf", "1.0 TSI", "1.0 tsi", 110), ("volkswagen", "golf", "1.5 TSI", "1.5 tsi,1.5 etsi", 130), ("volkswagen", "golf", "2.0 TDI", "2.0 tdi", 115),
    ("dacia", "duster", "1.0 TCe", "1.0 tce", 90), ("dacia", "duster", "1.5 dCi", "1.5 dci,1.5 blue dci", 115), ("peugeot", "208", "1.2 PureTech", "1.2 puretech", 100),
    ("peugeot", "208", "1.5 BlueHDi", "1.5 bluehdi", 100), ("ford", "focus", "1.0 EcoBoost", "1.0 ecoboost", 125), ("bmw", "serie 3", "320d", "320d", 190),
)
TRIMS = {("audi", "a4"): ("Base", "S line", "Advanced", "Black line"), ("volkswagen", "golf"): ("Base", "Life", "Style", "R-Line", "GTI"), ("seat", "leon"): ("Reference", "Style", "FR", "Xcellence")}


def engine_catalog(spark: SparkSession, rows=ENGINES) -> DataFrame:
    """brand, model, ordinal, engine, engine_norm, aliases, power: a dimension of some thousand rows at most."""
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "ordinal int, brand string, model string, engine string, alias_csv string, power int")
    return table.select("ordinal", "brand", "model", "engine", X.engine_key(F.col("engine")).alias("engine_norm"), F.split("alias_csv", ",").alias("aliases"), "power")


def trim_in_text(trim: Column, text: Column) -> Column:
    """Whether a text names a trim. Names of one or two characters must stand alone; others may be part of a word, and
    spaces and hyphens don't matter."""
    needle, hay = X.norm_text(trim), X.norm_text(text)
    close = F.regexp_replace(needle, r"[\s\-]+", "")
    alone = F.concat(F.lit(" "), F.regexp_replace(hay, "[^a-z0-9]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))
    return F.when((needle == "") | (hay == ""), False).when(F.length(needle) <= 2, alone).otherwise(hay.contains(needle) | ((F.length(close) >= 3) & F.regexp_replace(hay, r"[\s\-]+", "").contains(close)))


def trims_of(listings: DataFrame, trims: DataFrame) -> DataFrame:
    """portal_id, trims: those of the model's catalog (brand, model, trim) that the version names, longest first; Base
    if it names none and the model has a Base."""
    hits = listings.join(small_side(trims), (F.col("brand_norm") == F.col("brand")) & (F.col("model_norm") == F.col("model")))
    base = X.norm_text(F.col("trim")) == "base"
    named = F.when(~base & trim_in_text(F.col("trim"), F.col("version")), F.struct(-F.length("trim"), F.col("trim").alias("trim")))
    found = F.transform(F.array_sort(F.collect_list(named)), lambda x: x["trim"])
    grouped = hits.groupBy("portal_id").agg(found.alias("named"), F.max(base).alias("has_base"))
    return grouped.select("portal_id", F.when((F.size("named") == 0) & F.col("has_base"), "Base").otherwise(F.array_join("named", ",")).alias("trims"))


def matches_trims(version: Column, selected: list[str], catalog: list[str]) -> Column:
    """Whether a version names one of the selected trims, or Base is selected and it names no other trim of the catalog."""
    hit = X.any_of([F.lit(False), *[trim_in_text(F.lit(s), version) for s in selected]])
    other = X.any_of([F.lit(False), *[trim_in_text(F.lit(s), version) for s in catalog if s.lower() != "base"]])
    if catalog and any(s.strip().lower() == "base" for s in selected):
        return hit | ~other
    return hit


def engine_heuristic(version: Column) -> Column:
    """The engine that a text names without a catalog: displacement and family, marketing number and family, a code, a
    displacement with something that says engine, or cylinders; null if it names none."""
    hay = X.norm_text(version)

    def group(pattern: str, k: int = 1) -> Column:
        return F.regexp_extract(hay, pattern, k)

    size, family = rf"\b(\d\.\d)\s*({FAMILIES})\b", MARKETING
    code = F.trim(F.regexp_replace(group(CODES), r"\s+", " "))
    bare, v, w = group(CUED_SIZE), group(V_ENGINE), group(W_ENGINE)
    cylinders = F.when(v != "", F.concat(F.lit(" v"), v)).when(w != "", F.concat(F.lit(" w"), w)).otherwise("")
    return (
        F.when(group(size) != "", F.concat_ws(" ", group(size), group(size, 2)))
        .when(group(family) != "", F.concat_ws(" ", group(family), group(family, 2)))
        .when(F.length(code) >= 3, code)
        .when((bare != "") & hay.rlike(CUES), F.concat(bare, cylinders))
        .when(v != "", F.concat(F.lit("v"), v))
    )


def bare_displacement(version: Column) -> Column:
    """A displacement that stands without a family or a code; null if there is none."""
    hay = X.norm_text(version)
    size = F.regexp_extract(hay, r"\b(\d\.\d)\b", 1)
    return F.when((size != "") & ~hay.rlike(rf"\b\d(?:\.\d)?\s*(?:{ALL_FAMILIES})\b") & ~hay.rlike(PLAIN_CODES), size)


def _family_rank(brand: Column, engine: Column) -> Column:
    """Place of the first preferred family in an engine's key; null if none occurs."""
    own = F.create_map(*[x for name, families in BRAND_FAMILIES.items() for x in (F.lit(name), F.array(*map(F.lit, families)))])
    order = F.concat(F.coalesce(F.element_at(own, brand), F.array().cast("array<string>")), F.array(*map(F.lit, DEFAULT_FAMILIES)))
    return F.array_min(F.transform(order, lambda f, i: F.when(engine.contains(f), i)))


def with_engines(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """listings (brand_norm, model_norm, version, power_hp) with found_engine, found_power, found_source.

    First the longest alias or name of the model's catalog that the version contains; then, for a bare displacement,
    the catalog's engines of that size: a single one, the nearest in power, or the brand's preferred family; where none
    decides only the power is known. Without such engines the heuristic names it. Texts repeat, so all of this is done
    once for each distinct model, version and known power, and handed back to the adverts by with_known; an alias is
    looked for only in the versions of its model.
    """
    every = F.array_append("aliases", F.col("engine_norm"))
    names = F.filter(every, lambda a: (F.length(a) >= 2) & ~a.rlike(r"^\d\.\d$"))
    rank = _family_rank(F.col("brand"), F.col("engine_norm"))
    c = catalog.select(F.col("brand").alias("c_brand"), F.col("model").alias("c_model"), "ordinal", "engine_norm", every.alias("_every"), names.alias("_names"), rank.alias("_rank"), F.col("power").alias("c_power"))
    keys = ("brand_norm", "model_norm", "version", "_known")
    asked = listings.withColumn("_known", F.when(F.col("power_hp") > 20, F.col("power_hp")))
    version = F.col("version")
    base = cut(asked.select(*keys).distinct())
    texts = base.select("version").distinct().select(version.alias("_of"), X.norm_text(version).alias("hay"), bare_displacement(version).alias("bare"), N.power_cv(version).alias("_said"), engine_heuristic(version).alias("_guess"))
    base = base.join(texts, version.eqNullSafe(F.col("_of"))).drop("_of").withColumn("hint", F.coalesce("_known", "_said"))
    base = base.repartition(int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but each meets all its model's engines
    rows = base.join(c, (F.col("brand_norm") == F.col("c_brand")) & (F.col("model_norm") == F.col("c_model")), "left")
    alias = F.array_max(F.transform(F.filter("_names", lambda a: F.col("hay").contains(a)), lambda a: F.length(a)))
    sized = F.exists("_every", lambda a: (a == F.col("bare")) | a.startswith(F.concat(F.col("bare"), F.lit(" "))))
    rows = rows.withColumn("alias_len", alias).withColumn("sized", F.coalesce(sized, F.lit(False)))
    entry = F.struct(F.col("engine_norm").alias("engine"), F.col("c_power").alias("power"))
    rank = F.col("_rank")
    best = rows.groupBy(*keys, "hint", "_guess").agg(
        F.max(F.when(F.col("alias_len").isNotNull(), F.struct("alias_len", -F.col("ordinal"), entry.alias("e")))).alias("alias"),
        F.count_if("sized").alias("n_sized"),
        F.min(F.when(F.col("sized"), F.struct(F.abs(F.coalesce("c_power", F.lit(0)) - F.col("hint")), "ordinal", entry.alias("e")))).alias("nearest"),
        F.min(F.when(F.col("sized") & rank.isNotNull(), F.struct(rank, "ordinal", entry.alias("e")))).alias("preferred"),
    )
    by_size = F.when((F.col("n_sized") == 1) | (F.col("hint") > 20), F.col("nearest.e")).otherwise(F.col("preferred.e"))
    found = F.coalesce(F.col("alias.e"), F.when(F.col("n_sized") > 0, by_size))
    guess = F.when(F.col("n_sized") == 0, F.col("_guess"))
    facts = best.select(
        *keys,
        F.coalesce(found["engine"], guess, F.lit("")).alias("found_engine"),
        F.coalesce("hint", found["power"]).alias("found_power"),
        F.when(found.isNotNull(), "catalog").when(guess.isNotNull() | F.col("hint").isNotNull(), "heuristic").alias("found_source"),
    )
    return with_known(asked, facts, list(keys)).drop("_known")


def resolve_engines(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """portal_id, engine_norm, engine_power, engine_source (see with_engines), one row per advert."""
    return with_engines(listings, catalog).select("portal_id", F.col("found_engine").alias("engine_norm"), F.col("found_power").alias("engine_power"), F.col("found_source").alias("engine_source"))


def catalog_models(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """names (brand, model as stored) with found: the catalog's model (brand, model) that it means. Lookup keys are tried in
    order, the first that the catalog has wins; else the longest catalog model that the name starts with, at a word's end."""
    asked = names.select(X.normalize_brand(F.col("brand")).alias("q_brand"), F.col("model").alias("q_model")).distinct()
    known = catalog.select(X.normalize_brand(F.col("brand")).alias("c_brand"), X.soft_model(F.col("model")).alias("c_key"), F.col("model").alias("c_model")).distinct()
    tried = asked.select("q_brand", "q_model", F.posexplode(X.lookup_keys(F.col("q_model"))).alias("place", "key"))
    exact = tried.join(small_side(known), (F.col("q_brand") == F.col("c_brand")) & (F.col("key") == F.col("c_key")))
    exact = exact.groupBy("q_brand", "q_model").agg(F.min_by("c_model", F.struct("place", "c_model")).alias("by_key"))
    # Beginnings of a name, word by word, are keys of an equi-join, too.
    words = F.split(X.soft_model(F.col("q_model")), " ")
    starts = asked.select("q_brand", "q_model", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("key"))
    prefix = starts.join(small_side(known), (F.col("q_brand") == F.col("c_brand")) & (F.col("key") == F.col("c_key")))
    prefix = prefix.groupBy("q_brand", "q_model").agg(F.min_by("c_model", F.struct(-F.length("key"), "c_model")).alias("by_prefix"))
    found = exact.join(prefix, ["q_brand", "q_model"], "full").select("q_brand", "q_model", F.coalesce("by_key", "by_prefix").alias("found"))
    return names.join(small_side(found), (X.normalize_brand(F.col("brand")) == F.col("q_brand")) & (F.col("model") == F.col("q_model")), "left").drop("q_brand", "q_model")


def enriched(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """listings with engine_norm and power_hp filled where blank; what is stored is never overwritten, but for a bogus
    leading zero of an engine."""
    stored = X.engine_key(F.col("engine_norm"))
    filled = with_engines(listings, catalog).withColumn("engine_norm", F.when(stored != "", stored).otherwise(F.col("found_engine")))
    return filled.withColumn("power_hp", F.coalesce(F.when(F.col("power_hp") > 0, F.col("power_hp")), F.col("found_power"))).drop("found_engine", "found_power", "found_source")
