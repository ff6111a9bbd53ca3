"""Text normalisation as Column expressions: brands, models, trims, fuels, engine labels."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _letters() -> tuple[str, str]:
    """For translate: all letters whose canonical decomposition is one letter and marks, then all marks; the bare letters."""
    marked, bare, marks = [], [], []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
            continue
        left = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"]
        if len(left) == 1 and left[0] != c:
            marked.append(c)
            bare += left
    return "".join(marked + marks), "".join(bare)


# Words of each fuel, in the order in which fuels are tried; then exact words.
FUELS = (
    ("Diesel", ("diesel", "gasóleo", "gasoleo", "gasoil", "tdi", "hdi", "dci", "bluehdi"), ()),
    ("Hybrid", ("hybrid", "híbrid", "electro/petrol", "electro/diesel", "plug-in", "phev"), ()),
    ("Electric", ("electric", "eléctrico", "electrico", "elektro", "elektrisch", "bev"), ("ev",)),
    ("Petrol", ("petrol", "gasoline", "gasolina", "benzin", "essence", "nafta", "otto"), ("gas",)),
    ("LPG", ("lpg", "gpl", "autogas", "auto-gas", "auto gas", "cng", "gnc", "glp"), ()),
)
# Words of each transmission, automatic ones first.
TRANSMISSIONS = (
    ("Automatic", ("auto", "dsg", "pdks", "tiptronic", "steptronic", "s-tronic")),
    ("Manual", ("manual", "manuell", "manuelle", "schalt")),
)
# Words that are no trim or engine tokens.
VERSION_NOISE = (
    "s-tronic", "stronic", "dsg", "manual", "automatic", "tiptronic", "multitronic", "cvt", "auto", "getriebe",
    "petrol", "diesel", "benzine", "benzin", "essence", "elektro", "unknown", "n/a", "na",
)
# Placeholders of brand or model, and labels that are no model.
PLACEHOLDERS = ("", "unknown", "n/a", "na", "null", "undefined", "-", "none")
JUNK_MODELS = ("-", "—", "–", ".", "?", "n/a", "na")
# Casing of engine families.
ENGINE_CASING = {
    "bluehdi": "BlueHDi", "ecoboost": "EcoBoost", "ecoblue": "EcoBlue", "puretech": "PureTech", "boosterjet": "Boosterjet",
    "skyactiv": "Skyactiv", "multijet": "MultiJet", "twinpower": "TwinPower", "e-tech": "E-Tech", "t-gdi": "T-GDI",
    "vvt-i": "VVT-i", "vvti": "VVT-i",
}


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def filled(c: Column) -> Column:
    """c, or '' for null."""
    return F.coalesce(c, F.lit(""))


def fold(c: Column) -> Column:
    """c in lower case without accents and other marks, whether composed or not; ß, ø and ł stay. One pass over the text, none
    over one of ASCII alone. Hangul syllables stay composed."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(F.lower(c), *_letters()))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_brand(c: Column) -> Column:
    b = squeeze(fold(filled(c)))
    compact = F.regexp_replace(b, "[^a-z0-9]", "")
    return (
        F.when(b == "unknown", "")
        .when((b == "vw") | (compact == "volkswagen"), "volkswagen")
        .when(b.contains("mercedes"), "mercedes-benz")
        .when((compact == "alfaromeo") | (b == "alfa"), "alfa romeo")
        .when(compact == "landrover", "land rover")
        .when(compact == "astonmartin", "aston martin")
        .when(compact == "rollsroyce", "rolls-royce")
        .otherwise(b)
    )


def display_brand(c: Column) -> Column:
    norm, t = normalize_brand(c), F.trim(c)
    return (
        F.when(norm == "bmw", "BMW")
        .when(norm == "volkswagen", "Volkswagen")
        .when(norm == "mercedes-benz", "Mercedes-Benz")
        .when(norm == "seat", "Seat")
        .otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1_000_000))))
    )


def soft_model(c: Column) -> Column:
    return squeeze(F.regexp_replace(fold(filled(c)), "[-_/]+", " "))


def canonical_model(n: Column) -> Column:
    """Spellings of series and classes to 'serie N' and 'clase x'; n is a soft model name."""
    digit = F.regexp_extract(n, r"^(?:(\d)\s*(?:series|er)|serie(?:s)?\s*(\d))$", 1)
    digit2 = F.regexp_extract(n, r"^(?:(\d)\s*(?:series|er)|serie(?:s)?\s*(\d))$", 2)
    letter = F.regexp_extract(n, r"^(?:([a-z])\s+(?:class|klasse)|clase\s+([a-z]))$", 1)
    letter2 = F.regexp_extract(n, r"^(?:([a-z])\s+(?:class|klasse)|clase\s+([a-z]))$", 2)
    return (
        F.when(F.concat(digit, digit2) != "", F.concat(F.lit("serie "), digit, digit2))
        .when(F.concat(letter, letter2) != "", F.concat(F.lit("clase "), letter, letter2))
        .when(n.isin("g wagon", "gwagen", "g wagen"), "clase g")
        .otherwise(n)
    )


def normalize_model(c: Column) -> Column:
    n = soft_model(c)
    return F.when(n == "unknown", "").otherwise(canonical_model(n))


def display_model(c: Column) -> Column:
    return F.array_join(F.transform(F.split(normalize_model(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def model_aliases(c: Column) -> Column:
    """Spellings under which a catalog's model can be looked up, the canonical one first."""
    soft = soft_model(c)
    key = canonical_model(soft)
    d = F.regexp_extract(key, r"^serie (\d)$", 1)
    x = F.regexp_extract(key, r"^clase ([a-z])$", 1)
    none = F.array().cast("array<string>")
    series = F.when(d != "", F.array(F.concat(d, F.lit(" series")), F.concat(F.lit("series "), d), F.concat(d, F.lit("er")), F.concat(d, F.lit(" er")))).otherwise(none)
    classes = F.when(x != "", F.array(F.concat(x, F.lit(" class")), F.concat(x, F.lit(" klasse")), F.concat(F.lit("class "), x))).otherwise(none)
    wagons = F.when(x == "g", F.array(F.lit("g wagon"), F.lit("gwagen"), F.lit("g wagen"))).otherwise(none)
    return F.filter(F.array_distinct(F.concat(F.array(key, soft, normalize_model(c)), series, classes, wagons)), lambda k: k != "")


def usable_model(c: Column) -> Column:
    t = F.trim(filled(c))
    return ~t.isin(*JUNK_MODELS) & t.rlike("[a-zA-Z0-9]")


def valid_listing(brand: Column, model: Column) -> Column:
    return ~F.lower(F.trim(filled(brand))).isin(*PLACEHOLDERS) & ~F.lower(F.trim(filled(model))).isin(*PLACEHOLDERS)


def version_tokens(c: Column) -> Column:
    """Words of a version text that can be trims or engines, then pairs of neighbours; the whole text if there are none."""
    t = F.regexp_replace(F.lower(filled(c)), r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"\d+\s*(?:cv|ch|hp|ps|kw|bhp)\b", " ")
    t = squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}\s.\-]", " "))
    parts = F.filter(F.split(t, " "), lambda w: w != "")
    noise = F.array(*map(F.lit, VERSION_NOISE))

    def good(w: Column) -> Column:
        return (F.length(w) >= 2) & ~F.array_contains(noise, w)

    n = F.size(parts)
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(good(a) & good(b), F.concat(a, F.lit(" "), b)))
    tokens = F.array_distinct(F.concat(F.filter(parts, good), F.filter(pairs, lambda p: p.isNotNull() & (F.length(p) <= 24))))
    return F.when(t == "", F.array().cast("array<string>")).when(F.size(tokens) == 0, F.array(t)).otherwise(tokens)


def spec_token(c: Column) -> Column:
    return squeeze(F.lower(filled(c)))


def fuel_type(c: Column) -> Column:
    f = F.trim(F.lower(filled(c)))
    out = F.when(f == "", "Unknown")
    for name, words, exact in FUELS:
        out = out.when(any_of([f.contains(w) for w in words] + [f == w for w in exact]), name)
    return out.otherwise("Unknown")


def labelled_fuel(c: Column) -> Column:
    """The fuel that a portal's label stands for, commas aside; null if it names none."""
    found = fuel_type(F.replace(filled(c), F.lit(","), F.lit("")))
    return F.when(found != "Unknown", found)


# Whole labels that a list portal gives fuels; a label that only contains hybrid is one, too.
LIST_LABELS = {
    "Diesel": ("diesel", "diésel", "gasóleo", "gasoleo", "gasoil"),
    "Petrol": ("petrol", "gasoline", "gasolina", "benzin", "benzine", "essence", "nafta"),
    "Hybrid": ("hybrid", "híbrid", "híbrido", "hibrid", "hibrido", "phev", "plug-in", "plugin"),
    "Electric": ("electric", "eléctric", "electrico", "eléctrico", "electrica", "eléctrica", "elektro", "elektrisch", "ev", "bev"),
    "LPG": ("lpg", "gpl", "autogas", "cng", "gnc"),
}


def list_label_fuel(c: Column) -> Column:
    """The fuel of a list portal's label, which must be the whole of it; null for any other."""
    t = F.trim(F.lower(filled(c)))
    out = F
    for name, labels in LIST_LABELS.items():
        out = out.when(t.isin(*labels) | (t.contains("hybrid") if name == "Hybrid" else F.lit(False)), name)
    return out.otherwise(None)


def model_spellings(c: Column) -> list[Column]:
    """model_aliases one by one and repeated where there are fewer; of a literal they fold to literals."""
    soft = soft_model(c)
    key = canonical_model(soft)
    digit, letter = F.regexp_extract(key, r"^serie (\d)$", 1), F.regexp_extract(key, r"^clase ([a-z])$", 1)
    series = [F.when(digit != "", F.concat(F.lit(a), digit, F.lit(b))).otherwise(key) for a, b in (("", " series"), ("series ", ""), ("", "er"), ("", " er"))]
    classes = [F.when(letter != "", F.concat(F.lit(a), letter, F.lit(b))).otherwise(key) for a, b in (("", " class"), ("", " klasse"), ("class ", ""))]
    wagons = [F.when(letter == "g", w).otherwise(key) for w in ("g wagon", "gwagen", "g wagen")]
    return [key, soft, normalize_model(c), *series, *classes, *wagons]


def lookup_keys(c: Column) -> Column:
    """Spellings under which a catalog may have a model, in the order in which they are tried: as written, canonical, aliases."""
    soft = soft_model(c)
    return F.filter(F.array_distinct(F.concat(F.array(soft, canonical_model(soft)), model_aliases(c))), lambda k: k != "")


def resolved_tokens(stored: Column, version: Column) -> Column:
    """The stored tokens if there are any, else those of the version text."""
    return F.when(F.size(stored) > 0, stored).otherwise(version_tokens(version))


def transmission(c: Column) -> Column:
    t = F.trim(F.lower(filled(c)))
    out = F.when(t == "", "Unknown")
    for name, words in TRANSMISSIONS:
        out = out.when(any_of([t.contains(w) for w in words]), name)
    return out.otherwise("Unknown")


def norm_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(fold(filled(c)), "[_/]+", " "))


def engine_key(c: Column) -> Column:
    """norm_text without a lone leading 0 or 0.0."""
    return F.trim(F.regexp_replace(norm_text(c), r"^0(?:\.0)?(?=\s)", ""))


def engine_label(c: Column) -> Column:
    casing = F.create_map(*[F.lit(x) for pair in ENGINE_CASING.items() for x in pair])
    return F.array_join(F.transform(F.split(engine_key(c), " "), lambda w: F.coalesce(F.element_at(casing, w), F.upper(w))), " ")


def engine_query_values(c: Column) -> Column:
    """An engine key and the spellings with a bogus leading zero under which old rows may be stored."""
    n = engine_key(c)
    return F.when(n == "", F.array().cast("array<string>")).when(n.rlike(r"^\d"), F.array(n)).otherwise(F.array(n, F.concat(F.lit("0 "), n), F.concat(F.lit("0.0 "), n)))


def compact_name(c: Column) -> Column:
    return F.regexp_replace(fold(filled(c)), "[^a-z0-9]", "")


def clean_text(c: Column) -> Column:
    """Words with single spaces; a no-break space is a space."""
    return squeeze(F.translate(filled(c), "\u00a0", " "))


def country_code(c: Column) -> Column:
    k = F.upper(F.trim(filled(c)))
    return F.when(k == "UK", "GB").otherwise(k)


def iso_country(c: Column) -> Column:
    """The code that a text consists of, two letters; null for anything else."""
    k = country_code(c)
    return F.when(k.rlike("^[A-Z]{2}$"), k)


# Labels of country codes.
COUNTRY_LABELS = {
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "CH": "Switzerland", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark",
    "EE": "Estonia", "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GR": "Greece", "HR": "Croatia",
    "HU": "Hungary", "IE": "Ireland", "IT": "Italy", "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "NL": "Netherlands",
    "NO": "Norway", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SE": "Sweden", "SI": "Slovenia", "SK": "Slovakia",
    "UK": "United Kingdom",
}


def country_label(c: Column) -> Column:
    """A code's label; an unknown code as it is, Unknown for none."""
    k = F.upper(F.trim(filled(c)))
    labels = F.create_map(*[F.lit(x) for pair in COUNTRY_LABELS.items() for x in pair])
    return F.when(k == "", "Unknown").otherwise(F.coalesce(F.try_element_at(labels, k), k))


def country_list(codes: Column) -> Column:
    """The labels of an array of codes, or Any."""
    return F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.array_join(F.transform(codes, lambda k: country_label(k)), ", ")).otherwise("Any")


def alert_fingerprint(c: Column) -> Column:
    """An alert's text with numbers blotted out, at most 180 characters: what the cooldown compares."""
    return F.substring(F.regexp_replace(c, r"\d+", "#"), 1, 180)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def chat_markdown(c: Column) -> Column:
    """Light markdown to HTML: headings and bold become <b>, bullets a dot."""
    t = F.regexp_replace(escape_html(c), r"(?m)^#{1,6}\s*(.+)$", "<b>$1</b>")
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "<b>$1</b>")
    return F.regexp_replace(t, r"(?m)^\s*[-*]\s+", "• ")


def promoted(c: Column) -> Column:
    """A scalar as a list: of one, or empty for '' and null."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
