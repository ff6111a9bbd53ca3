"""Adverts out of captured pages: the cards of list pages and the facts of detail pages as typed records with units, and one
record out of both, field by field, with where each field is from."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import numeric as N
from ..functions import text as X

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that hold a fact, and elements that hold its label or its value.
LINES, CELLS = frozenset(("li", "tr", "p", "h2")), frozenset(("div", "td", "th", "span", "dt", "dd"))
FIELDS = {"brand": "string", "model": "string", "version": "string", "year": "int", "mileage_km": "int", "price": "double", "fuel": "string", "transmission": "string", "power_hp": "int"}

# Parts of the labels under which portals list a field, in English, Spanish and French.
LABELS = {
    "year": ("year", "año", "année"),
    "mileage_km": ("kilometer", "kilómetro", "km", "mileage"),
    "fuel": ("fuel", "combustible", "carburant"),
    "transmission": ("transmission", "transmisión", "boîte", "gearbox"),
    "power_hp": ("power", "potencia", "puissance"),
    "price": ("price", "precio", "prix"),
    "brand": ("make", "marca", "marque"),
    "model": ("model", "modelo", "modèle"),
    "version": ("trim", "version"),
}
#: What a value without a label is by its form, tried in order: a unit, a year, words.
FORMS = (
    ("mileage_km", r"(?i)^[\d.,\s]+\s*(km|kms|kilometers?|kilómetros?)$"),
    ("power_hp", r"(?i)^\d+([.,]\d+)?\s*(cv|hp|ps|ch|bhp|kw)$"),
    ("price", r"(?i)^(€|eur)?\s*\d[\d.,\s]*\s*(€|eur|euros?)$|^(€|eur)\s*\d[\d.,\s]*$"),
    ("year", r"^(19|20)\d\d$"),
)


class _Facts(HTMLParser):
    """Pieces of text with the record (data-record of an element around them, '' outside) that they belong to, and how they
    stand: label and value of a list item or a line of two cells, or parts of a text that bars divide."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.stack: list[tuple[str, str]] = []
        self.item: list[str] | None = None
        self.depth = 0

    def record(self) -> str:
        return next((r for _, r in reversed(self.stack) if r), "")

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        given = dict(attrs)
        if tag in LINES:
            self.flush()  # a line that was left open ends here
        self.stack.append((tag, given.get("data-record") or ""))
        if tag in LINES:
            self.item, self.depth = [""], len(self.stack)
        elif self.item is not None and tag in CELLS:
            self.item.append("")
        for name, label in (("data-price", "price"), ("data-year", "year")):
            if given.get(name):
                self.found.append((self.record(), label, given[name]))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is None:
            return
        if self.item is not None and at < self.depth:
            self.flush()
        del self.stack[at:]

    def handle_data(self, data):
        if self.item is not None and self.stack and self.stack[-1][0] not in ("script", "style"):
            self.item[-1] += data

    def flush(self) -> None:
        parts = [" ".join(p.split()) for p in self.item or ()]
        parts, record, self.item = [p for p in parts if p], self.record(), None
        if len(parts) == 2:
            self.found.append((record, parts[0].rstrip(" :").lower(), parts[1]))
        for part in parts if len(parts) != 2 else ():
            if "|" in part:
                self.found += [(record, "", p.strip()) for p in part.split("|") if p.strip()]
            elif ":" in part:
                label, _, value = part.partition(":")
                self.found.append((record, label.strip().lower(), value.strip()))
            else:
                self.found.append((record, "", part))


@udtf(returnType="place int, record string, label string, value string")
class PageFacts:
    """The facts of a page in order, with the record each belongs to."""

    def eval(self, html: str) -> Iterator[tuple]:
        reader = _Facts()
        reader.feed(html or "")
        reader.close()
        reader.flush()
        for place, fact in enumerate(reader.found):
            yield place, *fact


def _field(label: Column, value: Column) -> Column:
    """The field of a fact: by its label, or without one by the form of its value; null if it is none."""
    out = F
    for name, words in LABELS.items():
        out = out.when((label != "") & X.any_of([label.contains(w) for w in words]), name)
    for name, form in FORMS:
        out = out.when((label == "") & value.rlike(form), name)
    return out.when((label == "") & (X.fuel_type(value) != "Unknown"), "fuel").when((label == "") & (X.transmission(value) != "Unknown"), "transmission")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\d]", "").try_cast("long")


def _typed(name: str, value: Column) -> Column:
    """A field's value in its unit: kilometres, euros, horsepower; null for what can't be one."""
    if name == "year":
        year = F.regexp_extract(value, r"((?:19|20)\d\d)", 1).try_cast("int")
        return F.when(year > 1980, year)
    if name == "mileage_km":
        miles = value.rlike(r"(?i)\d\s*(mi|miles)\b")
        return F.when(_digits(value) > 0, F.when(miles, F.floor(_digits(value) * 1.609344 + 0.5)).otherwise(_digits(value))).try_cast("int")
    if name == "price":
        return F.when(_digits(F.regexp_replace(value, r"[.,]\d{2}(?!\d)", "")) > 0, _digits(F.regexp_replace(value, r"[.,]\d{2}(?!\d)", ""))).cast("double")
    if name == "power_hp":
        return N.power_cv(value, allow_bare=True)
    if name in ("fuel", "transmission"):
        known = X.fuel_type(value) if name == "fuel" else X.transmission(value)
        return F.when(known != "Unknown", known)
    return F.nullif(F.trim(value), F.lit(""))


def records(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, record and FIELDS: one row for each record (an element with data-record, '' for facts outside of one) of each page
    that has a fact. Of several facts of a field the first that is one counts. Pages without facts, null and empty ones
    give no row; malformed markup is taken as it comes."""
    facts = pages.select(F.col(key), F.col(html).alias("_html")).lateralJoin(PageFacts(F.col("_html").outer())).drop("_html")
    facts = facts.withColumn("field", _field(F.col("label"), F.col("value"))).where("field is not null")
    first = [F.min(F.when((F.col("field") == name) & _typed(name, F.col("value")).isNotNull(), F.struct("place", _typed(name, F.col("value")).alias("v"))))["v"].cast(kind).alias(name) for name, kind in FIELDS.items()]
    return facts.groupBy(key, "record").agg(*first)


def merged(cards: DataFrame, details: DataFrame, on: tuple[str, ...] = ("record",)) -> DataFrame:
    """Cards with what their detail pages say: a detail's field goes before the card's, and <field>_from says which of them it
    is from, null if neither has it. Cards without a detail stay as they are; details without a card are no adverts."""
    return cards.alias("c").join(details.select(*on, *[F.col(f).alias(f"d_{f}") for f in FIELDS]).alias("d"), list(on), "left").select(
        *[F.col(f"c.{c}") if c not in on else F.col(c) for c in cards.columns if c not in FIELDS],
        *[F.coalesce(F.col(f"d_{f}"), F.col(f"c.{f}")).alias(f) for f in FIELDS],
        *[F.when(F.col(f"d_{f}").isNotNull(), "detail").when(F.col(f"c.{f}").isNotNull(), "card").alias(f"{f}_from") for f in FIELDS],
    )
