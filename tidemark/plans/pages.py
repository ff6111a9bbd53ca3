"""Queries: extraction from captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adverts as A
from ..sources import pages as P
from .registry import Data, query


@query()
def html_cards(d: Data):
    return P.cards(d.table("pages"))


@query("SELECT page_id, unnest(['year', 'site']) AS label, unnest(['2019', regexp_extract(url, '://([^/?#]*)', 1)]) AS value FROM pages")
def html_kv_extract(d: Data):
    """Pages with a list of facts at their end, which the tables' pages lack."""
    facts = F.concat("html", F.lit("<ul><li>Year : 2019</li><li>Site: "), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("</li><li>no value:</li></ul>"))
    return P.labels(d.table("pages").withColumn("html", facts))


@query()
def html_outbound_links(d: Data):
    return P.outbound_links(d.table("pages"), "example.org")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS raw_title FROM pages")
def html_title(d: Data):
    return d.table("pages").select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " ")).alias("raw_title"))


def advert_pages(d: Data):
    """List pages with a card, and detail pages of two thirds of them, made of the tables' pages, which have no adverts."""
    k, text = F.col("page_id"), lambda c: c.cast("string")
    info = F.concat_ws(" | ", text(2000 + k % 20), F.concat(F.format_number(1000 * (1 + k % 150), 0), F.lit(" km")), F.when(k % 2 == 0, "Diesel").otherwise("Gasolina"), F.when(k % 5 != 0, F.concat(text(60 + k % 90), F.lit(" kW"))))
    card = F.concat(F.lit('<div class="card" data-record="oy-'), text(k), F.lit('" data-price="'), text(5000 + k), F.lit('"><h2>Make: Seat</h2><p>'), info, F.lit("<p>Model: Le&oacute;n"), F.lit("</div>"))
    facts = F.concat(F.lit('<ul class="basic-info" data-record="oy-'), text(k), F.lit('"><li><div>Year</div><div>'), text(1990 + k % 25), F.lit("</div></li><li><div>Mileage</div><div>"), text(k % 90 + 1), F.lit(" mi</div></li><li>Power: "), text(70 + k % 50), F.lit(" CV</li><li><div>Transmission</div><div>"), F.when(k % 7 == 0, "?").otherwise("Automatic"), F.lit("</div></li><li>Trim : FR</ul>"))
    pages = d.table("pages").select("page_id", "html")
    return pages.withColumn("html", F.concat("html", card)), pages.where("page_id % 3 <> 0").withColumn("html", F.concat(facts, "html"))


@query("""WITH x AS (SELECT page_id AS k, page_id % 3 <> 0 AS d FROM pages) SELECT 'oy-' || k AS record, 'Seat' AS brand, 'León' AS model, CASE WHEN d THEN 'FR' END AS version, CASE WHEN d AND 1990 + k % 25 > 1980 THEN 1990 + k % 25 ELSE 2000 + k % 20 END::INT AS year,
CASE WHEN d THEN floor((k % 90 + 1) * 1.609344::DOUBLE + 0.5) ELSE 1000 * (1 + k % 150) END::INT AS mileage_km, (5000 + k)::DOUBLE AS price, CASE WHEN k % 2 = 0 THEN 'Diesel' ELSE 'Petrol' END AS fuel, CASE WHEN d AND k % 7 <> 0 THEN 'Automatic' END AS transmission,
CASE WHEN d THEN 70 + k % 50 WHEN k % 5 <> 0 THEN floor((60 + k % 90) * 1.35962::DOUBLE + 0.5) END::INT AS power_hp, CASE WHEN d THEN 'detail' ELSE 'card' END AS year_from, CASE WHEN d THEN 'detail' WHEN k % 5 <> 0 THEN 'card' END AS power_hp_from, 'card' AS price_from FROM x""")
def advert_records(d: Data):
    cards, details = advert_pages(d)
    found = A.merged(A.records(cards).where("record <> ''"), A.records(details).where("record <> ''"))
    return found.select("record", *A.FIELDS, "year_from", "power_hp_from", "price_from")
