"""Queries: text functions over the tables' own columns, written the way portals and people write them, by rules that SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import freetext as T
from ..functions import numeric as N
from ..functions import text as X
from .registry import Data, query

@query("SELECT p_partkey, lower(p_brand) AS brand, p_brand AS shown, lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' gran' ELSE '' END AS model FROM part")
def part_names(d: Data):
    """Brands with accents, capitals and blanks, models with dashes and underscores."""
    key = F.col("p_partkey")
    brand = F.when(key % 4 == 0, F.concat(F.lit("  "), F.upper("p_brand"))).when(key % 4 == 1, F.replace("p_brand", F.lit("a"), F.lit("á"))).when(key % 4 == 2, F.concat(F.replace("p_brand", F.lit("B"), F.lit("b")), F.lit("\t"))).otherwise(F.col("p_brand"))
    model = F.concat(F.when(key % 3 == 0, F.initcap("p_type")).otherwise(F.replace("p_type", F.lit("O"), F.lit("Ö"))), F.when(key % 2 == 0, F.when(key % 3 == 0, "_/Gran").otherwise(" - gran")).otherwise(""))
    shown = X.display_brand(F.trim(F.when(key % 4 == 1, F.col("p_brand")).otherwise(brand)))
    return d.table("part").select("p_partkey", X.normalize_brand(brand).alias("brand"), F.replace(shown, F.lit("\t"), F.lit("")).alias("shown"), X.normalize_model(model).alias("model"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Petrol' WHEN 3 THEN 'LPG' ELSE 'Unknown' END AS fuel,
  CASE p_partkey % 3 WHEN 0 THEN 'Automatic' WHEN 1 THEN 'Manual' ELSE 'Unknown' END AS gears FROM part""")
def part_fuels(d: Data):
    """Versions with a word of a fuel and of a gearbox somewhere."""
    key, name = F.col("p_partkey"), F.col("p_name")
    fuel = F.when(key % 5 == 0, F.concat(F.upper(name), F.lit(" 2.0 TDI"))).when(key % 5 == 1, F.concat(F.lit("Plug-In "), name)).when(key % 5 == 2, F.concat(name, F.lit(", Benzin"))).when(key % 5 == 3, F.concat(F.lit("GLP/"), name)).otherwise(name)
    gears = F.when(key % 3 == 0, F.concat(name, F.lit(" DSG-7"))).when(key % 3 == 1, F.concat(F.lit("Schaltgetriebe, "), name)).otherwise(name)
    return d.table("part").select("p_partkey", X.fuel_type(fuel).alias("fuel"), X.transmission(gears).alias("gears"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN floor(p_size * 4 * 1.35962::DOUBLE + 0.5) WHEN 1 THEN p_size * 4 + 20 ELSE p_size * 4 + 40 END::BIGINT AS power, string_split(p_name, ' ') || CASE WHEN length(p_name) <= 24 THEN [p_name] ELSE [] END AS tokens,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name END AS engine FROM part WHERE p_size * 4 BETWEEN 40 AND 400""")
def part_powers(d: Data):
    """Versions with kilowatts or horsepower among their words."""
    key, name = F.col("p_partkey"), F.col("p_name")
    size = (F.col("p_size") * 4).cast("string")
    version = F.when(key % 3 == 0, F.concat(name, F.lit(" ("), size, F.lit(" kW)"))).when(key % 3 == 1, F.concat((F.col("p_size") * 4 + 20).cast("string"), F.lit("CV "), name)).otherwise(F.concat(name, F.lit(" "), (F.col("p_size") * 4 + 40).cast("string"), F.lit(" PS, DSG")))
    engine = F.when(key % 2 == 0, F.concat(F.lit("0.0 "), F.upper(name))).otherwise(F.replace(name, F.lit(" "), F.lit("_")))
    return d.table("part").where("p_size * 4 between 40 and 400").select("p_partkey", N.power_cv(version).cast("long").alias("power"), X.version_tokens(version).alias("tokens"), X.engine_key(engine).alias("engine"))


@query("""SELECT portal_id, floor(price)::BIGINT AS amount, CASE WHEN floor(price) BETWEEN 1000 AND 500000 THEN floor(price)::BIGINT END AS hint, CASE WHEN mileage_km BETWEEN 1 AND 799999 THEN mileage_km::BIGINT END AS km, year::BIGINT AS year, year AS registered FROM listing""", listings=True)
def listing_hints(d: Data):
    """Prices, mileages and years inside what a customer writes and inside a portal's cells."""
    whole = F.floor("price").cast("long")
    dotted, km = F.translate(F.format_number(whole, 0), ",", "."), F.format_number(F.col("mileage_km"), 0)
    k = F.col("mileage_km") / 1000 % 3
    cell = F.when(k == 0, F.concat(dotted, F.lit(" €"))).when(k == 1, F.concat(F.lit("EUR "), F.format_number(whole, 0), F.lit(".00"))).otherwise(F.concat(F.lit("ab "), F.translate(dotted, ".", " "), F.lit(",-")))
    said = F.concat(F.lit("A "), F.col("model"), F.lit(" from "), F.col("year").cast("string"), F.lit(" with "), km, F.when(k == 0, " km for about ").otherwise(" kilometros, around "), dotted, F.when(k == 1, " euros").otherwise(" please"))
    date = F.concat(F.lpad((1 + k).cast("int").cast("string"), 2, "0"), F.lit("/"), F.col("year").cast("string"))
    return d.listing.select("portal_id", N.parse_amount(cell).alias("amount"), T.hinted_price(said).alias("hint"), T.hinted_km(said).alias("km"), T.hinted_year(said).alias("year"), N.parse_year(date).alias("registered"))


@query("""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS again, CASE WHEN (conv_id + turn) % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS broken, CASE (conv_id + turn) % 4 WHEN 2 THEN 'SE' WHEN 3 THEN 'DE' ELSE 'BE' END AS country FROM conversations WHERE text IS NOT NULL AND length(text) > 0""")
def turn_intents(d: Data):
    """Turns of the conversations, each with a request put behind its whole text and a place behind a mark."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    said = F.concat("text", F.when(k == 0, ". Envíame el anuncio otra vez!").when(k == 1, "\nThe URL is BROKEN...").otherwise(" Gracias."))
    place = F.concat(F.md5("text"), F.when(k == 2, " Göteborg, Suède").when(k == 3, " - Autohaus Berlin").otherwise(" Gent (Belgium)"))
    turns = d.table("conversations").where("text is not null and length(text) > 0")
    return turns.select("conv_id", "turn", T.wants_again(said).cast("long").alias("again"), T.reports_broken(said).cast("long").alias("broken"), T.country_of_text(place).alias("country"))


@query("SELECT p_partkey, 'gear' = ANY(string_split(p_name, ' ')) OR contains(p_name, 'gear') AS has, p_partkey % 2 = 0 AS fits, p_partkey % 3 <> 0 AS same FROM part")
def part_specs(d: Data):
    """Wanted specs with country words among them, labels of engines against a wanted fuel, spellings of one name."""
    key, name = F.col("p_partkey"), F.col("p_name")
    specs = F.array(F.lit(" Gear "), F.lit("Italia"), F.lit("es"))
    engine = F.concat(name, F.when(key % 2 == 0, " 2.0 TDI").otherwise(" 1.0 TSI"))
    other = F.when(key % 3 != 0, F.upper(F.replace(name, F.lit(" "), F.lit("-")))).otherwise(F.concat(name, F.lit("x")))
    return d.table("part").select("p_partkey", T.has_specs(name, specs).alias("has"), T.engine_fits_fuel(engine, ("Diesel",)).alias("fits"), (X.compact_name(other) == X.compact_name(name)).alias("same"))


@query("SELECT page_id, '<b>' || page_id || '</b> ' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '• <b>x</b>' AS shown, 'Page ' || page_id || ' of all' AS cleaned FROM pages WHERE url IS NOT NULL AND NOT contains(url, '*') AND NOT contains(url, chr(10))")
def page_markdown(d: Data):
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("**"), k, F.lit("** "), F.col("url"), F.lit("\n- **x**"))
    dirty = F.concat(F.lit(" Page\n\t"), k, F.lit("  of  all "))
    rows = d.table("pages").where(F.col("url").isNotNull() & ~F.col("url").contains("*") & ~F.col("url").contains("\n"))
    return rows.select("page_id", X.chat_markdown(text).alias("shown"), X.clean_text(dirty).alias("cleaned"))
