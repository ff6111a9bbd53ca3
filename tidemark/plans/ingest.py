"""Queries: ingest, drift, backfills, self-check, free text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import freetext as T
from ..functions import numeric as N
from ..functions import text as X
from ..functions import timewin as W
from ..operators import catalog as C
from ..operators import ingest as I
from ..operators import lifecycle as L
from ..operators import stats as S
from .registry import Data, query
from .scalars import expected

expected("hint_price", "long", [("around 70.000 please", 70000), ("€ 12500", 12500), ("12,5k for it", 12500), ("about 900", None), ("a red car", None), ("20.000 euros", 20000), ("80.000 km, about 15.500", 15500), ("~ 70k", 70000), ("unos 9.900,", 9900), ("2018 Golf 18k", 18000), ("600.000 €", None)], T.hinted_price)
expected("hint_year", "long", [("from 2018 or so", 2018), ("an old 1999", 1999), ("car 20", None)], T.hinted_year)
expected("hint_km", "long", [("with 85.000 km", 85000), ("120000 kilometers", 120000), ("900000 km", None), ("km", None), ("0 km", None), ("12 500 kilometros", 500)], T.hinted_km)
expected("intent_again", "long", [("send it again", 1), ("otra vez por favor", 1), ("a new one", 0), ("please re-send it", 1), ("the same car as before", 1), ("I lost the link", 1), ("Mándame el enlace", 1), ("reenvíalo", 0), ("reenvía eso", 1), ("perdí el link", 1), ("against", 0), ("same colour", 0), ("send me a link", 0)], lambda c: T.wants_again(c).cast("long"))
expected("intent_broken", "long", [("the link is broken", 1), ("el anuncio no funciona", 1), ("dead url", 1), ("nice link", 0), ("the listing doesn't work", 1), ("El enlace está caído", 1), ("404 on that ad", 1), ("not working as a dealer, nice ad", 0), ("roto el anuncio", 1), ("broken car", 0)], lambda c: T.reports_broken(c).cast("long"))
expected("country_detect", "string", [("Autohaus Berlin", "DE"), ("Madrid centro", "ES"), ("somewhere", "EU"), ("Suède", "SE"), ("Bruxelles, Belgique", "BE"), ("pt", "PT"), ("Czech Republic", "CZ"), ("Royaume-Uni", "GB"), ("", "EU")], T.country_of_text)
expected("spec_match", "long", [("2.0 TFSI,Italy,BE", 1), ("S-Line", 1), ("diesel", 0), ("quattro sport", 0), ("", 1)], lambda c: T.has_specs(F.lit("TT 2.0 TFSI quattro s line"), F.split(c, ",")).cast("long"))
expected("engine_fuel_compatible", "long", [("2.0 tdi", 1), ("1.0 tsi", 0), ("e-tron", 0), ("2.0", 0), ("2.0 BlueHDi 150", 1), ("1.5 dCi", 1), ("tdix", 0)], lambda c: T.engine_fits_fuel(c, ("Diesel",)).cast("long"))
expected("engine_petrol_compatible", "long", [("2.0 tdi", 0), ("1.0 tsi", 1), ("1.8 hybrid", 1), ("e-tron 50", 0), ("3.2 v6", 1), ("1.5 etsi", 1), ("hybrid diesel", 1)], lambda c: T.engine_fits_fuel(c, ("Gasolina",)).cast("long"))
expected("fuel_labels", "string", [("Diésel", "Diesel"), ("Plug-in", "Hybrid"), ("Mild hybrid petrol", "Hybrid"), ("eléctrica", "Electric"), ("LPG", "LPG"), ("2.0 diesel", None), ("", None), ("EV", "Electric")], X.list_label_fuel)
expected("portal_fuel_labels", "string", [("Diésel, gasóleo", "Diesel"), ("2.0 diesel", "Diesel"), ("Benzin", "Petrol"), ("Autogas", "LPG"), ("", None), ("?", None)], X.labelled_fuel)
expected("model_lookup_keys", "string", [("4 Series", "4 series,serie 4,series 4,4er,4 er"), ("Golf", "golf"), ("G-Wagon", "g wagon,clase g,g class,g klasse,class g,gwagen,g wagen")], lambda c: F.array_join(X.lookup_keys(c), ","))
expected("stored_tokens_first", "string", [("2.0 tdi", "2.0,tdi,2.0 tdi"), ("s line|2.0 TDI", "s line")], lambda c: F.array_join(X.resolved_tokens(F.when(c.contains("|"), F.array(F.substring_index(c, "|", 1))).otherwise(F.array().cast("array<string>")), c), ","))


@query("SELECT portal_id, price FROM (SELECT portal_id, CASE WHEN price BETWEEN 1 AND 9 OR price BETWEEN 10 AND 99 THEN price * 1000 ELSE price END AS price, mileage_km, year FROM listing WHERE portal_id NOT LIKE '%-7') WHERE price > 0 AND price <= 1e9 AND mileage_km > 0 AND year > 0", listings=True)
def ingest_validate(d: Data):
    raw = d.listing.withColumn("model", F.when(F.col("portal_id").endswith("-7"), " N/A ").otherwise(F.col("model")))
    return I.validated(raw).select("portal_id", "price")


@query("SELECT portal_id, brand_norm, model_norm, 2 + (length(version) <= 24)::INT AS n_tokens, version AS engine_norm, coalesce(power_hp, 0) AS power FROM listing", listings=True)
def ingest_derived_columns(d: Data):
    return I.with_norms(d.listing).select("portal_id", "brand_norm", "model_norm", F.size("version_tokens").alias("n_tokens"), "engine_norm", F.coalesce("power_hp", F.lit(0)).alias("power"))


@query("SELECT portal_id, CASE WHEN source_portal = 'src3' THEN 'brand_norm' ELSE '' END || CASE WHEN source_portal = 'src3' AND mileage_km > 40000 THEN ',' ELSE '' END || CASE WHEN mileage_km > 40000 THEN 'model_norm' ELSE '' END AS drifted FROM listing WHERE source_portal = 'src3' OR mileage_km > 40000", listings=True)
def norm_drift(d: Data):
    stored = d.listing.withColumn("brand_norm", F.when(F.col("source_portal") == "src3", "stale").otherwise(F.col("brand_norm"))).withColumn("model_norm", F.when(F.col("mileage_km") > 40_000, None).otherwise(F.col("model_norm")))
    return I.drift(stored, {"brand_norm": ("brand", X.normalize_brand), "model_norm": ("model", X.normalize_model)}).select("portal_id", "drifted")


@query("SELECT portal_id FROM listing WHERE power_hp IS NULL OR mileage_km % 5000 = 0", listings=True)
def enrichment_pending(d: Data):
    rows = d.listing.withColumn("engine_norm", F.when(F.col("mileage_km") % 5000 == 0, F.concat(F.lit("0 "), "version")).otherwise(F.col("version")))
    return rows.where(I.needs_enrichment()).select("portal_id")


@query("""SELECT portal_id, CASE WHEN source_portal = 'src0' THEN CASE WHEN fuel_type IS NULL THEN 'skip' ELSE 'clear' END WHEN mileage_km % 3000 = 0 THEN 'clear' WHEN fuel_type = 'Diesel' THEN 'keep' ELSE 'update' END AS action FROM listing""", listings=True)
def fuel_backfill_actions(d: Data):
    found = F.when(F.col("mileage_km") % 3000 != 0, "Diesel")
    return d.listing.select("portal_id", I.fuel_decision(F.col("fuel_type"), found, F.col("source_portal") != "src0", False).alias("action"))


@query("""SELECT DISTINCT p_brand AS brand, p_type AS model, CASE WHEN p_brand = 'Brand#1' AND p_type = 'PROMO' THEN 'a' WHEN p_type = 'PROMO' THEN 'm' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'b' ELSE 'g' END AS engines,
  CASE WHEN p_brand = 'Brand#1' AND p_type = 'PROMO' THEN 'curated' WHEN p_type = 'PROMO' THEN 'model' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'brand' ELSE 'generic' END AS level FROM part""")
def engine_catalog_generate(d: Data):
    models = d.table("part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("model")).distinct()
    curated = d.rows([("Brand#1", "PROMO", "a")], "brand string, model string, engines string")
    rules = models.where("model = 'PROMO'").withColumn("engines", F.lit("m"))
    return I.generated_catalog(models, curated, rules, d.rows([("Brand#1", "b"), ("Brand#2", "b")], "brand string, engines string"), "g")


@query("""SELECT count(*) AS n, floor(date_diff('second', max(updated_at), TIMESTAMP '1999-01-01') / 3600)::BIGINT AS age_hours,
  CASE WHEN floor(date_diff('second', max(updated_at), TIMESTAMP '1999-01-01') / 3600) <= 24 THEN 'ok' WHEN floor(date_diff('second', max(updated_at), TIMESTAMP '1999-01-01') / 3600) <= 72 THEN 'warn' ELSE 'fail' END AS freshness,
  CASE WHEN 100.0 * count(*) FILTER (power_hp IS NULL) / count(*) > 35 THEN 'warn' ELSE 'ok' END AS power, CASE WHEN 100.0 * count(*) FILTER (fuel_type IS NULL) / count(*) > 25 THEN 'warn' ELSE 'ok' END AS fuel, 'ok' AS stock FROM listing""", listings=True)
def system_self_check(d: Data):
    return I.self_check(d.listing, datetime(1999, 1, 1))


@query("SELECT brand_norm, (ceil(sum(price::DECIMAL(18,4))::DOUBLE / count(*) / 1000) * 1000)::BIGINT AS max_price, floor(avg(year) + 0.5)::INT AS min_year, (ceil(avg(mileage_km) / 5000) * 5000)::BIGINT AS max_km FROM listing GROUP BY ALL", listings=True)
def context_defaults(d: Data):
    limits = I.context_defaults(d.listing.groupBy("brand_norm").agg(*S.summary()))
    return limits.select("brand_norm", F.col("max_price_default").alias("max_price"), F.col("min_year_default").alias("min_year"), F.col("max_km_default").alias("max_km"))


@query("""WITH p AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN array_to_string(string_split(url, '/')[1:3], '/') ELSE url END AS url, array_to_string(string_split(url, '/')[1:3], '/') AS repaired FROM pages)
SELECT id FROM p c WHERE id % 4 <> 0 AND EXISTS (SELECT 1 FROM p WHERE p.url = c.repaired AND p.id <> c.id)""")
def url_repair_clash(d: Data):
    """Stored URLs, a quarter of them cut to scheme and host already; the others are to be cut as well."""
    cut = F.substring_index("url", "/", 3)
    pages = d.table("pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 4 == 0, cut).otherwise(F.col("url")).alias("url"))
    changes = d.table("pages").where("page_id % 4 <> 0").select(F.col("page_id").alias("id"), cut.alias("url"))
    return I.url_clash(changes, pages).select("id")


@query("SELECT id FROM alert WHERE user_id IN (SELECT user_id FROM sent) AND max_price > 30000", listings=True)
def eligible_users(d: Data):
    return d.alert.where("max_price > 30000").join(d.sent.select("user_id").distinct(), "user_id", "left_semi").select("id")


@query("SELECT listing_id, user_id FROM sent WHERE listing_id NOT IN (SELECT portal_id FROM listing WHERE fuel_type = 'Diesel')", listings=True)
def exclude_history(d: Data):
    diesel = d.listing.where("fuel_type = 'Diesel'").select(F.col("portal_id").alias("listing_id"))
    return d.sent.select("listing_id", "user_id").join(diesel, "listing_id", "left_anti")


@query("""SELECT portal_id, '{"brand":"' || brand || '","model":"' || model || '","year":' || year || ',"km":' || mileage_km || CASE WHEN fuel_type IS NOT NULL THEN ',"fuel":"' || fuel_type || '"' ELSE '' END || '}' AS facts FROM listing""", listings=True)
def listing_facts_json(d: Data):
    facts = F.struct("brand", "model", "year", F.col("mileage_km").alias("km"), F.col("fuel_type").alias("fuel"))
    return d.listing.select("portal_id", F.to_json(facts).alias("facts"))


@query("SELECT c_custkey, 'days ' || array_to_string(list_sort([(1 + c_custkey % 7)::INT, 3, 5]), '') || ', ' || lpad((8 + c_custkey % 3)::VARCHAR, 2, '0') || '-' || (19 + c_custkey % 4) || 'h, every ' || (1 + c_custkey % 4) || 'h' AS label FROM customer")
def schedule_labels(d: Data):
    k = F.col("c_custkey")
    days = F.array_sort(F.array((1 + k % 7).cast("int"), F.lit(3), F.lit(5)))
    return d.table("customer").select("c_custkey", F.concat(F.lit("days "), F.array_join(F.transform(days, lambda x: x.cast("string")), ""), F.lit(", "), F.lpad((8 + k % 3).cast("string"), 2, "0"), F.lit("-"), (19 + k % 4).cast("string"), F.lit("h, every "), (1 + k % 4).cast("string"), F.lit("h")).alias("label"))


@query("""SELECT c_custkey, '{"days":[' || array_to_string(list_sort(list_distinct([(1 + c_custkey % 6)::INT, 3])), ',') || '],"start":' || CASE WHEN c_custkey % 30 < 7 THEN 7 WHEN c_custkey % 30 > 12 THEN 12 ELSE c_custkey % 30 END
  || ',"end":' || 21 || ',"interval":' || CASE WHEN c_custkey % 10 IN (1, 2, 3, 4) THEN c_custkey % 10 ELSE 2 END || '}' AS fingerprint FROM customer""")
def schedule_fingerprint(d: Data):
    k = F.col("c_custkey")
    p = W.clamped_preferences(F.array((1 + k % 6).cast("int"), F.lit(3)), k % 30, F.lit(None).cast("long"), k % 10)
    return d.table("customer").select("c_custkey", p.alias("p")).select("c_custkey", W.preferences_fingerprint(F.col("p")).alias("fingerprint"))


@query("WITH r AS (SELECT o_custkey, max(o_orderdate) AS refreshed_at, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, n FROM r WHERE refreshed_at >= (SELECT max(refreshed_at) FROM r) - INTERVAL 90 DAY")
def rollup_stale_rows(d: Data):
    rollup = d.table("orders").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("refreshed_at"), F.count("*").alias("n"))
    last = rollup.agg(F.max("refreshed_at").alias("last"))  # one row
    return L.drop_stale(rollup.crossJoin(F.broadcast(last)), F.col("last") - F.expr("interval 90 days")).select("o_custkey", "n")


@query("SELECT c_custkey, greatest(0, least(c_custkey % 40 - 5, greatest(0, ceil((c_custkey % 500) / 18.0) - 1)))::BIGINT AS page FROM customer")
def page_clamp(d: Data):
    k = F.col("c_custkey")
    return d.table("customer").select("c_custkey", N.clamp_page(k % 40 - 5, k % 500, 18).alias("page"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || '+x' END AS stored FROM customer")
def array_promotion(d: Data):
    """Scalars become lists of one, '' the empty list, and lists that were scalars are joined to what is new."""
    k, seg = F.col("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("")
    stored = X.promoted(seg)
    return d.table("customer").select("c_custkey", F.array_join(F.when(k % 3 == 2, F.array_append(stored, F.lit("x"))).otherwise(stored), "+").alias("stored"))


@query("""SELECT DISTINCT p_brand AS brand, p_type || s AS model, CASE WHEN s = 'ish' OR (p_brand = 'Brand#1' AND p_type = 'PROMO') THEN NULL ELSE p_type END AS found FROM part, (VALUES (''), (' Sport Line'), ('ish'), ('-x')) v(s)""")
def catalog_model_lookup(d: Data):
    models = d.table("part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("model")).distinct()
    names = models.crossJoin(F.broadcast(d.rows([("",), (" Sport Line",), ("ish",), ("-x",)], "s string"))).select("brand", F.concat("model", "s").alias("model"))
    return C.catalog_models(names, models.where("not (brand = 'Brand#1' and model = 'PROMO')"))
