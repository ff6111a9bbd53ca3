"""Queries: merges into a snapshot, what makes users and alerts what they are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import ingest as I
from ..operators import matching as M
from ..operators import merge as G
from ..sources.shared import cut
from .registry import Data, query


@query()
def guarded_merge(d: Data):
    """A crawl of two sources merged into a stock of the other two and a third of its own adverts, which are dearer by now."""
    url = F.concat_ws("/", F.lit("https://shop.example"), F.substring_index("portal_id", "-", 2))
    rows = d.listing.withColumn("url", url)
    ours = F.col("source_portal").isin("src0", "src1")
    stock = rows.where(ours | (F.col("mileage_km") % 3000 == 0)).withColumn("url", F.concat("url", F.lit("-"), "source_portal"))
    # URLs of a stock are unique: of adverts that share one the first keeps it
    stock = stock.withColumn("_first", F.min("portal_id").over(Window.partitionBy("url"))).withColumn("url", F.when(F.col("_first") == F.col("portal_id"), F.col("url")).otherwise(F.concat("url", F.lit("?"), "portal_id"))).drop("_first")
    crawl = rows.where(~ours).withColumn("price", F.round(F.col("price") * 1.01, 2)).drop("url_verified_at").withColumn("seq", F.unix_seconds("updated_at"))
    return G.guarded_merge(stock, crawl, "seq").actions


_PAGES = """x AS (SELECT *, CASE WHEN source_portal = 'src2' AND year % 2 = 0 THEN 'https://dealer.example/' || model_norm || '/' || year || '/' || mileage_km WHEN source_portal = 'src3' THEN 'https://list.example/' || portal_id ELSE 'https://shop.example/' || portal_id END AS url,
  CASE WHEN source_portal = 'src3' THEN 'https://dealer.example/' || model_norm || '/' || year || '/' || mileage_km END AS seller FROM listing),
p AS (SELECT *, CASE WHEN mileage_km % 5000 = 0 THEN 'dead' WHEN year % 3 = 0 THEN 'soft' WHEN mileage_km % 7000 = 0 THEN 'dead' ELSE 'ok' END AS verdict FROM x WHERE url_verified_at IS NULL),
r AS (SELECT portal_id, seller FROM p WHERE verdict <> 'ok' AND seller IS NOT NULL AND mileage_km % 2000 <> 0),
f AS (SELECT min(portal_id) AS portal_id FROM r WHERE seller NOT IN (SELECT url FROM x) GROUP BY seller)"""


def _probed(d: Data):
    """Adverts with URLs, and what fetches of the pages of those that wait said; those of one source only refer to a dealer's page,
    which in even years may be another advert's already."""
    dealer = F.concat_ws("/", F.lit("https://dealer.example"), "model_norm", "year", "mileage_km")
    source, k = F.col("source_portal"), F.col("mileage_km")
    host = F.when(source == "src3", "https://list.example/").otherwise("https://shop.example/")
    # no more of an advert than is asked for, worked out once for both sides
    rows = cut(d.listing.select("portal_id", "source_portal", "model_norm", "year", "mileage_km", "url_verified_at"))
    rows = rows.withColumn("url", F.when((source == "src2") & (F.col("year") % 2 == 0), dealer).otherwise(F.concat(host, "portal_id")))
    code = F.when(k % 5000 == 0, 404).when(F.col("year") % 3 == 0, 503).otherwise(200)
    gone, there = (F.rpad(F.lit(x), 300, ".") for x in ("This advert is no longer available.", "A car."))
    html = F.when(k % 7000 == 0, gone).otherwise(there)
    probes = rows.where("url_verified_at is null").select("portal_id", U.probe_class(code, html, ("no longer available",)).alias("verdict"), F.when(source == "src3", dealer).alias("seller_url"), F.when(k % 2000 != 0, "ok").otherwise("soft").alias("seller_verdict"))
    return rows.select("portal_id", "url", "url_verified_at"), probes


@query(f"""{_PAGES} SELECT portal_id, CASE WHEN verdict = 'ok' THEN 'verified' WHEN portal_id IN (SELECT portal_id FROM f) THEN 'repaired' WHEN portal_id IN (SELECT portal_id FROM r) THEN 'deleted'
  WHEN verdict = 'dead' THEN 'deleted' ELSE 'soft' END AS action FROM p""", listings=True)
def url_verification(d: Data):
    return G.verification(*_probed(d), datetime(2000, 1, 1)).actions


@query(f"""{_PAGES} SELECT portal_id, CASE WHEN portal_id IN (SELECT portal_id FROM f) THEN coalesce(seller, '') ELSE url END AS url, url_verified_at IS NOT NULL OR portal_id IN (SELECT portal_id FROM f) OR portal_id IN (SELECT portal_id FROM p WHERE verdict = 'ok') AS verified,
  portal_id IN (SELECT portal_id FROM p WHERE verdict = 'soft') AND portal_id NOT IN (SELECT portal_id FROM r) AS soft FROM x
  WHERE portal_id IN (SELECT portal_id FROM f) OR (portal_id NOT IN (SELECT portal_id FROM r) AND portal_id NOT IN (SELECT portal_id FROM p WHERE verdict = 'dead'))""", listings=True)
def url_verification_snapshot(d: Data):
    after = G.verification(*_probed(d), datetime(2000, 1, 1)).snapshot
    return after.select("portal_id", "url", F.col("url_verified_at").isNotNull().alias("verified"), F.col("soft_at").isNotNull().alias("soft"))


@query("""SELECT portal_id, CASE WHEN source_portal = 'src0' OR mileage_km % 3000 = 0 THEN NULL ELSE 'Diesel' END AS fuel_type FROM listing""", listings=True)
def fuel_backfill_applied(d: Data):
    """Fuels after a backfill: kept, set or cleared by what the pages said."""
    found = F.when(F.col("mileage_km") % 3000 != 0, "Diesel")
    action = I.fuel_decision(F.col("fuel_type"), found, F.col("source_portal") != "src0", False)
    rows = d.listing.withColumn("action", action)
    rows = G.updated_where(rows, F.col("action") == "update", {"fuel_type": found})
    return G.updated_where(rows, F.col("action") == "clear", {"fuel_type": F.lit(None).cast("string")}).select("portal_id", "fuel_type")


@query("SELECT url, portal_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY updated_at DESC, portal_id DESC) AS r FROM (SELECT portal_id, updated_at, 'https://s.example/' || brand_norm || '/' || year || '/' || mileage_km AS url FROM listing)) WHERE r = 1", listings=True)
def dedup_url_newest(d: Data):
    """Of adverts with one URL the newest stays, then the one with the larger id."""
    rows = d.listing.select("portal_id", "updated_at", F.concat_ws("/", F.lit("https://s.example"), "brand_norm", "year", "mileage_km").alias("url"))
    return rows.groupBy("url").agg(F.max_by("portal_id", F.struct("updated_at", "portal_id")).alias("portal_id"))


@query("""u AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'vip' WHEN 1 THEN 'cancelling' WHEN 2 THEN 'free' END AS status, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal < 0 END AS paused FROM customer)
SELECT user_id FROM u WHERE status IN ('vip', 'cancelling') AND coalesce(NOT paused, true) AND user_id IN (SELECT user_id FROM alert)""", listings=True)
def digest_users(d: Data):
    k = F.col("c_custkey")
    users = d.table("customer").select(k.alias("user_id"), F.when(k % 4 == 0, "vip").when(k % 4 == 1, "cancelling").when(k % 4 == 2, "free").alias("status"), F.when(k % 5 > 0, F.col("c_acctbal") < 0).alias("paused"))
    return M.eligible(users, d.alert).select("user_id")


_ITEMS = "array_to_string(list_transform(list_sort(list_filter(string_split(lower({}), ','), lambda x: x <> '')), lambda x: '\"' || x || '\"'), ',')"


@query(f"""SELECT id, sha256('{{"brand_norm":' || coalesce('"' || brand_norm || '"', 'null') || ',"model_norm":' || coalesce('"' || model_norm || '"', 'null') || ',"max_price":' || max_price::VARCHAR || ',"min_year":' || min_year || ',"max_km":' || coalesce(max_km::VARCHAR, 'null')
  || ',"min_power_hp":' || coalesce(min_power_hp::VARCHAR, 'null') || ',"fuels":[' || {_ITEMS.format("fuel_csv")} || '],"countries":[' || {_ITEMS.format("country_csv")} || '],"engines":[' || {_ITEMS.format("engine_csv")} || '],"trims":[' || {_ITEMS.format("trim_csv")} || ']}}') AS digest FROM alert""", listings=True)
def alert_digest(d: Data):
    """Digests of alerts whose lists are written in another order and case than the stored ones."""
    lists = {"fuels": "fuel_csv", "countries": "country_csv", "engines": "engine_csv", "trims": "trim_csv"}
    asked = d.alert.withColumns({c: F.array_join(F.reverse(F.split(F.upper(c), ",")), " ,") for c in lists.values()})
    return asked.select("id", M.alert_digest(asked, lists).alias("digest"))


@query("""SELECT id, concat_ws(' · ', 'Brand: ' || brand_norm, 'Model: ' || model_norm, 'Specs: ' || nullif(trim_csv, ''), 'Motor: ' || nullif(engine_csv, ''), 'Power: ≥' || min_power_hp || ' CV', 'Fuel: ' || nullif(fuel_csv, ''), 'Price: ≤' || max_price::BIGINT || '€',
  'Year: ≥' || min_year, 'Km: ≤' || max_km, 'Country: ' || nullif(country_csv, '')) AS hint FROM alert""", listings=True)
def scope_hints(d: Data):
    named = {"brand_norm": "brand", "model_norm": "model", "trim_csv": "trims", "engine_csv": "engines", "fuel_csv": "fuels", "country_csv": "countries"}
    return d.alert.withColumnsRenamed(named).withColumn("max_price", F.col("max_price").cast("long")).select("id", M.scope_hint().alias("hint"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*[^/?#]|^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*\\?[^#]') END AS live FROM pages""")
def live_after_redirect(d: Data):
    """Fetched pages: at an aggregator, at a home page, at a home page with a query, at a portal's home page, or not redirected."""
    k = F.col("page_id")
    final = F.when(k % 5 == 0, "https://go.list.example/").when(k % 5 == 1, "https://shop.example//").when(k % 5 == 2, "https://shop.example/?id=7").when(k % 5 == 3, "https://www.portal.example/?from=x")
    return d.table("pages").select("page_id", U.still_advert(F.col("url"), final, ("list.example",), ("portal.example",)).alias("live"))


@query("SELECT portal_id, CASE l WHEN 0 THEN 'Germany, Spain' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'Any' ELSE 'XX, Unknown' END AS countries FROM (SELECT portal_id, (mileage_km / 1000)::BIGINT % 4 AS l FROM listing)", listings=True)
def country_labels(d: Data):
    l = (F.col("mileage_km") / 1000).cast("long") % 4
    codes = F.when(l == 0, F.array(F.lit(" de"), F.lit("ES"))).when(l == 1, F.array(F.lit("uk"))).when(l == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("xx"), F.lit(" ")))
    return d.listing.select("portal_id", X.country_list(codes).alias("countries"))


@query("""SELECT portal_id, CASE WHEN mileage_km % 2000 = 0 THEN fuel_type WHEN fuel_type = 'Diesel' THEN 'Diesel' END AS fuel_type, CASE WHEN year % 3 = 0 THEN 'Automatic' WHEN year % 3 = 1 THEN 'Manual' END AS transmission,
  'https://shop.example/' || portal_id AS url, power_hp FROM listing WHERE country LIKE '%1' AND price > 0 AND mileage_km > 0""", listings=True)
def ingest_cleaned(d: Data):
    """Raw adverts of some countries with fuels, gearboxes and URLs as portals write them."""
    k, fuel = F.col("mileage_km"), F.col("fuel_type")
    raw = d.listing.withColumns(
        {
            "fuel_type": F.when(k % 2000 == 0, F.when(fuel == "Diesel", "Gasóleo (diésel)").when(fuel == "Petrol", "BENZIN")).when(fuel == "Diesel", "2.0 TDI").otherwise("?"),
            "transmission": F.when(F.col("year") % 3 == 0, "S-Tronic 7").when(F.col("year") % 3 == 1, "Schaltgetriebe").otherwise("n/a"),
            "url": F.concat(F.lit(" HTTPS://Shop.Example/"), "portal_id", F.lit("/?fbclid=1#photos")),
            "power_hp": F.coalesce("power_hp", F.lit(0)),
            "country": F.when(F.col("country").endswith("1"), " uk ").otherwise(F.lit("US")),
        }
    )
    return I.validated(raw, ("GB", "DE")).select("portal_id", "fuel_type", "transmission", "url", "power_hp")
