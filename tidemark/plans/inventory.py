"""Queries: rollups, facets, scoped contexts, option lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import numeric as N
from ..functions import text as X
from ..operators import stats as S
from ..operators.predicate import Scope, effective_power, soft_fuel
from .registry import Data, query

_ROLLUP = """count(*) AS n, min(price) AS min_price, max(price) AS max_price, sum(price::DECIMAL(18,4))::DOUBLE / count(price) AS avg_price,
  min(year) AS min_year, max(year) AS max_year, avg(year) AS avg_year, min(mileage_km) AS min_km, max(mileage_km) AS max_km,
  avg(mileage_km) AS avg_km, coalesce(min(CASE WHEN power_hp > 0 THEN power_hp END), 0) AS min_power,
  coalesce(max(CASE WHEN power_hp > 0 THEN power_hp END), 0) AS max_power,
  coalesce(avg(CASE WHEN power_hp > 0 THEN power_hp END), 0) AS avg_power"""
_FUELS = "coalesce(string_agg(DISTINCT fuel_type, ',' ORDER BY fuel_type), '') AS fuels"
_ENGINES = "string_agg(DISTINCT version, ',' ORDER BY version) AS engines"
#: Versions here are two plain lower-case words: tokens are the words and the pair.
_TOKENS = """tok AS (SELECT l.*, unnest(list_distinct(list_filter(string_split(version, ' '), lambda w: length(w) >= 2)
                      || CASE WHEN contains(version, ' ') AND length(version) <= 24 THEN [version] ELSE [] END)) AS token FROM listing l)"""
_USABLE = "regexp_matches(model_norm, '[a-zA-Z0-9]')"


@query("SELECT portal_id, source_portal, brand_norm, model_norm, version, year, mileage_km, price, fuel_type, power_hp, country FROM listing", listings=True)
def listing_projection(d: Data):
    return d.listing.select("portal_id", "source_portal", "brand_norm", "model_norm", "version", "year", "mileage_km", "price", "fuel_type", "power_hp", "country")


@query(f"SELECT brand_norm, model_norm, {_ROLLUP}, {_FUELS}, {_ENGINES} FROM listing WHERE {_USABLE} GROUP BY ALL", listings=True)
def inventory_stats_base(d: Data):
    return S.base_rollup(d.listing)


@query(f"{_TOKENS} SELECT brand_norm, model_norm, token, {_ROLLUP}, {_FUELS}, {_ENGINES} FROM tok WHERE {_USABLE} GROUP BY ALL HAVING count(*) >= 3", listings=True)
def inventory_stats_tokens(d: Data):
    return S.token_rollup(d.listing)


@query(f"""{_TOKENS} SELECT brand_norm, model_norm, token, {_ROLLUP}, {_FUELS}, {_ENGINES} FROM tok WHERE {_USABLE} GROUP BY ALL HAVING count(*) >= 3
  UNION ALL SELECT brand_norm, model_norm, '' AS token, {_ROLLUP}, {_FUELS}, {_ENGINES} FROM listing WHERE {_USABLE} GROUP BY ALL""", listings=True)
def inventory_stats_all(d: Data):
    return S.full_rollup(d.listing)


@query("SELECT brand_norm, sum(1)::BIGINT AS n FROM listing GROUP BY ALL HAVING count(*) >= 10", listings=True)
def brand_counts(d: Data):
    return S.group_counts(d.listing, F.col("brand_norm"), "brand_norm").where("n >= 10")


@query("SELECT brand_norm, model_norm, count(*) AS n FROM listing GROUP BY ALL HAVING count(*) >= 3", listings=True)
def model_counts(d: Data):
    return d.listing.where(X.usable_model(F.col("model_norm"))).groupBy("brand_norm", X.normalize_model(F.col("model_norm")).alias("model_norm")).agg(F.count("*").alias("n")).where("n >= 3")


@query("""m AS (SELECT source_portal, model, count(*) AS c FROM listing GROUP BY ALL)
SELECT lower(model) AS model_key, sum(c)::BIGINT AS n, max(struct_pack(c := c, l := source_portal || ':' || model)).l AS label FROM m GROUP BY ALL""", listings=True)
def model_option_merge(d: Data):
    counts = d.listing.groupBy("source_portal", "model").agg(F.count("*").alias("c"))
    named = counts.select(F.lower("model").alias("model_key"), F.concat("source_portal", F.lit(":"), "model").alias("name"), "c")
    return S.merged_options(named, "model_key", "name", "c")


@query("SELECT upper(trim(country)) AS country, count(*) AS n FROM listing GROUP BY ALL", listings=True)
def country_facets(d: Data):
    return S.group_counts(d.listing, F.upper(F.trim("country")), "country")


@query("SELECT fuel_type, count(*) AS n FROM listing WHERE fuel_type IS NOT NULL GROUP BY ALL", listings=True)
def fuel_facets(d: Data):
    return S.group_counts(d.listing, S.known_fuel(F.col("fuel_type")), "fuel_type")


@query("SELECT version AS engine, count(*) AS n FROM listing GROUP BY ALL", listings=True)
def engine_facets(d: Data):
    return S.group_counts(d.listing, X.engine_key(F.col("version")), "engine")


@query("""s AS (SELECT brand_norm, model_norm, count(*) AS n, list(DISTINCT fuel_type) FILTER (fuel_type IS NOT NULL) AS f FROM listing GROUP BY ALL)
SELECT fuel, sum(n)::BIGINT AS n FROM (SELECT unnest(f) AS fuel, n FROM s) GROUP BY ALL""", listings=True)
def fuel_slice_counts(d: Data):
    slices = d.listing.groupBy("brand_norm", "model_norm").agg(F.count("*").alias("n"), F.collect_set("fuel_type").alias("f"))
    return slices.select(F.explode("f").alias("fuel"), "n").groupBy("fuel").agg(F.sum("n").alias("n"))


@query(f"{_TOKENS} SELECT token, count(*) AS n FROM tok GROUP BY ALL ORDER BY n DESC, token LIMIT 80", listings=True)
def version_top80(d: Data):
    return S.top_tokens(d.listing, 80)


SCOPE = Scope(brand="brand#12", fuels=("Diesel", "Hybrid"), max_price=60_000.0, min_year=1993, max_km=40_000, min_power=60)
_SCOPE = """brand_norm = 'brand#12' AND price <= 60000 AND year >= 1993 AND mileage_km <= 40000 AND fuel_type = 'Diesel' AND power_hp >= 60"""


@query(f"SELECT {_ROLLUP} FROM listing WHERE brand_norm = 'brand#12' AND price <= 60000 AND year >= 1993", listings=True)
def scoped_context(d: Data):
    return d.listing.where(Scope(brand="brand#12", max_price=60_000.0, min_year=1993).matches()).agg(*S.summary())


@query(f"SELECT {_ROLLUP}, {_FUELS} FROM listing WHERE {_SCOPE}", listings=True)
def scoped_context_soft_fill(d: Data):
    return d.listing.where(SCOPE.matches()).withColumn("fuel_type", soft_fuel(F.col("fuel_type"), F.col("version"))).withColumn("power_hp", effective_power(F.col("power_hp"), F.col("version"))).agg(*S.summary(), S.csv_set(F.col("fuel_type")).alias("fuels"))


@query("SELECT country, count(*) AS n FROM listing WHERE brand_norm = 'brand#12' AND price <= 60000 AND year >= 1993 AND mileage_km <= 40000 AND fuel_type = 'Diesel' AND power_hp >= 60 GROUP BY ALL", listings=True)
def facet_omit_dimension(d: Data):
    scope = Scope(**{**SCOPE.__dict__, "countries": ("FRANCE",)}).without("countries")
    return S.group_counts(d.listing.where(scope.matches()), F.col("country"), "country")


@query("SELECT count(*) AS n FROM listing WHERE brand_norm = 'brand#12' AND fuel_type = 'Petrol' AND power_hp >= 60", listings=True)
def facet_cascade_reset(d: Data):
    return d.listing.where(SCOPE.after("fuels", ("Petrol",)).matches()).agg(F.count("*").alias("n"))


@query("""SELECT unnest(['brand', 'model', 'min_power', 'fuels', 'max_price', 'min_year', 'max_km']) AS facet, unnest([count(*) FILTER (brand_norm = 'brand#13'), count(*) FILTER (brand_norm = 'brand#12' AND model_norm = 'promo'),
  count(*) FILTER (brand_norm = 'brand#12' AND power_hp >= 80), count(*) FILTER (b AND fuel_type = 'Petrol' AND price <= 60000 AND year >= 1993 AND mileage_km <= 40000), count(*) FILTER (b AND f AND price <= 50000),
  count(*) FILTER (b AND f AND price <= 60000 AND year >= 1995), count(*) FILTER (b AND f AND price <= 60000 AND year >= 1993 AND mileage_km <= 30000)]) AS n FROM (SELECT *, brand_norm = 'brand#12' AND power_hp >= 60 AS b, fuel_type = 'Diesel' AS f FROM listing)""", listings=True)
def facet_cascade_each(d: Data):
    """What is left after each facet of a filter is changed, in one pass."""
    changes = {"brand": "brand#13", "model": "PROMO", "min_power": 80, "fuels": ("Petrol",), "max_price": 50_000.0, "min_year": 1995, "max_km": 30_000}
    counts = d.listing.agg(*[F.count_if(SCOPE.changed(k, v).matches()).alias(k) for k, v in changes.items()])
    return counts.unpivot([], list(changes), "facet", "n")


@query("""SELECT upper(trim(c)) AS country, count(*) AS n FROM (SELECT CASE WHEN s_nationkey % 5 = 0 THEN n_name WHEN s_nationkey % 5 = 1 THEN ' n' || chr((97 + s_nationkey)::INT) || ' ' ELSE 'N' || chr((65 + s_nationkey)::INT) END AS c
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE regexp_matches(upper(trim(c)), '^[A-Z]{2}$') GROUP BY ALL""")
def country_facets_iso(d: Data):
    """Suppliers by country codes in different spellings; a fifth has a name instead, which is no code."""
    k = F.col("s_nationkey")
    code = F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 1, F.concat(F.lit(" n"), F.char(97 + k), F.lit(" "))).otherwise(F.concat(F.lit("N"), F.char(65 + k)))
    rows = d.table("supplier").join(F.broadcast(d.table("nation")), k == F.col("n_nationkey"))  # 25 rows at any scale
    return S.group_counts(rows.where(X.iso_country(code).isNotNull()), X.iso_country(code), "country")


_PARTS = f"p AS (SELECT brand_norm, model_norm, {_ROLLUP}, {_FUELS}, {_ENGINES} FROM listing GROUP BY ALL)"


@query(f"""SELECT brand_norm, {_ROLLUP.replace(", coalesce(min(CASE WHEN power_hp > 0 THEN power_hp END), 0) AS min_power", "").replace("coalesce(max(CASE WHEN power_hp > 0 THEN power_hp END), 0) AS max_power,", "")} FROM listing GROUP BY ALL""", listings=True)
def brand_summary(d: Data):
    return d.listing.groupBy("brand_norm").agg(*[c for c, n in zip(S.summary(), range(13), strict=True) if n not in (10, 11)])


@query(f"""{_PARTS} SELECT brand_norm, sum(n)::BIGINT AS n, min(min_price) AS min_price, max(max_price) AS max_price, sum((avg_price * n)::DECIMAL(18,4))::DOUBLE / sum(n) AS avg_price,
  min(min_year) AS min_year, max(max_year) AS max_year, sum((avg_year * n)::DECIMAL(18,4))::DOUBLE / sum(n) AS avg_year, min(min_km) AS min_km, max(max_km) AS max_km,
  sum((avg_km * n)::DECIMAL(18,4))::DOUBLE / sum(n) AS avg_km, coalesce(sum(CASE WHEN avg_power > 0 THEN (avg_power * n)::DECIMAL(18,4) END)::DOUBLE / sum(CASE WHEN avg_power > 0 THEN n END), 0) AS avg_power, coalesce(min(CASE WHEN min_power > 0 THEN min_power END), 0) AS min_power, max(max_power) AS max_power,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(fuels, ','))), lambda f: f <> ''))), ',') AS fuels, array_to_string(list_sort(list_distinct(flatten(list(string_split(engines, ','))))), ',') AS engines
FROM p GROUP BY ALL""", listings=True)
def weighted_stats_merge(d: Data):
    return S.merge_rollups(S.base_rollup(d.listing), "brand_norm")


def _limits(d: Data):
    return d.listing.groupBy("brand_norm").agg(*S.summary())


_LIMITS = f"m AS (SELECT brand_norm, {_ROLLUP} FROM listing GROUP BY ALL)"


def _csv(options: str) -> str:
    return f"array_to_string(list_sort(list_distinct({options})), ',')"


def _joined(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query(f"""{_LIMITS} SELECT brand_norm, {_csv("list_filter(list_transform([min_price, avg_price * 0.85, avg_price, avg_price * 1.15, max_price], lambda v: (ceil(v / 1000) * 1000)::BIGINT), lambda v: v > 0)")} AS options FROM m""", listings=True)
def price_facet_options(d: Data):
    return _limits(d).select("brand_norm", _joined(N.price_options(F.col("min_price"), F.col("avg_price"), F.col("max_price"))).alias("options"))


@query(f"""{_LIMITS}, y AS (SELECT brand_norm, greatest(min_year, 1970)::BIGINT AS lo, greatest(greatest(min_year, 1970), max_year)::BIGINT AS hi, greatest(min_year, floor(avg_year + 0.5))::BIGINT AS mid FROM m)
SELECT brand_norm, {_csv("list_filter([lo, mid - 2, mid, mid + 1, hi - 1, hi], lambda v: v >= lo AND v <= hi AND v >= 1970)")} AS options FROM y""", listings=True)
def year_facet_options(d: Data):
    return _limits(d).select("brand_norm", _joined(N.year_options(F.col("min_year"), F.col("avg_year"), F.col("max_year"), 2026)).alias("options"))


@query(f"""{_LIMITS} SELECT brand_norm, {_csv("list_filter([(ceil(min_km / 5000.0) * 5000)::BIGINT, (ceil(avg_km * 0.85 / 5000) * 5000)::BIGINT, (ceil(avg_km / 5000) * 5000)::BIGINT, (ceil(avg_km * 1.15 / 5000) * 5000)::BIGINT, least((ceil(max_km / 5000.0) * 5000)::BIGINT, 300000)], lambda v: v > 0 AND v <= 300000)")} AS options FROM m""", listings=True)
def km_facet_options(d: Data):
    return _limits(d).select("brand_norm", _joined(N.mileage_options(F.col("min_km"), F.col("avg_km"), F.col("max_km"))).alias("options"))


@query(f"""{_LIMITS}, t AS (SELECT brand_norm, max_power, (floor(CASE WHEN min_power > 0 THEN min_power ELSE max_power END / 10.0) * 10)::BIGINT AS lo, (floor(avg_power / 10) * 10)::BIGINT AS mid, (floor(max_power / 10.0) * 10)::BIGINT AS hi FROM m)
SELECT brand_norm, {_csv("list_filter([lo, lo - 20, mid, mid - 20, hi, hi - 20, greatest(50, lo - 10)], lambda v: v >= 40 AND v <= 800 AND v <= max_power)")} AS options FROM t""", listings=True)
def power_facet_options(d: Data):
    return _limits(d).select("brand_norm", _joined(N.power_options(F.col("min_power"), F.col("avg_power"), F.col("max_power"))).alias("options"))


@query("""SELECT l_partkey, CASE WHEN v < 100 THEN v::VARCHAR WHEN v < 1000 THEN '~' || (floor(v / 10.0 + 0.5) * 10)::BIGINT WHEN v < 10000 THEN '~' || (floor(v / 100.0 + 0.5) * 100)::BIGINT
  WHEN v < 100000 THEN '~' || floor(v / 1000.0 + 0.5)::BIGINT || 'k' ELSE '~' || (floor(v / 10000.0 + 0.5) * 10)::BIGINT || 'k' END AS label
FROM (SELECT l_partkey, greatest(0, floor(sum(l_extendedprice) / 37 + 0.5))::BIGINT AS v FROM lineitem GROUP BY ALL)""")
def approx_count_labels(d: Data):
    return d.table("lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s")).select("l_partkey", N.approx_count(F.floor(F.col("s") / 37 + 0.5)).alias("label"))


@query("""c AS (SELECT brand_norm, model_norm, count(*) AS n FROM listing GROUP BY ALL)
SELECT brand_norm, model_norm, n, (row_number() OVER (PARTITION BY brand_norm ORDER BY lower(model_norm), model_norm) - 1) // 18 AS page FROM c""", listings=True)
def pagination(d: Data):
    counts = d.listing.groupBy("brand_norm", "model_norm").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("brand_norm").orderBy(F.lower("model_norm"), "model_norm"))
    return counts.withColumn("page", F.floor((rn - 1) / 18))


@query("SELECT brand, row_number() OVER (ORDER BY regexp_replace(brand, '[0-9]+', ''), lpad(regexp_extract(brand, '[0-9]+'), 12, '0'), brand) AS place FROM (SELECT DISTINCT p_brand AS brand FROM part)")
def natural_sort(d: Data):
    brands = d.table("part").select(F.col("p_brand").alias("brand")).distinct()
    key = [F.regexp_replace("brand", "[0-9]+", ""), F.lpad(F.regexp_extract("brand", "[0-9]+", 0), 12, "0"), F.col("brand")]
    return brands.withColumn("place", F.row_number().over(Window.orderBy(*key)).cast("long"))


@query("SELECT count(*) AS n, count(*) FILTER (power_hp IS NULL) AS n_missing, 100.0 * count(*) FILTER (power_hp IS NULL) / count(*) AS missing_pct, CASE WHEN 100.0 * count(*) FILTER (power_hp IS NULL) / count(*) > 25 THEN 'warn' ELSE 'ok' END AS state FROM listing", listings=True)
def coverage_report(d: Data):
    return S.coverage(d.listing, F.col("power_hp"), 25.0)


@query("SELECT source_portal, max(updated_at)::VARCHAR AS newest, floor(date_diff('second', max(updated_at), TIMESTAMP '2001-01-01') / 3600)::BIGINT AS age_hours FROM listing GROUP BY ALL", listings=True)
def freshness_report(d: Data):
    newest = F.max("updated_at")
    return d.listing.groupBy("source_portal").agg(F.date_format(newest, "yyyy-MM-dd HH:mm:ss").alias("newest"), F.floor((F.unix_seconds(F.lit("2001-01-01").cast("timestamp")) - F.unix_seconds(newest)) / 3600).alias("age_hours"))


@query("""SELECT brand_norm, model_norm, string_agg(DISTINCT upper(country), ',' ORDER BY upper(country)) AS available,
  array_to_string(list_filter(['NATION_3', 'NATION_7', 'ATLANTIS'], lambda c: list_contains(list(DISTINCT upper(country)), c)), ',') AS kept FROM listing GROUP BY ALL""", listings=True)
def facet_prune_selected(d: Data):
    have = F.sort_array(F.collect_set(F.upper("country")))
    wanted = F.array(*map(F.lit, ("NATION_3", "NATION_7", "ATLANTIS")))
    return d.listing.groupBy("brand_norm", "model_norm").agg(F.array_join(have, ",").alias("available"), F.array_join(F.array_intersect(wanted, have), ",").alias("kept"))


@query("""a AS (SELECT DISTINCT brand || ' ' || model || ' ' || version AS model FROM listing WHERE source_portal = 'src0'), b AS (SELECT DISTINCT brand || ' ' || model || ' ' || version AS model FROM listing WHERE source_portal = 'src1')
SELECT model, 'only_a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT model, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", listings=True)
def catalog_parity(d: Data):
    a, b = (d.listing.where(F.col("source_portal") == s).select(F.concat_ws(" ", "brand", "model", "version").alias("model")).distinct() for s in ("src0", "src1"))
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


@query("SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) = list_sort(list_distinct(list_reverse(string_split(p_name, ' ')))) AS same FROM part")
def token_set_equality(d: Data):
    words = F.split("p_name", " ")
    return d.table("part").select("p_partkey", (F.array_sort(F.array_distinct(words)) == F.array_sort(F.array_distinct(F.reverse(words)))).alias("same"))
