"""Queries: JSON catalogs, key-value rows, JSON in answers, files, resumed crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records as R
from .registry import Data, query


def catalog_texts(d: Data):
    """A JSON text of engines for each brand of the parts; every fifth brand's is cut short."""
    size = F.concat((1 + F.col("p_size") % 3).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    engine = F.struct(size.alias("engine"), F.array(size).alias("aliases"), (60 + 20 * (F.col("p_size") % 10)).cast("int").alias("powerCv"))
    models = d.table("part").select("p_brand", "p_type", engine.alias("e")).distinct().groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list("e")).alias("e"))
    brands = models.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "e"))).alias("m"))
    text = F.to_json(F.create_map("p_brand", "m"))
    return brands.select("p_brand", F.when(F.substring_index("p_brand", "#", -1).cast("int") % 5 == 0, F.substr(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("text"))


@query("""SELECT brand, model, (row_number() OVER (PARTITION BY brand, model ORDER BY engine) - 1)::INT AS ordinal, engine, power FROM
(SELECT DISTINCT p_brand AS brand, p_type AS model, (1 + p_size % 3) || '.' || (p_size % 10) AS engine, (60 + 20 * (p_size % 10))::INT AS power FROM part WHERE split_part(p_brand, '#', 2)::INT % 5 <> 0)""")
def json_catalog(d: Data):
    return R.catalog_of(catalog_texts(d), "text").drop("aliases")


@query("SELECT p_brand, split_part(p_brand, '#', 2)::INT % 5 = 0 AS broken FROM part GROUP BY ALL")
def json_broken(d: Data):
    return catalog_texts(d).select("p_brand", R.broken("text").alias("broken"))


@query("""SELECT user_id || ':' || event_type AS key, arg_max(json_extract_string(props, '$.k')::BIGINT, struct_pack(ts, event_id)) AS k FROM events WHERE event_id % 4 <> 0 GROUP BY ALL""")
def key_value_latest(d: Data):
    """Every fourth version is no JSON, so the one before it counts."""
    rows = d.table("events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("value"), "ts", "event_id")
    return R.latest_values(rows, "k long", "ts", "event_id").select("key", F.col("value.k").alias("k"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Hybrid' END AS fuel, CASE o_orderkey % 4 WHEN 0 THEN 'Manual' WHEN 1 THEN 'Automatic' END AS transmission,
CASE WHEN o_orderkey % 4 IN (0, 1) THEN floor(o_totalprice / 1000 + 0.5)::BIGINT END AS power FROM orders""")
def json_answers(d: Data):
    """Answers that wrap their JSON in words, give numbers as texts, break off, or have none."""
    kind, power = F.col("o_orderkey") % 4, (F.col("o_totalprice") / 1000).cast("string")
    said = F.when(kind == 0, F.concat(F.lit('Sure! ```json\n{"transmission": "manual", "fuelType": "gasoil",\n "powerHp": '), power, F.lit("}\n``` done")))
    said = said.when(kind == 1, F.concat(F.lit('{"fuelType": "Hybrid", "transmission": "automatic", "extra": {"a": 1}, "powerHp": '), power, F.lit("}")))
    said = said.when(kind == 2, F.lit('{"fuelType": "what", "powerHp": "150"}')).otherwise(F.lit("I don't know {"))
    answer = d.table("orders").select("o_orderkey", R.answered(said).alias("a"))
    return answer.select("o_orderkey", "a.*")


_NAMES = ", ".join(f"'{t}.parquet'" for t in "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split())


@query(f"SELECT unnest([{_NAMES}]) AS name, true AS has_bytes")
def folder_files(d: Data):
    """A table is a file of the folder, or a folder of files."""
    return R.files(d.spark, d.sf_dir, "*.parquet").groupBy(F.col("entry").alias("name")).agg((F.sum("length") > 0).alias("has_bytes"))


@query("""p AS (SELECT regexp_extract(url, '://[^/]*\\.([a-z]+\\.[a-z]+)/', 1) || '/' || regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS list_id, page_id // 12 + 1 AS page, CASE WHEN length(html) % 3 = 0 THEN 1 ELSE 0 END AS n_new FROM pages),
v AS (SELECT count(*) AS n_events FROM events), m AS (SELECT list_id, max(page) AS e FROM p GROUP BY ALL), e AS (SELECT list_id, e, 1 + (length(list_id) * n_events // 7) % (e + 2) AS c FROM m, v),
d AS (SELECT list_id, e, c, unnest(range(c, least(e, c + 9) + 1)) AS page FROM e),
s AS (SELECT d.*, coalesce(n, 0) > 0 AS new FROM d LEFT JOIN (SELECT list_id, page, sum(n_new) AS n FROM p GROUP BY ALL) f USING (list_id, page)),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY list_id ORDER BY page) AS island FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY list_id, island ORDER BY page) - (island > 0)::INT AS streak FROM i),
t AS (SELECT list_id, min(page) FILTER (streak >= 3) AS dry, max(page) AS last FROM k GROUP BY ALL)
SELECT list_id, coalesce(coalesce(dry, last) - c + 1, 0)::BIGINT AS visited, CASE WHEN last IS NOT NULL THEN c END::BIGINT AS first_page, coalesce(dry, last)::BIGINT AS last_page,
  CASE WHEN last IS NULL OR dry IS NOT NULL OR last >= e THEN 1 ELSE last + 1 END::BIGINT AS next_page FROM e LEFT JOIN t USING (list_id)""", listings=True)
def crawl_resume(d: Data):
    """Lists of pages by domain and language; where their cursors stand comes from the number of events."""
    domain, lang = F.regexp_extract("url", r"://[^/]*\.([a-z]+\.[a-z]+)/", 1), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    pages = d.table("pages").select(F.concat_ws("/", domain, lang).alias("list_id"), (F.floor(F.col("page_id") / 12) + 1).alias("page"), F.when(F.length("html") % 3 == 0, 1).otherwise(0).alias("n_new"))
    events = d.table("events").agg(F.count("*").alias("events"))
    stand = 1 + F.floor(F.length("list_id") * F.col("events") / 7) % (F.col("end") + 2)
    cursors = pages.groupBy("list_id").agg(F.max("page").alias("end")).crossJoin(F.broadcast(events)).select("list_id", stand.alias("page"))  # one row
    return R.resumed(pages, cursors)
