"""Queries: engines and typical power out of version texts, with a catalog that is made of the parts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import matching as M
from .registry import Data, query

FAMILIES = ("tdi", "tsi", "dci")


def _size_and_family() -> tuple[Column, Column]:
    """A part's displacement and engine family, by its size and key."""
    size = F.concat((1 + F.col("p_size") % 3).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    return size, F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("p_partkey") % 3 + 1).cast("int"))


def part_engines(d: Data):
    """A catalog of engines: those of a model's parts, with their typical power."""
    size, family = _size_and_family()
    power = (60 + 20 * (F.col("p_size") % 10) + 7 * (F.col("p_partkey") % 3)).cast("int")
    rows = d.table("part").select(F.lower("p_brand").alias("brand"), F.lower("p_type").alias("model"), F.concat_ws(" ", size, family).alias("engine_norm"), power.alias("power")).distinct()
    ordinal = F.row_number().over(Window.partitionBy("brand", "model").orderBy("engine_norm"))
    return rows.withColumn("ordinal", ordinal).withColumn("aliases", F.array("engine_norm", F.replace("engine_norm", F.lit(" "), F.lit(""))))


def with_engine_texts(d: Data):
    """Adverts whose version names, in turn, their part's engine, its displacement alone, a power, nothing, and an engine
    that no catalog has; power is unknown in a fifth of them, as it is stored."""
    size, family = _size_and_family()
    parts = d.table("part").select("p_partkey", size.alias("_size"), F.upper(family).alias("_family"))
    kind = F.floor(F.col("mileage_km") / 1000) % 5
    said = F.when(kind == 0, F.concat_ws(" ", "version", "_size", "_family", F.lit("S line"))).when(kind == 1, F.concat_ws(" ", "version", "_size"))
    said = said.when(kind == 2, F.concat_ws(" ", "version", F.lit("150 CV"))).when(kind == 3, F.col("version")).otherwise(F.concat_ws(" ", "version", F.lit("9.9 TDI")))
    key = F.element_at(F.split("portal_id", "-"), 3).cast("long")
    return d.listing.join(parts, key == F.col("p_partkey")).withColumn("version", said).drop("p_partkey", "_size", "_family")


_FOUND = """e AS (SELECT DISTINCT lower(p_brand) AS b, lower(p_type) AS m, (1 + p_size % 3) || '.' || (p_size % 10) AS size, ['tdi', 'tsi', 'dci'][p_partkey % 3 + 1] AS fam, (60 + 20 * (p_size % 10) + 7 * (p_partkey % 3))::INT AS power FROM part),
c AS (SELECT *, size || ' ' || fam AS engine, row_number() OVER (PARTITION BY b, m ORDER BY size || ' ' || fam) AS o, count(*) OVER (PARTITION BY b, m, size) AS n FROM e),
t AS (SELECT l.*, mileage_km // 1000 % 5 AS kind, (1 + p_size % 3) || '.' || (p_size % 10) AS own_size, ['tdi', 'tsi', 'dci'][p_partkey % 3 + 1] AS own_fam,
        CASE WHEN power_hp > 20 THEN power_hp WHEN mileage_km // 1000 % 5 = 2 THEN 150 END AS hint FROM listing l JOIN part ON p_partkey = split_part(portal_id, '-', 3)::BIGINT),
q AS (SELECT DISTINCT brand_norm AS qb, model_norm AS qm, kind AS qk, own_size AS qs, own_fam AS qf, hint AS qh FROM t WHERE kind < 2),
r AS (SELECT q.*, engine, power, row_number() OVER (PARTITION BY qb, qm, qk, qs, qf, qh ORDER BY CASE WHEN qk = 0 THEN 0 WHEN n = 1 THEN 0 WHEN qh IS NOT NULL THEN abs(power - qh) WHEN fam = 'tsi' THEN 1 WHEN fam = 'tdi' THEN 2 ELSE 3 END, o) AS place
      FROM q JOIN c ON b = qb AND m = qm AND size = qs AND (qk = 1 OR fam = qf)),
f AS (SELECT t.*, CASE WHEN kind = 4 THEN '9.9 tdi' ELSE coalesce(engine, '') END AS found, coalesce(hint, power) AS found_power, CASE WHEN engine IS NOT NULL THEN 'catalog' WHEN kind = 4 OR hint IS NOT NULL THEN 'heuristic' END AS source
      FROM t LEFT JOIN r ON place = 1 AND qb = brand_norm AND qm = model_norm AND qk = kind AND qs = own_size AND qf = own_fam AND qh IS NOT DISTINCT FROM hint)"""


@query(f"{_FOUND} SELECT portal_id, found AS engine_norm, found_power AS engine_power, source AS engine_source FROM f", listings=True)
def engine_resolve(d: Data):
    return C.resolve_engines(with_engine_texts(d), part_engines(d))


@query(f"{_FOUND} SELECT portal_id, CASE WHEN mileage_km % 7000 = 0 THEN 'tfsi' ELSE found END AS engine_norm, coalesce(power_hp, found_power) AS power_hp FROM f", listings=True)
def engine_enrich(d: Data):
    stored = F.when(F.col("mileage_km") % 7000 == 0, "0 TFSI").otherwise("")
    return C.enriched(with_engine_texts(d).withColumn("engine_norm", stored), part_engines(d)).select("portal_id", "engine_norm", "power_hp")


@query(f"""{_FOUND} SELECT id, count(*) AS n FROM f JOIN alert a ON a.brand_norm = f.brand_norm AND (CASE WHEN id % 2 = 0 THEN contains(found, 'tsi') ELSE coalesce(coalesce(power_hp, CASE WHEN kind = 2 THEN 150 END, found_power) >= 120, false) END)
GROUP BY ALL""", listings=True)
def engine_alerts(d: Data):
    """Alerts for an engine or a least power, over adverts whose engines and typical power come out of the catalog."""
    k = F.col("id")
    alerts = d.alert.where("brand_norm is not null").select("id", "user_id", "brand_norm", F.when(k % 2 == 0, "TSI").alias("engine_csv"), F.when(k % 2 == 1, 120).alias("min_power_hp"))
    return M.totals(with_engine_texts(d), alerts, engines=part_engines(d), least=False).select("id", "n")
