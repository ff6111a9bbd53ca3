"""Records out of other kinds of sources: JSON catalogs, key-value rows, answers with JSON in them, files of a folder, and the
pages that a resumed crawl visits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X

#: brand -> model -> engines, as a catalog's JSON text has them.
CATALOG = "map<string, map<string, array<struct<engine: string, aliases: array<string>, powerCv: int>>>>"
#: Pages of one run of a crawl, and pages without anything new after which it starts over.
RUN, EMPTY = 10, 3


def catalog_of(texts: DataFrame, column: str) -> DataFrame:
    """JSON texts of catalogs -> brand, model, ordinal, engine, aliases, power. Null, broken and other texts give no rows;
    see broken()."""
    whole = texts.select(F.explode(F.from_json(F.col(column), CATALOG)).alias("brand", "models"))
    models = whole.select("brand", F.explode("models").alias("model", "engines"))
    rows = models.select("brand", "model", F.posexplode("engines").alias("ordinal", "e"))
    return rows.select("brand", "model", "ordinal", F.col("e.engine").alias("engine"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), F.col("e.powerCv").alias("power"))


def broken(column: str, schema: str = CATALOG) -> Column:
    """Whether a text that is set is no JSON of a schema."""
    return F.col(column).isNotNull() & F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).isNull()


def latest_values(rows: DataFrame, schema: str, *order: str, key: str = "key", value: str = "value") -> DataFrame:
    """A key-value table with all its versions -> key, value: each key's last value by `order` that is JSON of the schema. The
    greatest version is pre-aggregated, so a key that is written very often is no hot spot."""
    read = F.from_json(F.col(value), f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    parsed = rows.select(F.col(key).alias("key"), read.alias("value"), *order).where("key is not null and value is not null and value._broken is null").withColumn("value", F.col("value").dropFields("_broken"))
    return parsed.groupBy("key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def json_block(text: Column) -> Column:
    """From the first opening brace of a free text to the last closing one; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def answered(text: Column) -> Column:
    """What an answer in free text with a JSON block says of an advert: fuel and transmission in their canonical names, null if
    unknown, and power, rounded, if it is a number over 0."""
    said = F.from_json(json_block(text), "transmission string, fuelType string, powerHp string")
    fuel, gear = X.fuel_type(said["fuelType"]), X.transmission(said["transmission"])
    power = F.get_json_object(json_block(text), "$.powerHp").try_cast("double")
    quoted = json_block(text).rlike(r'"powerHp"\s*:\s*"')
    return F.struct(F.when(fuel != "Unknown", fuel).alias("fuel"), F.when(gear != "Unknown", gear).alias("transmission"), F.when((power > 0) & ~quoted, F.floor(power + 0.5)).cast("long").alias("power"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, path, length, modified of the files under a folder whose names fit a pattern, and the entry of the folder (the file
    itself, or the subfolder that holds it). Only metadata is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    inside = re.sub("/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder)).rstrip("/")
    entry = F.regexp_extract("path", rf"\Q{inside}\E/+([^/]+)", 1)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("modified"), entry.alias("entry"))


def restored(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """A snapshot among those under a folder (one Parquet file or folder of files each): the named one, else the one with the
    newest file; of equally new ones the last by name."""
    snapshots = files(spark, folder, "*.parquet").withColumnRenamed("entry", "snapshot")
    chosen = name or (last := snapshots.agg(F.max_by("snapshot", F.struct("modified", "snapshot")).alias("s")).first()) and last.s
    if not chosen:
        raise FileNotFoundError(f"no snapshot under {folder}")
    return spark.read.parquet(f"{folder}/{chosen}")


def resumed(pages: DataFrame, cursors: DataFrame, run: int = RUN, empty: int = EMPTY) -> DataFrame:
    """list_id, visited, first_page, last_page, next_page of one run of a crawl over each list of pages.

    pages: list_id, page (from 1), n_new; cursors: list_id, page to go on from (none: 1). A run visits up to `run` page numbers
    from the cursor and stops at the list's end, or after `empty` pages in a row without anything new; then the next run
    starts at page 1, else behind the last one visited. A cursor behind the end starts over as well: nothing is visited.
    Numbers without a page count as empty. Only a run's pages are kept of a list before windows sort them, so lists may be of any length.
    """
    ends = pages.groupBy("list_id").agg(F.max("page").alias("end"))
    start = ends.join(cursors.select("list_id", F.col("page").alias("cursor")), "list_id", "left").select("list_id", "end", F.greatest(F.coalesce("cursor", F.lit(1)), F.lit(1)).cast("long").alias("cursor"))
    numbers = F.sequence("cursor", F.least(F.col("end").cast("long"), F.col("cursor") + run - 1))
    due = start.select("*", F.explode_outer(F.when(F.col("cursor") <= F.col("end"), numbers)).alias("page"))
    found = pages.groupBy("list_id", F.col("page").cast("long").alias("page")).agg(F.sum("n_new").alias("n_new"))
    seen = due.join(found, ["list_id", "page"], "left").withColumn("new", F.coalesce(F.col("n_new") > 0, F.lit(False)))
    in_order = Window.partitionBy("list_id").orderBy("page")
    seen = seen.withColumn("island", F.sum(F.col("new").cast("int")).over(in_order))
    streak = F.row_number().over(Window.partitionBy("list_id", "island").orderBy("page")) - F.when(F.col("island") > 0, 1).otherwise(0)
    seen = seen.withColumn("streak", streak)
    stop = seen.groupBy("list_id", "end", "cursor").agg(F.min(F.when(F.col("streak") >= empty, F.col("page"))).alias("dry"), F.max("page").alias("last"))
    last = F.coalesce("dry", "last")
    wraps = F.col("last").isNull() | F.col("dry").isNotNull() | (last >= F.col("end"))
    return stop.select("list_id", F.coalesce(last - F.col("cursor") + 1, F.lit(0)).cast("long").alias("visited"), F.when(F.col("last").isNotNull(), F.col("cursor")).alias("first_page"), last.alias("last_page"), F.when(wraps, 1).otherwise(last + 1).cast("long").alias("next_page"))
