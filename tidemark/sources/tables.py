"""Tables of a data folder, and the listings, alerts and deliveries that are projected from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast; beyond that a join is shuffled.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def large_side(df: DataFrame) -> DataFrame:
    """df for a join that broadcasts neither side. What was written by cut is far larger in memory than its files, by which the
    optimizer would take it for small; a side that grows with the tables must not go through the driver."""
    return df.hint("merge")


def _listing_id() -> list:
    return [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advert per line item: brand, model and version of its part, country of its supplier. Joins are left to the
    optimizer, which broadcasts parts and suppliers as long as they are small."""
    items, parts, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    joined = (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    )
    day = F.col("l_shipdate").cast("timestamp")
    return joined.select(
        F.concat_ws("-", *_listing_id()).alias("portal_id"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 4).cast("string")).alias("source_portal"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        F.lower("p_brand").alias("brand_norm"),
        F.lower("p_type").alias("model_norm"),
        F.col("p_name").alias("version"),
        F.year(day).alias("year"),
        (F.col("l_quantity") * 1000).cast("int").alias("mileage_km"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", "Diesel").when(F.col("l_returnflag") == "A", "Petrol").alias("fuel_type"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 4).alias("power_hp"),
        F.col("n_name").alias("country"),
        day.alias("updated_at"),
        F.when(F.col("l_linestatus") == "F", day).alias("url_verified_at"),
    )


def alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved alert per customer; columns with csv are lists, '' for any."""
    key = F.col("c_custkey")
    size = key % 7
    return (
        table(spark, sf_dir, "customer")
        .where("c_mktsegment <> 'MACHINERY'")
        .select(
            key.alias("id"),
            key.alias("user_id"),
            F.when(key % 10 != 0, F.concat(F.lit("brand#"), (1 + key % 25).cast("string"))).alias("brand_norm"),
            F.when(size == 1, "economy").when(size == 2, "small").when(size == 3, "medium").when(size == 4, "promo").when(size == 5, "standard").when(size == 6, "large").alias("model_norm"),
            (20000 + (key % 8) * 10000).cast("double").alias("max_price"),
            (1995 + key % 6).cast("int").alias("min_year"),
            F.when(key % 4 == 0, 40 + key % 100).cast("int").alias("min_power_hp"),
            F.when(key % 3 == 1, "Diesel").when(key % 3 == 2, "Petrol,Hybrid").otherwise("").alias("fuel_csv"),
            F.when(key % 6 == 1, 30_000).when(key % 6 == 2, 9_999_999).cast("int").alias("max_km"),
            F.when(key % 14 == 0, "nation_3,NATION_7,Nation_11,nation_20").otherwise("").alias("country_csv"),
            F.when(key % 15 == 0, "anvil,new bolt v").otherwise("").alias("engine_csv"),
            F.when(key % 20 == 1, "Base,Re-d").when(key % 20 == 2, "Hot,Ring").otherwise("").alias("trim_csv"),
        )
    )


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries: the items of every fifth order, to its customer, at the order's date."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    items = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0")
    return orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.concat_ws("-", *_listing_id()).alias("listing_id"), F.col("o_orderdate").cast("timestamp").alias("sent_at")
    )


#: The same projections for the SQL twins of queries.
SQL = """
listing AS (
  SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS portal_id,
         'src' || (l_suppkey % 4)::VARCHAR AS source_portal, p_brand AS brand, p_type AS model, lower(p_brand) AS brand_norm,
         lower(p_type) AS model_norm, p_name AS version, year(l_shipdate)::INT AS year, (l_quantity * 1000)::INT AS mileage_km,
         l_extendedprice AS price, CASE l_returnflag WHEN 'R' THEN 'Diesel' WHEN 'A' THEN 'Petrol' END AS fuel_type,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 4 END AS power_hp, n_name AS country, l_shipdate AS updated_at,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS url_verified_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
alert AS (
  SELECT c_custkey AS id, c_custkey AS user_id,
         CASE WHEN c_custkey % 10 <> 0 THEN 'brand#' || (1 + c_custkey % 25)::VARCHAR END AS brand_norm,
         CASE c_custkey % 7 WHEN 1 THEN 'economy' WHEN 2 THEN 'small' WHEN 3 THEN 'medium' WHEN 4 THEN 'promo'
              WHEN 5 THEN 'standard' WHEN 6 THEN 'large' END AS model_norm,
         (20000 + (c_custkey % 8) * 10000)::DOUBLE AS max_price, (1995 + c_custkey % 6)::INT AS min_year,
         CASE WHEN c_custkey % 4 = 0 THEN (40 + c_custkey % 100)::INT END AS min_power_hp,
         CASE c_custkey % 3 WHEN 1 THEN 'Diesel' WHEN 2 THEN 'Petrol,Hybrid' ELSE '' END AS fuel_csv,
         CASE c_custkey % 6 WHEN 1 THEN 30000 WHEN 2 THEN 9999999 END AS max_km,
         CASE WHEN c_custkey % 14 = 0 THEN 'nation_3,NATION_7,Nation_11,nation_20' ELSE '' END AS country_csv,
         CASE WHEN c_custkey % 15 = 0 THEN 'anvil,new bolt v' ELSE '' END AS engine_csv,
         CASE c_custkey % 20 WHEN 1 THEN 'Base,Re-d' WHEN 2 THEN 'Hot,Ring' ELSE '' END AS trim_csv
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
sent AS (
  SELECT o_custkey AS user_id,
         concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS listing_id,
         o_orderdate AS sent_at
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 = 0)
"""


def with_listings(sql: str) -> str:
    """SQL over listing, alert and sent, as one statement; sql may start with further named queries and a comma rule:
    'name AS (...), ... SELECT'."""
    body = sql.strip()
    return f"WITH {SQL.strip()}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
