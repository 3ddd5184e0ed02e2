"""Demo views over the driver tables.

The reference reads crop, soil, weather and rainfall CSV files that are not
shipped. These views map the driver's TPC-H-like tables onto the shapes the
operators expect, so every registered query reads the given tables and its
work grows with them. Each view has a DuckDB twin (``*_SQL``) used by the
oracle check; the formulas are written so both engines do the same IEEE
operations in the same order.

Plan notes: the ``obs`` view first enriches ``orders`` with customer, nation
and region, then joins the large ``lineitem`` to it and to ``part`` on their
keys: at scale two shuffles of the lineitem-sized side (AQE turns a side into
a broadcast once it has measured it), while ``nation``/``region`` are tiny
dimension files that Spark broadcasts from file statistics. Only the columns
each query needs are read (``ReadSchema`` pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# --------------------------------------------------------------------------
# obs: one observation per lineitem row
# --------------------------------------------------------------------------

def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    # orders are enriched with customer -> nation -> region first (orders is a
    # quarter of lineitem), so the lineitem-sized side is shuffled only twice:
    # once on orderkey and once on partkey
    cnr = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    ord_ = o.join(cnr, F.col("o_custkey") == F.col("c_custkey"))
    j = (li.join(ord_, li.l_orderkey == ord_.o_orderkey)
           .join(p, F.col("l_partkey") == F.col("p_partkey")))
    return j.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").alias("ts"),
        F.col("p_type").alias("crop_type"),
        F.col("l_quantity").alias("temperature"),
        (F.col("l_extendedprice") / 50.0).alias("rainfall"),
        (F.lit(40.0) + F.lit(500.0) * F.col("l_discount") + 0.0).alias("humidity"),
        (F.lit(1000.0) * F.col("l_tax") + 0.0).alias("N"),
        F.col("p_size").cast("double").alias("P"),
        (F.col("p_retailprice") - 900.0).alias("K"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) / 10000.0).alias("crop_yield"),
    )


OBS_SQL = """
obs AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         n_name AS country, r_name AS region,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_orderdate AS ts,
         p_type AS crop_type,
         l_quantity AS temperature,
         l_extendedprice / 50.0 AS rainfall,
         40.0 + 500.0 * l_discount + 0.0 AS humidity,
         1000.0 * l_tax + 0.0 AS N,
         CAST(p_size AS DOUBLE) AS P,
         p_retailprice - 900.0 AS K,
         l_extendedprice * (1.0 - l_discount) / 10000.0 AS crop_yield
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""


# --------------------------------------------------------------------------
# soil: one soil/crop sample per part (label = p_type)
# --------------------------------------------------------------------------

def soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return p.select(
        F.col("p_partkey").alias("soil_id"),
        F.col("p_type").alias("label"),
        (F.col("p_size").cast("double") * 2.0).alias("N"),
        (F.col("p_retailprice") - 900.0).alias("P"),
        ((F.col("p_partkey") % 61).cast("double") + 5.0).alias("K"),
        (F.lit(12.0) + (F.col("p_partkey") % 25).cast("double")).alias("temperature"),
        (F.lit(30.0) + F.col("p_size").cast("double")).alias("humidity"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(5.0) + (F.col("p_partkey") % 30).cast("double") / 10.0).alias("ph"),
        (F.lit(100.0) + (F.col("p_retailprice") - 900.0) * 7.0).alias("rainfall"),
    )


SOIL_SQL = """
soil AS (
  SELECT p_partkey AS soil_id, p_type AS label,
         CAST(p_size AS DOUBLE) * 2.0 AS N,
         p_retailprice - 900.0 AS P,
         CAST(p_partkey % 61 AS DOUBLE) + 5.0 AS K,
         12.0 + CAST(p_partkey % 25 AS DOUBLE) AS temperature,
         30.0 + CAST(p_size AS DOUBLE) AS humidity,
         CASE WHEN p_size % 7 = 0 THEN NULL
              ELSE 5.0 + CAST(p_partkey % 30 AS DOUBLE) / 10.0 END AS ph,
         100.0 + (p_retailprice - 900.0) * 7.0 AS rainfall
  FROM part
)"""


# --------------------------------------------------------------------------
# weather: one snapshot per event (place = user_id, country via user_id % 25)
# --------------------------------------------------------------------------

def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = e.join(n, (F.col("user_id") % 25) == F.col("n_nationkey"))
    return j.select(
        "event_id",
        F.col("user_id").alias("place_id"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("Place "), F.col("user_id").cast("string")).alias("location_name"),
        ((F.col("user_id") % 120).cast("double") * 1.5 - 89.5).alias("latitude"),
        (((F.col("user_id") * 7) % 360).cast("double") - 179.5).alias("longitude"),
        F.col("ts").alias("last_updated"),
        F.col("value").alias("temperature_celsius"),
        (F.col("value") / 10.0).alias("precip_mm"),
        (F.lit(30.0) + (F.col("event_id") % 60).cast("double")).alias("humidity"),
    )


WEATHER_SQL = """
weather AS (
  SELECT event_id, user_id AS place_id, n_name AS country,
         'Place ' || CAST(user_id AS VARCHAR) AS location_name,
         CAST(user_id % 120 AS DOUBLE) * 1.5 - 89.5 AS latitude,
         CAST((user_id * 7) % 360 AS DOUBLE) - 179.5 AS longitude,
         ts AS last_updated,
         value AS temperature_celsius,
         value / 10.0 AS precip_mm,
         30.0 + CAST(event_id % 60 AS DOUBLE) AS humidity
  FROM events JOIN nation ON user_id % 25 = n_nationkey
)"""


# --------------------------------------------------------------------------
# series: order totals by order date (raw observations; months with gaps)
# --------------------------------------------------------------------------

def series_raw(spark: SparkSession, sf_dir: str, with_gaps: bool = True) -> DataFrame:
    """Raw (series_key, obs_date, value) rows: one per order, keyed by nation.

    ``with_gaps`` books the readings of April of odd years 30 days later, in May
    (all rows stay), so month bucketing has holes to fill.
    """
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey"))
    if with_gaps:
        late = (F.month("o_orderdate") == 4) & (F.year("o_orderdate") % 2 == 1)
        j = j.withColumn("o_orderdate", F.when(late, F.expr("o_orderdate + INTERVAL 30 DAYS")).otherwise(F.col("o_orderdate")))
    return j.select(F.col("n_name").alias("series_key"),
                    F.col("o_orderdate").alias("obs_date"),
                    F.col("o_totalprice").alias("value"))


SERIES_RAW_SQL = """
series_raw AS (
  SELECT n_name AS series_key,
         CASE WHEN month(o_orderdate) = 4 AND year(o_orderdate) % 2 = 1 THEN o_orderdate + INTERVAL 30 DAY
              ELSE o_orderdate END AS obs_date, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
)"""


# --------------------------------------------------------------------------
# places: one point location per supplier (ordinal = s_suppkey)
# --------------------------------------------------------------------------

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return j.select(
        k.alias("place_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("country"),
        ((k % 150).cast("double") * 1.1 - 80.0).alias("lat"),
        (((k * 37) % 340).cast("double") - 170.0).alias("lng"),
        (F.lit(5.0) + (k % 30).cast("double")).alias("temp"),
        (F.abs(F.col("s_acctbal")) / 4.0).alias("rain"),
        F.when(k % 5 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(30.0) + (k % 60).cast("double")).alias("humidity"),
        F.when(k % 4 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(50.0) + (k % 50).cast("double")).alias("N"),
        F.when(k % 6 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(20.0) + (k % 40).cast("double")).alias("P"),
        F.when(k % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(15.0) + (k % 45).cast("double")).alias("K"),
    )


PLACES_SQL = """
places AS (
  SELECT s_suppkey AS place_id, s_name AS name, n_name AS country,
         CAST(s_suppkey % 150 AS DOUBLE) * 1.1 - 80.0 AS lat,
         CAST((s_suppkey * 37) % 340 AS DOUBLE) - 170.0 AS lng,
         5.0 + CAST(s_suppkey % 30 AS DOUBLE) AS temp,
         abs(s_acctbal) / 4.0 AS rain,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 30.0 + CAST(s_suppkey % 60 AS DOUBLE) END AS humidity,
         CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 50.0 + CAST(s_suppkey % 50 AS DOUBLE) END AS N,
         CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 20.0 + CAST(s_suppkey % 40 AS DOUBLE) END AS P,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 15.0 + CAST(s_suppkey % 45 AS DOUBLE) END AS K
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the DuckDB CTEs it needs."""
    ctes = {"obs": OBS_SQL, "soil": SOIL_SQL, "weather": WEATHER_SQL,
            "series_raw": SERIES_RAW_SQL, "places": PLACES_SQL}
    if not views:
        return sql
    body = ",\n".join(ctes[v] for v in views)
    s = sql.lstrip()
    if s[:4].upper() == "WITH":
        return "WITH " + body + ",\n" + s[4:]
    return "WITH " + body + "\n" + s
