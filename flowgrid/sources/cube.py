"""The origin-destination cube and its crosswalk, as views of the star-schema test tables.

Columns of the cube: day (YYYYMMDD string), hour (int), origin, dest (zone codes, strings with leading
zeros), band (distance band), act_o, act_d (activities), income, age, sex (segments, null if unknown),
trips and trip_km (doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(key: Column, options: dict) -> Column:
    """The option for a key; null for any other key."""
    first, *rest = options.items()
    out = F.when(key == first[0], first[1])
    for k, v in rest:
        out = out.when(key == k, v)
    return out


def zone_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, zone): region and nation numbers, zero-padded; the first two characters are the province."""
    nation = read(spark, sf_dir, "nation")
    code = F.concat(F.lpad(F.col("n_regionkey").cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    return nation.select(F.col("n_nationkey").alias("nation"), code.alias("zone"))


def od_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    customer, supplier, part = (read(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    zones = zone_codes(spark, sf_dir)
    origin = supplier.join(zones, F.col("s_nationkey") == F.col("nation")).select("s_suppkey", F.col("zone").alias("origin"))
    dest = customer.join(zones, F.col("c_nationkey") == F.col("nation")).select("c_custkey", "c_mktsegment", F.col("zone").alias("dest"))
    size = F.col("p_size")
    band = F.when(size <= 10, "0.5-2").when(size <= 20, "2-10").when(size <= 30, "10-50").when(size <= 40, "50-100").otherwise(">100")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 5
    priority = F.substring("o_orderpriority", 1, 1)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(dest, F.col("o_custkey") == F.col("c_custkey"))
        .join(origin, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24).cast("int").alias("hour"),
            "origin",
            "dest",
            band.alias("band"),
            choose(priority, {"1": "casa", "2": "casa", "3": "trabajo_estudio", "4": "frecuente", "5": "no_frecuente"}).alias("act_o"),
            choose(
                F.col("c_mktsegment"),
                {"MACHINERY": "trabajo_estudio", "BUILDING": "casa", "AUTOMOBILE": "frecuente", "HOUSEHOLD": "casa", "FURNITURE": "no_frecuente"},
            ).alias("act_d"),
            choose(F.col("l_returnflag"), {"A": "<10", "R": "10-15"}).alias("income"),
            choose(brand, {1: "0-25", 2: "25-45", 3: "45-65", 4: "65-100"}).alias("age"),
            F.when(F.col("l_linestatus") == "F", "mujer").when(F.col("l_linenumber") % 3 != 0, "hombre").alias("sex"),
            F.col("l_quantity").alias("trips"),
            F.col("l_extendedprice").alias("trip_km"),
        )
    )


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, cell, weight): customers are their nation's cells, with weights that sum to 1 in each zone."""
    zones = zone_codes(spark, sf_dir)
    cells = read(spark, sf_dir, "customer").join(zones, F.col("c_nationkey") == F.col("nation"))
    mass = cells.select("zone", F.lower(F.lpad(F.hex("c_custkey"), 15, "0")).alias("cell"), (F.col("c_acctbal") + 2000).alias("mass"))
    total = mass.groupBy("zone").agg(F.sum("mass").alias("total"))
    return mass.join(total, "zone").select("zone", "cell", (F.col("mass") / F.col("total")).alias("weight"))


#: The same in SQL, as common table expressions for the oracle queries.
CUBE_SQL = """
zones AS (SELECT n_nationkey AS nation, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS zone FROM nation),
cube AS (
  SELECT strftime(o_orderdate, '%Y%m%d') AS day, CAST((l_orderkey * 7 + l_linenumber) % 24 AS INTEGER) AS hour, so.zone AS origin, cd.zone AS dest,
    CASE WHEN p_size <= 10 THEN '0.5-2' WHEN p_size <= 20 THEN '2-10' WHEN p_size <= 30 THEN '10-50' WHEN p_size <= 40 THEN '50-100' ELSE '>100' END AS band,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'casa' WHEN '2' THEN 'casa' WHEN '3' THEN 'trabajo_estudio' WHEN '4' THEN 'frecuente' WHEN '5' THEN 'no_frecuente' END AS act_o,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'trabajo_estudio' WHEN 'BUILDING' THEN 'casa' WHEN 'AUTOMOBILE' THEN 'frecuente' WHEN 'HOUSEHOLD' THEN 'casa' WHEN 'FURNITURE' THEN 'no_frecuente' END AS act_d,
    CASE l_returnflag WHEN 'A' THEN '<10' WHEN 'R' THEN '10-15' END AS income,
    CASE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 5 WHEN 1 THEN '0-25' WHEN 2 THEN '25-45' WHEN 3 THEN '45-65' WHEN 4 THEN '65-100' END AS age,
    CASE WHEN l_linestatus = 'F' THEN 'mujer' WHEN l_linenumber % 3 <> 0 THEN 'hombre' END AS sex,
    l_quantity AS trips, l_extendedprice AS trip_km
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey JOIN zones so ON s_nationkey = so.nation JOIN zones cd ON c_nationkey = cd.nation),
xwalk AS (
  SELECT zone, lower(lpad(upper(to_hex(c_custkey)), 15, '0')) AS cell, (c_acctbal + 2000) / sum(c_acctbal + 2000) OVER (PARTITION BY zone) AS weight
  FROM customer JOIN zones ON c_nationkey = nation),
silver AS (
  SELECT * REPLACE (coalesce(income, 'NA') AS income, coalesce(age, 'NA') AS age, coalesce(sex, 'NA') AS sex),
    CAST(strptime(day, '%Y%m%d') AS DATE) AS date, CAST(dayofweek(strptime(day, '%Y%m%d')) + 1 AS INTEGER) AS weekday,
    dayofweek(strptime(day, '%Y%m%d')) IN (0, 6) AS is_weekend, 1 AS support,
    CASE substr(day, 5, 2) WHEN '02' THEN 'feb' WHEN '05' THEN 'may' WHEN '06' THEN 'jun' END AS season
  FROM cube)
"""
