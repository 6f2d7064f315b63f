"""The engine's inputs derived from the generic test tables by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import num
from gridloom.sources.scheme import web_mercator_levels

LEVEL = 18
AREA = {"min_x": -9335000.0, "min_y": 4880000.0, "max_x": -9325000.0, "max_y": 4895000.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(spark: SparkSession) -> DataFrame:
    return web_mercator_levels(spark, 0, 23)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``level, row, col``: the aggregation combines before the shuffle."""
    rows = table(spark, sf_dir, "lineitem").select((99000 + F.col("l_orderkey") % 200).alias("row"), (70000 + F.col("l_partkey") % 150).alias("col"))
    return rows.distinct().select(F.lit(LEVEL).alias("level"), "row", "col")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x0, y0 = (k * 7919) % 6000, (k * 104729) % 4000
    hundredth = lambda v: v.cast("double") / num(100)
    return table(spark, sf_dir, "customer").select(k.alias("id"), hundredth(x0).alias("x0"), hundredth(y0).alias("y0"), hundredth(x0 + 50 + k % 100).alias("x1"), hundredth(y0 + 50 + k % 70).alias("y1"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, lat, lon`` within the projection's range."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (((k * 7919) % 17000).cast("double") / num(100) - num(85)).alias("lat"), (((k * 104729) % 36000).cast("double") / num(100) - num(180)).alias("lon"))


def aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), (((k * 7919) % 4000).cast("double") / num(100)).alias("lat"), (((k * 104729) % 6000).cast("double") / num(100)).alias("lon"), (1 + k % 50).cast("double").alias("miles")
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service a nation: ``key, kinds, coverage``."""
    k = F.col("n_nationkey").cast("long")
    lat, lon = ((k * 7) % 30).cast("double"), ((k * 11) % 40).cast("double")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("svc_"), F.lpad(k.cast("string"), 2, "0")).alias("key"),
        F.when(k % 2 == 0, F.array(F.lit("imagery"))).otherwise(F.array(F.lit("imagery"), F.lit("elevation"))).alias("kinds"),
        F.array(lat, lon, lat + num(10), lon + num(20)).alias("coverage"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_seq, y, x, v``: values below 10 stand for NoData (null)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("src_seq"), (F.col("l_orderkey") % 64).alias("y"), (F.col("l_partkey") % 64).alias("x")).agg(F.min("l_quantity").alias("v"))
    return rows.withColumn("v", F.when(F.col("v") >= 10, F.col("v")))


TILES_SQL = 'tiles AS (SELECT DISTINCT 18 AS level, 99000 + l_orderkey % 200 AS "row", 70000 + l_partkey % 150 AS col FROM lineitem)'
BOXES_SQL = """boxes AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 6000)::DOUBLE / 100 AS x0, ((c_custkey * 104729) % 4000)::DOUBLE / 100 AS y0,
  ((c_custkey * 7919) % 6000 + 50 + c_custkey % 100)::DOUBLE / 100 AS x1, ((c_custkey * 104729) % 4000 + 50 + c_custkey % 70)::DOUBLE / 100 AS y1 FROM customer)"""
POINTS_SQL = "points AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 17000)::DOUBLE / 100 - 85 AS lat, ((c_custkey * 104729) % 36000)::DOUBLE / 100 - 180 AS lon FROM customer)"
AOIS_SQL = "aois AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 4000)::DOUBLE / 100 AS lat, ((s_suppkey * 104729) % 6000)::DOUBLE / 100 AS lon, (1 + s_suppkey % 50)::DOUBLE AS miles FROM supplier)"
SERVICES_SQL = """services AS (SELECT 'svc_' || lpad(k::VARCHAR, 2, '0') AS key, k % 2 = 1 AS elevation, lat AS y0, lon AS x0, lat + 10 AS y1, lon + 20 AS x1
  FROM (SELECT n_nationkey::BIGINT AS k, ((n_nationkey * 7) % 30)::DOUBLE AS lat, ((n_nationkey * 11) % 40)::DOUBLE AS lon FROM nation))"""
PIXELS_SQL = """pixels AS (SELECT l_linenumber AS src_seq, l_orderkey % 64 AS y, l_partkey % 64 AS x, CASE WHEN min(l_quantity) >= 10 THEN min(l_quantity) END AS v
  FROM lineitem GROUP BY ALL)"""
