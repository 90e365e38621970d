"""The archive's relations read from the available tables: each is a projection that the scan prunes and filters.

The SQL texts are in the dialect that Spark and DuckDB share, so a query and its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Pixels: observation, place in it, digital numbers of six bands, land-cover code, scene class.
PIXELS = """
SELECT l_orderkey AS obs_id, l_linenumber AS px, CAST(floor(l_quantity * 100) AS INT) AS b02,
       CAST(floor(l_extendedprice / 20) AS INT) AS b03, CAST(floor(l_discount * 30000) AS INT) AS b04,
       CAST(floor(l_tax * 50000) AS INT) AS b08, CAST(l_partkey % 4001 AS INT) AS b11, CAST(l_suppkey % 3001 AS INT) AS b12,
       CAST(CASE WHEN l_returnflag = 'A' THEN 80 WHEN l_returnflag = 'R' THEN 10 * (1 + l_linenumber % 6) ELSE 95 - 45 * (l_linenumber % 2) END AS INT) AS cover,
       CAST(l_linenumber * 5 % 12 AS INT) AS scl
FROM lineitem
"""

#: Observations of tiles: value is an index value, usable a share from the properties.
OBSERVATIONS = """
SELECT event_id, user_id AS tile, CAST(ts AS DATE) AS day, ts, event_type AS role, value, props FROM events
"""

#: Scenes: area, acquisition time, a cloud figure, a baseline and a status.
SCENES = """
SELECT o_orderkey AS scene_id, o_custkey AS aoi, o_orderdate AS acquired_at, o_totalprice AS cloud,
       CAST(o_orderkey % 7 AS INT) AS major, o_orderstatus AS status, o_orderpriority AS priority
FROM orders
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _relation(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=read(spark, sf_dir, name))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, sf_dir, PIXELS, "lineitem")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, sf_dir, OBSERVATIONS, "events")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, sf_dir, SCENES, "orders")
