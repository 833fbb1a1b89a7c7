"""A road network that is a projection of the driver's tables, in integer arithmetic.

Parts are nodes on a grid of ``WIDTH`` columns; arcs join neighbours. All ids come from the keys, so no
global numbering is needed: ``arc_id = 4 * tail + slot`` is ascending in (tail, head).

Nodes and arcs carry a hint for shuffled joins: Spark takes the compressed size of the few columns of ``part`` for the size of the
arcs, a fortieth or less of what they take in memory, and would send millions of arcs through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50
INFINITY = 2147483647


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, lat, lng, size, name``."""
    key = "p_partkey"
    return read(spark, sf_dir, "part").select(
        F.col(key).alias("node_id"),
        F.expr(f"20.9D + ({key} div {WIDTH}) * 0.001D").alias("lat"),
        F.expr(f"105.7D + ({key} % {WIDTH}) * 0.001D").alias("lng"),
        F.col("p_size").cast("bigint").alias("size"),
        F.col("p_name").alias("name"),
    ).hint("merge")


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arc_id, tail, head, travel_time, geo_distance, way_id, antiparallel, highway``."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("tail"), F.col("p_size").cast("bigint").alias("size"))
    steps = F.array(*[F.struct(F.lit(d).cast("bigint").alias("step"), F.lit(n).cast("bigint").alias("slot")) for n, d in enumerate((-WIDTH, -1, 1, WIDTH))])
    rows = part.select("tail", "size", F.inline(steps)).withColumn("head", F.col("tail") + F.col("step"))
    rows = rows.where(f"(abs(step) = {WIDTH} OR tail div {WIDTH} = head div {WIDTH}) AND head >= 0 AND (tail * 7 + head * 13) % 10 < 8")
    rows = rows.join(part.select(F.col("tail").alias("head")).hint("merge"), "head", "left_semi")
    across = "abs(step) = 1"
    return rows.select(
        F.expr("tail * 4 + slot").alias("arc_id"),
        "tail",
        "head",
        F.expr("1000 + size * 100 + ((tail * 31 + head * 17) % 50) * 10").alias("travel_time"),
        F.expr("100 + (tail * 13 + head * 7) % 120").alias("geo_distance"),
        F.expr(f"CASE WHEN {across} THEN tail div {WIDTH} ELSE 1000000 + tail % {WIDTH} END").alias("way_id"),
        (F.col("head") < F.col("tail")).alias("antiparallel"),
        F.expr(f"CASE WHEN {across} AND (tail div {WIDTH}) % 10 = 0 THEN 'primary' WHEN NOT ({across}) AND (tail % {WIDTH}) % 10 = 0 THEN 'secondary' ELSE 'residential' END").alias("highway"),
    ).hint("merge")


def arcs_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with the coordinates of both ends, by arithmetic on the ids."""
    at = lambda c: (F.expr(f"20.9D + ({c} div {WIDTH}) * 0.001D"), F.expr(f"105.7D + ({c} % {WIDTH}) * 0.001D"))
    (a, b), (c, d) = at("tail"), at("head")
    return arcs(spark, sf_dir).select("*", a.alias("tail_lat"), b.alias("tail_lng"), c.alias("head_lat"), d.alias("head_lng"))


#: The same network in SQL, for the oracles.
SQL = f"""
nodes AS (
  SELECT p_partkey AS node_id, CAST(20.9 AS DOUBLE) + (p_partkey // {WIDTH}) * CAST(0.001 AS DOUBLE) AS lat,
         CAST(105.7 AS DOUBLE) + (p_partkey % {WIDTH}) * CAST(0.001 AS DOUBLE) AS lng, CAST(p_size AS BIGINT) AS size, p_name AS name
  FROM part),
arcs AS (
  SELECT tail * 4 + slot AS arc_id, tail, head, 1000 + size * 100 + ((tail * 31 + head * 17) % 50) * 10 AS travel_time,
         100 + (tail * 13 + head * 7) % 120 AS geo_distance,
         CASE WHEN abs(step) = 1 THEN tail // {WIDTH} ELSE 1000000 + tail % {WIDTH} END AS way_id, head < tail AS antiparallel,
         CASE WHEN abs(step) = 1 AND (tail // {WIDTH}) % 10 = 0 THEN 'primary'
              WHEN abs(step) <> 1 AND (tail % {WIDTH}) % 10 = 0 THEN 'secondary' ELSE 'residential' END AS highway,
         CAST(20.9 AS DOUBLE) + (tail // {WIDTH}) * CAST(0.001 AS DOUBLE) AS tail_lat, CAST(105.7 AS DOUBLE) + (tail % {WIDTH}) * CAST(0.001 AS DOUBLE) AS tail_lng,
         CAST(20.9 AS DOUBLE) + (head // {WIDTH}) * CAST(0.001 AS DOUBLE) AS head_lat, CAST(105.7 AS DOUBLE) + (head % {WIDTH}) * CAST(0.001 AS DOUBLE) AS head_lng
  FROM (SELECT p_partkey AS tail, p_partkey + step AS head, step, slot, CAST(p_size AS BIGINT) AS size
        FROM part, (VALUES (CAST(-{WIDTH} AS BIGINT), CAST(0 AS BIGINT)), (-1, 1), (1, 2), ({WIDTH}, 3)) AS s(step, slot)) AS x
  WHERE head >= 0 AND (abs(step) = {WIDTH} OR tail // {WIDTH} = head // {WIDTH}) AND (tail * 7 + head * 13) % 10 < 8
    AND head IN (SELECT p_partkey FROM part))
"""
WITH = f"WITH RECURSIVE {SQL}"
