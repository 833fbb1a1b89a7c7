"""Queries over route shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import geo, shape
from viaduct.plans.registry import query
from viaduct.plans.scalars import HAV
from viaduct.sources import grid

#: Lines of seven points that begin at every node; the second half of each is bent and repeats a point.
LINES = """l AS (SELECT node_id AS id, unnest(range(7)) AS i, lat, lng FROM nodes), p AS (SELECT id, i, CASE WHEN i = 4 THEN lat + 0.0003::DOUBLE ELSE lat + i * 0.0001::DOUBLE END AS y, lng + (CASE WHEN i = 6 THEN 5 ELSE i END) * 0.001::DOUBLE AS x FROM l)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, points``."""
    point = "named_struct('lat', CASE WHEN i = 4 THEN lat + 0.0003D ELSE lat + i * 0.0001D END, 'lng', lng + (CASE WHEN i = 6 THEN 5 ELSE i END) * 0.001D)"
    return grid.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), F.expr(f"transform(sequence(0, 6), i -> {point})").alias("points"))


def micro(x):
    return F.round(x * 1_000_000).cast("bigint")


@query("r07_expanded_arcs", f"{grid.WITH} SELECT tail // 50 AS path_id, count(*) + count(DISTINCT tail) FILTER (NOT EXISTS (SELECT 1 FROM arcs b WHERE b.head = a.tail AND b.tail = a.tail - 1 AND b.tail // 50 = a.tail // 50)) AS points, count(*) AS arcs, max(0) AS first_end_less_one FROM arcs a WHERE head = tail + 1 GROUP BY 1")
def expanded_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs of each row to the right, one after another: points that repeat their neighbour are one."""
    rows = grid.arcs_with_ends(spark, sf_dir).where("head = tail + 1")
    point = lambda c: F.struct(F.col(f"{c}_lat").alias("lat"), F.col(f"{c}_lng").alias("lng"))
    paths = rows.groupBy(F.expr("tail div 50").alias("path_id")).agg(F.array_sort(F.collect_list(F.struct("tail", F.array(point("tail"), point("head")).alias("line")))).alias("s"))
    found = paths.select("path_id", F.size("s").cast("bigint").alias("arcs"), shape.expanded(F.transform("s", lambda x: x["line"])).alias("e"))
    return found.select("path_id", F.size("e.points").cast("bigint").alias("points"), "arcs", (F.get("e.ends", F.lit(0)) - 1).cast("bigint").alias("first_end_less_one"))


AT = f"a AS (SELECT id, i, y, x, sum(coalesce(m, 0)) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, {HAV.format(a='lag(y) OVER w', b='lag(x) OVER w', c='y', d='x')} AS m FROM p WINDOW w AS (PARTITION BY id ORDER BY i)))"


@query(
    "r08_connectors",
    f"""{grid.WITH}, {LINES}, {AT}, s AS (SELECT id, (id % 7) * 90.0::DOUBLE AS snap, id % 2 = 0 AS ahead FROM a GROUP BY id), e AS (SELECT id, max(run) FILTER (i = 6) AS total FROM a GROUP BY id)
    SELECT id, count(*) FILTER (i BETWEEN 1 AND 5 AND CASE WHEN ahead THEN abs(greatest(total, snap) - snap) > 0.001 AND run >= snap + 0.001 AND run <= greatest(total, snap) - 0.001 ELSE snap > 0.001 AND run >= 0.001 AND run <= snap - 0.001 END) AS inner_points,
      count(*) FILTER (i BETWEEN 1 AND 5 AND run >= 100.001 AND run <= 399.999) AS middle_points FROM a JOIN s USING (id) JOIN e USING (id) GROUP BY id""",
)
def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("snap", F.expr("(id % 7) * 90.0D")).withColumn("ahead", F.expr("id % 2 = 0"))
    return rows.select("id", F.size(shape.connector(F.col("points"), F.col("snap"), F.col("ahead"))).cast("bigint").alias("inner_points"), F.size(shape.between(F.col("points"), F.lit(400.0), F.lit(100.0))).cast("bigint").alias("middle_points"))


@query(
    "r09_patched_routes",
    f"{grid.WITH} SELECT node_id AS id, CAST(CASE WHEN node_id % 3 = 0 THEN 3 ELSE 4 END + 1 AS BIGINT) AS points, CAST(CASE WHEN node_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS added, CAST(1 AS BIGINT) AS appended, CAST(round((lat + CASE WHEN node_id % 3 = 0 THEN 0 ELSE 0.0002::DOUBLE END) * 1000000) AS BIGINT) AS first_lat FROM nodes",
)
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points, a projected place before them that every third row already begins with, and one point and a place behind."""
    rows = grid.nodes(spark, sf_dir)
    point = lambda y, x: F.struct((F.col("lat") + y).alias("lat"), (F.col("lng") + x).alias("lng"))
    route = F.array(point(0.0, 0.0), point(0.0, 0.001), point(0.0, 0.002))
    place = F.when(F.col("node_id") % 3 == 0, point(0.000001, 0.0)).otherwise(point(0.0002, 0.0))
    rows = rows.withColumn("a", shape.with_start(route, place, F.slice(route, 1, 0)))
    rows = rows.withColumn("b", shape.with_end(F.col("a.points"), point(0.0, 0.003000001), F.array(point(0.0, 0.003))))
    return rows.select(F.col("node_id").alias("id"), F.size("b.points").cast("bigint").alias("points"), F.col("a.added").cast("bigint").alias("added"), F.col("b.added").cast("bigint").alias("appended"), micro(F.get("b.points", F.lit(0))["lat"]).alias("first_lat"))


@query(
    "w16_clipped_protrusions",
    f"{grid.WITH} SELECT node_id AS id, CAST(CASE WHEN node_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS clipped, CAST(CASE WHEN node_id % 2 = 0 THEN 4 ELSE 5 END AS BIGINT) AS points, CAST(CASE WHEN node_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS clipped_end FROM nodes",
)
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even rows go 200 m back before they come past the anchor again; odd ones go straight away from it."""
    rows = grid.nodes(spark, sf_dir)
    point = lambda y, x: F.struct((F.col("lat") + y).alias("lat"), (F.col("lng") + x).alias("lng"))
    back = F.array(point(0.0, 0.0), point(0.0, -0.002), point(0.00005, -0.002), point(0.00005, 0.003), point(0.00005, 0.006))
    ahead = F.array(point(0.0, 0.0), point(0.0, 0.001), point(0.0, 0.002), point(0.0, 0.003), point(0.0, 0.004))
    rows = rows.select(F.col("node_id").alias("id"), F.when(F.col("node_id") % 2 == 0, back).otherwise(ahead).alias("p"))
    rows = shape.clipped_end(shape.clipped_start(rows, "p", "s").withColumn("r", F.reverse("p")), "r", "e")
    return rows.select("id", F.col("s.clipped").cast("bigint").alias("clipped"), F.size("s.points").cast("bigint").alias("points"), F.col("e.clipped").cast("bigint").alias("clipped_end"))


@query("w17_remapped_turns", f"{grid.WITH}, t AS (SELECT node_id AS id, unnest(range(9)) AS i FROM nodes) SELECT id, count(*) AS turns, CAST(sum(CASE WHEN i = 0 THEN 0 ELSE i + id % 3 - id % 4 END) AS BIGINT) AS total FROM t WHERE i = 0 OR (i >= id % 4 AND i < 9 - id % 2) GROUP BY id")
def remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(F.lit("left").alias("kind"), i.alias("coordinate_index")))
    at = lambda n: F.expr(f"CAST(node_id % {n} AS INT)")
    rows = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), shape.remapped_turns(turns, at(3), at(4), at(2), F.lit(9)).alias("t"))
    return rows.select("id", F.size("t").cast("bigint").alias("turns"), F.aggregate("t", F.lit(0), lambda total, t: total + t["coordinate_index"]).cast("bigint").alias("total"))


@query(
    "w18_deviation_points",
    f"{grid.WITH} SELECT node_id AS id, CAST(node_id % 4 + 1 AS BIGINT) AS a_pos, CAST(8 - node_id % 3 AS BIGINT) AS b_pos, CAST((node_id % 4 + 1) * (node_id % 4 + 2) // 2 AS BIGINT) AS cost_s_a, CAST(CASE node_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 15 END AS BIGINT) AS cost_b_t FROM nodes WHERE node_id % 5 <> 0 UNION ALL SELECT node_id, NULL, NULL, NULL, NULL FROM nodes WHERE node_id % 5 = 0",
)
def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of nine nodes, with costs 1 to 8, that part after some nodes and meet again at the last one or a few."""
    rows = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("id"))
    own = "transform(sequence(0, 8), i -> CASE WHEN id % 5 = 0 OR i <= id % 4 + 1 OR i >= 8 - id % 3 THEN i ELSE i + 100 END)"
    found = rows.select("id", shape.deviation(F.expr(own), F.expr("transform(sequence(1, 8), i -> CAST(i AS BIGINT))"), F.expr("sequence(0, 8)")).alias("d"))
    return found.select("id", F.col("d.a_pos").cast("bigint").alias("a_pos"), F.col("d.b_pos").cast("bigint").alias("b_pos"), F.col("d.cost_s_a").alias("cost_s_a"), F.col("d.cost_b_t").alias("cost_b_t"))


@query("f03_polyline_on_ellipsoid", f"{grid.WITH}, {LINES}, k AS (SELECT *, lag(y) OVER w AS a, lag(x) OVER w AS b FROM p WINDOW w AS (PARTITION BY id ORDER BY i)), m AS (SELECT *, radians((a + y) / 2) AS f FROM k WHERE a IS NOT NULL) SELECT id, CAST(round(100 * sum(sqrt(pow(radians(y - a) * 6378137.0 * (1 - 0.00669437999014) / pow(1 - 0.00669437999014 * pow(sin(f), 2), 1.5), 2) + pow(radians(x - b) * 6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(f), 2)) * cos(f), 2)))) AS BIGINT) AS length_cm FROM m GROUP BY id")
def ellipsoid_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("id", F.round(100 * F.element_at(geo.polyline_lengths(F.col("points"), geo.ellipsoid_m), -1)).cast("bigint").alias("length_cm"))
