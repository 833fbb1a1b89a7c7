"""Queries over spatial joins and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.operators import paths, spatial
from viaduct.plans.registry import query
from viaduct.plans.scalars import HAV
from viaduct.sources import grid

POINTS = "pts AS (SELECT s_suppkey AS point_id, 20.90037::DOUBLE + (s_suppkey * 13 % 40) * 0.001::DOUBLE AS lat, 105.70013::DOUBLE + (s_suppkey * 7 % 50) * 0.001::DOUBLE AS lng FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), F.expr("20.90037D + (s_suppkey * 13 % 40) * 0.001D").alias("lat"), F.expr("105.70013D + (s_suppkey * 7 % 50) * 0.001D").alias("lng"))


@query("j16_j18_nearest_nodes", f"{grid.WITH}, {POINTS}, d AS (SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(pow(n.lat - p.lat, 2) + pow(n.lng - p.lng, 2)), node_id) AS rank FROM pts p, nodes n) SELECT * FROM d WHERE rank <= 5")
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid.nodes(spark, sf_dir).select("node_id", "lat", "lng")
    return spatial.nearest(points(spark, sf_dir), nodes, 5, F.sqrt(spatial.squared_degrees()), "node_id", 0.001).select("point_id", "node_id", "rank")


@query("j17_within_radius", f"{grid.WITH}, {POINTS} SELECT point_id, node_id, CAST(round(100 * {HAV.format(a='p.lat', b='p.lng', c='n.lat', d='n.lng')}) AS BIGINT) AS distance_cm FROM pts p, nodes n WHERE {HAV.format(a='p.lat', b='p.lng', c='n.lat', d='n.lng')} <= 250")
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.within(points(spark, sf_dir), grid.nodes(spark, sf_dir).select("node_id", "lat", "lng"), 250.0)
    return near.select("point_id", "node_id", F.round(100 * F.col("distance")).cast("bigint").alias("distance_cm"))


@query(
    "j14_r01_snap",
    f"""{grid.WITH}, {POINTS}, near AS (SELECT point_id, p.lat AS y, p.lng AS x, node_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(pow(n.lat - p.lat, 2) + pow(n.lng - p.lng, 2)), node_id) AS k FROM pts p, nodes n),
    c AS (SELECT *, cos(radians((tail_lat + head_lat) / 2)) AS s FROM near JOIN arcs ON tail = node_id WHERE k <= 30),
    u AS (SELECT *, greatest(0.0, least(1.0, ((y - tail_lat) * (head_lat - tail_lat) + (x - tail_lng) * s * (head_lng - tail_lng) * s) / ((head_lat - tail_lat) * (head_lat - tail_lat) + (head_lng - tail_lng) * s * (head_lng - tail_lng) * s))) AS t FROM c),
    d AS (SELECT point_id, arc_id, round({HAV.format(a="y", b="x", c="(tail_lat + t * (head_lat - tail_lat))", d="(tail_lng + t * (head_lng - tail_lng))")}, 3) AS m FROM u),
    r AS (SELECT point_id, arc_id, m, row_number() OVER (PARTITION BY point_id ORDER BY m, arc_id) AS rank FROM d)
    SELECT point_id, rank, arc_id, CAST(round(m * 1000) AS BIGINT) AS distance_mm FROM r WHERE rank <= 20 AND m <= 2000""",
)
def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.snap(points(spark, sf_dir), grid.nodes(spark, sf_dir), grid.arcs_with_ends(spark, sf_dir))
    return found.select("point_id", "rank", "arc_id", F.round(F.col("distance_m") * 1000).cast("bigint").alias("distance_mm"))


BEARING = "degrees(atan2(sin(radians(head_lng - tail_lng)) * cos(radians(head_lat)), cos(radians(tail_lat)) * sin(radians(head_lat)) - sin(radians(tail_lat)) * cos(radians(head_lat)) * cos(radians(head_lng - tail_lng))))"


@query(
    "j15_d17_resolve_cameras",
    f"""{grid.WITH}, {POINTS}, q AS (SELECT point_id, lat AS p, lng AS r, (point_id * 47 % 360)::DOUBLE AS bearing FROM pts),
    x AS (SELECT *, radians(tail_lng - r) * 6371000.0 * cos(radians(p)) AS ax, radians(tail_lat - p) * 6371000.0 AS ay, radians(head_lng - r) * 6371000.0 * cos(radians(p)) AS bx, radians(head_lat - p) * 6371000.0 AS yb, {BEARING} AS raw FROM q, arcs),
    y AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (yb - ay)) / ((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)))) AS t, CASE WHEN raw < 0 THEN raw + 360 ELSE raw END AS b FROM x),
    z AS (SELECT *, round(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (yb - ay), 2)), 3) AS m, round(least(abs(b - bearing), 360 - abs(b - bearing)), 3) AS gap FROM y),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, arc_id) AS n FROM z),
    f AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m + 2 * gap, arc_id) AS best FROM k WHERE n <= 128 AND gap <= 60)
    SELECT point_id AS camera_id, arc_id, CAST(round(m * 1000) AS BIGINT) AS distance_mm, CAST(round(gap * 10) AS BIGINT) AS gap_tenths FROM f WHERE best = 1""",
)
def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = points(spark, sf_dir).select(F.col("point_id").alias("camera_id"), "lat", "lng", F.expr("point_id * 47 % 360").cast("double").alias("bearing"))
    found = spatial.resolve_cameras(placed, grid.arcs_with_ends(spark, sf_dir))
    return found.select("camera_id", "arc_id", F.round(F.col("distance_m") * 1000).cast("bigint").alias("distance_mm"), F.round(F.col("bearing_gap") * 10).cast("bigint").alias("gap_tenths"))


@query("j19_snap_pairs", "WITH p AS (SELECT o_custkey AS query_id, o_orderkey % 7 AS src_rank, o_orderkey * 3 % 5 AS dst_rank, min(o_orderkey * 13 % 500) AS snap_sum, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 11 % 900 END) AS cost FROM orders GROUP BY 1, 2, 3), t AS (SELECT *, CASE WHEN src_rank = 0 AND dst_rank = 0 THEN CAST(1 AS BIGINT) WHEN src_rank < 4 AND dst_rank < 4 THEN 2 ELSE 3 END AS tier FROM p WHERE cost IS NOT NULL) SELECT query_id, src_rank, dst_rank, snap_sum, cost, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, snap_sum, src_rank, dst_rank) AS n FROM t) WHERE n = 1")
def snap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id"), F.expr("o_orderkey % 7").alias("src_rank"), F.expr("o_orderkey * 3 % 5").alias("dst_rank"))
    return spatial.choose_pair(rows.agg(F.min(F.expr("o_orderkey * 13 % 500")).alias("snap_sum"), F.max(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 11 % 900 END")).alias("cost")))


def relaxation(sources: str, weight: str = "travel_time", arcs: str = "arcs", name: str = "dist") -> str:
    """SQL of all shortest distances from the sources."""
    return f"""{name}(source, node, d) USING KEY (source, node) AS (
      SELECT source, source, CAST(0 AS BIGINT) FROM ({sources})
      UNION SELECT r.source, a.head, CAST(min(r.d + a.{weight}) AS BIGINT) FROM {name} r JOIN {arcs} a ON a.tail = r.node
      LEFT JOIN recurring.{name} p ON p.source = r.source AND p.node = a.head WHERE p.d IS NULL OR r.d + a.{weight} < p.d GROUP BY r.source, a.head)"""


ONE, FEW = "SELECT CAST(0 AS BIGINT) AS source", "SELECT DISTINCT n_nationkey * 17 AS source FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation) WHERE n_nationkey % 5 = 0"


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.arcs(spark, sf_dir).select("arc_id", "tail", "head", F.col("travel_time").alias("weight"))


def one(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("source"))


def few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.read(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select((F.col("n_nationkey").cast("bigint") * 17).alias("source")).distinct()


@query("g01_shortest_distances", f"{grid.WITH}, {relaxation(ONE)} SELECT source, node, d AS dist FROM dist")
def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also what bidirectional search and A* with any potential return (g02 to g05, g19): they only visit fewer nodes."""
    return paths.distances(weighted(spark, sf_dir), one(spark))


@query("g15_g36_distance_matrix", f"{grid.WITH}, {relaxation(FEW)} SELECT source, node, d AS dist FROM dist")
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.distances(weighted(spark, sf_dir), few(spark, sf_dir))


@query("g20_nearest_targets", f"{grid.WITH}, {relaxation(FEW)} SELECT source, node, dist, rank FROM (SELECT source, node, d AS dist, row_number() OVER (PARTITION BY source ORDER BY d, node) AS rank FROM dist WHERE node IN (SELECT s_suppkey * 13 FROM supplier)) WHERE rank <= 4")
def nearest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = grid.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 13).alias("node")).distinct()
    return paths.nearest_targets(paths.distances(weighted(spark, sf_dir), few(spark, sf_dir)), targets, 4)


@query("g37_w19_w20_rank_queries", f"{grid.WITH}, {relaxation(FEW)}, r AS (SELECT source, node, d, row_number() OVER (PARTITION BY source ORDER BY d, node) AS rank FROM dist) SELECT source, node, d AS dist, rank FROM r WHERE bit_count(rank) = 1 UNION ALL SELECT source, node, d, -1 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS n FROM r WHERE d >= 60000) WHERE n = 1")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dist = paths.distances(weighted(spark, sf_dir), few(spark, sf_dir))
    return paths.rank_nodes(dist).unionByName(paths.first_beyond(dist, 60_000).withColumn("rank", F.lit(-1).cast("bigint")))


@query("g16_r02_paths", f"{grid.WITH}, {relaxation(ONE)}, tree AS (SELECT h.node, arg_min(a.tail, a.arc_id) AS parent FROM dist t JOIN arcs a ON a.tail = t.node JOIN dist h ON h.node = a.head AND h.d = t.d + a.travel_time GROUP BY h.node), up(target, node, hops) AS (SELECT node, node, CAST(0 AS BIGINT) FROM dist UNION ALL SELECT target, parent, hops + 1 FROM up JOIN tree USING (node)) SELECT target, node, hops AS hops_to_target FROM up")
def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = weighted(spark, sf_dir)
    dist = paths.distances(arcs, one(spark))
    return paths.unpack(dist, paths.parents(dist, arcs)).select("target", "node", "hops_to_target")


@query("g21_a26_weak_components", f"{grid.WITH}, b AS (SELECT tail AS u, head AS v FROM arcs UNION SELECT head, tail FROM arcs), c(node, root) USING KEY (node) AS (SELECT u, min(u) FROM b GROUP BY u UNION SELECT b.v, min(c.root) FROM c JOIN b ON b.u = c.node LEFT JOIN recurring.c p ON p.node = b.v WHERE c.root < p.root GROUP BY b.v) SELECT node, root FROM c")
def weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.weak_components(grid.arcs(spark, sf_dir).select("tail", "head"))


@query("g22_strong_components")
def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and arcs, two thirds of the nodes without their arcs to lesser ids; reach in SQL would be all pairs."""
    arcs = grid.arcs(spark, sf_dir).where("head > tail OR tail % 3 = 0").select("tail", "head")
    return strong_roots(paths.strong_components(arcs, grid.nodes(spark, sf_dir)))


def strong_roots(found: DataFrame) -> DataFrame:
    least = F.min("node").over(Window.partitionBy("root"))
    return found.select("node", least.alias("root"))


@query("a32_triangles", f"{grid.WITH}, e AS (SELECT DISTINCT least(tail, head) AS a, greatest(tail, head) AS b FROM (SELECT tail, head FROM arcs UNION ALL SELECT tail, head + 1 FROM arcs WHERE head % 50 < 49)) SELECT x.a, x.b, count(*) AS triangles FROM e x JOIN e y ON x.a = y.a JOIN e z ON z.b = y.b AND z.a = x.b WHERE y.b > x.b GROUP BY x.a, x.b")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir).select("tail", "head")
    e = arcs.union(arcs.where("head % 50 < 49").select("tail", F.col("head") + 1)).select(F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b")).distinct()
    wedge = e.join(e.select("a", F.col("b").alias("c")), "a").where("c > b")
    return wedge.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("triangles"))
