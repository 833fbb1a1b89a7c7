"""Nearest-neighbour and radius joins over a grid of cells; no side is broadcast or crossed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions import geo
from viaduct.session import materialize


def _cells(frame: DataFrame, cell: float) -> DataFrame:
    return frame.withColumn("cx", F.floor(F.col("lat") / cell)).withColumn("cy", F.floor(F.col("lng") / cell))


def around(points: DataFrame, items: DataFrame, cell: float, rings: int) -> DataFrame:
    """Points joined with the items of the (2 rings + 1)**2 cells around them. Items' ``lat, lng`` become ``at_lat, at_lng``."""
    ring = F.sequence(F.lit(-rings), F.lit(rings))
    spread = _cells(points, cell).withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
    spread = spread.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")
    placed = _cells(items, cell).withColumnsRenamed({"lat": "at_lat", "lng": "at_lng"})
    return spread.join(placed, ["cx", "cy"]).drop("cx", "cy")


def nearest(points: DataFrame, items: DataFrame, k: int, distance: Column, id_col: str, cell: float, per_degree: Callable[[Column], Column] | None = None, reach: float = 0.0) -> DataFrame:
    """The k nearest items of every point, exactly, with ``distance`` and ``rank`` (from 1; ties by ``id_col``).

    ``points`` has ``point_id, lat, lng``; items lie within ``reach`` degrees of their ``lat, lng``. Rings of cells are searched;
    a point is settled when its k-th distance is below everything that the rings leave out, and the others go
    on with doubled rings. ``per_degree`` gives the least distance of a degree at a latitude (default: degrees).
    """
    least = per_degree or (lambda lat: F.lit(1.0))
    box = items.agg(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng")).first()
    out, rings, left = None, 1, points
    if box[0] is None:
        return points.join(items.drop("lat", "lng"), F.lit(False)).withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(0).cast("bigint"))
    order = Window.partitionBy("point_id").orderBy("distance", id_col)
    while True:
        near = around(left, items, cell, rings).withColumn("distance", distance)
        ranked = near.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).drop("at_lat", "at_lng")
        ranked = materialize(ranked, "nearest")
        span = cell * rings - reach
        whole = (F.col("lat") - span <= box[0]) & (F.col("lat") + span >= box[1]) & (F.col("lng") - span <= box[2]) & (F.col("lng") + span >= box[3])
        settled = ranked.groupBy("point_id").agg(F.max("rank").alias("n"), F.max("distance").alias("far"), F.first("lat").alias("lat"), F.first("lng").alias("lng"))
        settled = settled.where(((F.col("n") >= k) & (F.col("far") < F.lit(max(span, 0.0)) * least(F.col("lat")))) | whole).select("point_id")
        good = ranked.join(settled, "point_id", "left_semi")
        out = good if out is None else out.unionByName(good)
        left = materialize(left.join(settled, "point_id", "left_anti"), "nearest-left")
        # points far from everything are settled once the rings cover all items
        left_over = left.where(~whole)
        if left_over.isEmpty():
            return out
        left, rings = left_over, rings * 2


def within(points: DataFrame, items: DataFrame, radius_m: float) -> DataFrame:
    """All items within the radius of each point, with ``distance`` in metres; one ring of cells as wide as the radius."""
    north = radius_m / geo.DEGREE_M
    spread = points.agg(F.max(F.abs("lat"))).first()[0]
    import math

    cell = max(north / max(math.cos(math.radians(min((spread or 0.0) + north, 89.0))), 0.01), 1e-6)
    near = around(points, items, cell, 1)
    return near.withColumn("distance", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("at_lat"), F.col("at_lng"))).where(F.col("distance") <= radius_m)


def squared_degrees() -> Column:
    x, y = F.col("at_lat") - F.col("lat"), F.col("at_lng") - F.col("lng")
    return x * x + y * y


def snap(points: DataFrame, nodes: DataFrame, arcs: DataFrame, most: int = 20, max_m: float = 2000.0, neighbours: int = 30, cell: float = 0.002) -> DataFrame:
    """``point_id, rank, arc_id, distance_m, t``: the nearest arcs that leave the ``neighbours`` nearest nodes, in degrees.

    Arcs are ranked by distance (to the millimetre) and id; ``most + 2`` are fetched, those beyond ``max_m`` go, ``most`` stay.
    """
    root = F.sqrt(squared_degrees())
    near = nearest(points, nodes.select("node_id", "lat", "lng"), neighbours, root, "node_id", cell)
    own = near.select("point_id", "lat", "lng", F.col("node_id").alias("tail")).join(arcs.select("arc_id", "tail", "tail_lat", "tail_lng", "head_lat", "head_lng"), "tail")
    hit = own.withColumn("s", geo.segment_projection(*[F.col(c) for c in ("lat", "lng", "tail_lat", "tail_lng", "head_lat", "head_lng")]))
    hit = hit.withColumn("distance_m", F.round("s.distance_m", 3))
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("distance_m", "arc_id")).cast("bigint")
    return hit.withColumn("rank", rank).where((F.col("rank") <= most + 2) & (F.col("distance_m") <= max_m)).where(F.col("rank") <= most).select("point_id", "rank", "arc_id", "distance_m", F.col("s.t").alias("t"))


def resolve_cameras(cameras: DataFrame, arcs: DataFrame, k: int = 128, max_bearing: float = 60.0, cell: float = 0.004) -> DataFrame:
    """``camera_id, arc_id, distance_m, bearing_gap``: of the k nearest arcs, those within the bearing, the one with the least distance + 2 gap."""
    half = arcs.agg(F.max(F.greatest(F.abs(F.col("tail_lat") - F.col("head_lat")), F.abs(F.col("tail_lng") - F.col("head_lng")))) / 2).first()[0] or 0.0
    items = arcs.select("arc_id", "tail_lat", "tail_lng", "head_lat", "head_lng", ((F.col("tail_lat") + F.col("head_lat")) / 2).alias("lat"), ((F.col("tail_lng") + F.col("head_lng")) / 2).alias("lng"))
    points = cameras.select(F.col("camera_id").alias("point_id"), "lat", "lng", "bearing")
    meters = F.round(geo.point_segment_m(*[F.col(c) for c in ("lat", "lng", "tail_lat", "tail_lng", "head_lat", "head_lng")]), 3)
    near = nearest(points, items, k, meters, "arc_id", cell, lambda lat: F.cos(F.radians(lat)) * 110_000.0, half)
    gap = F.round(geo.angle_gap(geo.bearing_deg(*[F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng")]), F.col("bearing")), 3)
    fit = near.withColumn("gap", gap).where(F.col("gap") <= max_bearing)
    best = F.row_number().over(Window.partitionBy("point_id").orderBy(F.col("distance") + 2 * F.col("gap"), "arc_id"))
    return fit.withColumn("best", best).where("best = 1").select(F.col("point_id").alias("camera_id"), "arc_id", F.col("distance").alias("distance_m"), F.col("gap").alias("bearing_gap"))


def choose_pair(pairs: DataFrame) -> DataFrame:
    """The best routable pair of snaps of each query: tier (0,0), then 4 x 4, then the rest; the least distance sum in the first tier that has one.

    ``pairs``: ``query_id, src_rank, dst_rank (from 0), snap_sum, cost (null: no route)``.
    """
    tier = F.when((F.col("src_rank") == 0) & (F.col("dst_rank") == 0), 1).when((F.col("src_rank") < 4) & (F.col("dst_rank") < 4), 2).otherwise(3)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "snap_sum", "src_rank", "dst_rank"))
    return pairs.where("cost is not null").withColumn("tier", tier.cast("bigint")).withColumn("n", rank).where("n = 1").drop("n")
