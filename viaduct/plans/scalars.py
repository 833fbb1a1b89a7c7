"""Queries over the scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import geo, traffic
from viaduct.plans.registry import query
from viaduct.sources import grid

RAD = "3.141592653589793 / 180"
HAV = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"
ENDS = {"a": "tail_lat", "b": "tail_lng", "c": "head_lat", "d": "head_lng"}


def milli(x):
    """Thousandths as an integer, so that two engines agree."""
    return F.round(x * 1000).cast("bigint")


@query(
    "f01_f04_distances",
    f"""{grid.WITH} SELECT arc_id, CAST(round(1000 * {HAV.format(**ENDS)}) AS BIGINT) AS haversine_mm,
    CAST(round(1000 * 6371000.785 * acos(greatest(-1.0, least(1.0, sin(radians(tail_lat)) * sin(radians(head_lat)) + cos(radians(tail_lat)) * cos(radians(head_lat)) * cos(radians(tail_lng - head_lng)))))) / 100 AS BIGINT) AS spherical_dm,
    CAST(round(10 * CASE WHEN x < 0 THEN x + 360 ELSE x END) AS BIGINT) AS bearing_tenths
    FROM (SELECT *, degrees(atan2(sin(radians(head_lng - tail_lng)) * cos(radians(head_lat)), cos(radians(tail_lat)) * sin(radians(head_lat)) - sin(radians(tail_lat)) * cos(radians(head_lat)) * cos(radians(head_lng - tail_lng)))) AS x FROM arcs)""",
)
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng")]
    return grid.arcs_with_ends(spark, sf_dir).select(
        "arc_id",
        milli(geo.haversine_m(*ends)).alias("haversine_mm"),
        F.rint(F.round(1000 * geo.spherical_m(*ends)) / 100).cast("bigint").alias("spherical_dm"),  # SQL casts halves to even
        F.round(10 * geo.bearing_deg(*ends)).cast("bigint").alias("bearing_tenths"),
    )


@query(
    "f03_ellipsoid_distance",
    f"""{grid.WITH} SELECT arc_id, CAST(round(1000 * sqrt(n * n + e * e)) AS BIGINT) AS ellipsoid_mm FROM (
    SELECT arc_id, radians(head_lat - tail_lat) * (6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE)) / (w * sqrt(w)) AS n, radians(head_lng - tail_lng) * 6378137.0::DOUBLE / sqrt(w) * cos(m) AS e
    FROM (SELECT *, 1 - 0.00669437999014::DOUBLE * sin(m) * sin(m) AS w FROM (SELECT *, radians((tail_lat + head_lat) / 2) AS m FROM arcs)))""",
)
def ellipsoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng")]
    return grid.arcs_with_ends(spark, sf_dir).select("arc_id", milli(geo.ellipsoid_m(*ends)).alias("ellipsoid_mm"))


@query(
    "f05_f07_circular",
    """SELECT o_orderkey, a - floor(a / 360) * 360 AS wrapped, least(d, 360 - d) AS gap, h - floor(h / 24) * 24 AS hour, least(g, 24 - g) AS hour_gap FROM (
    SELECT *, abs((a - floor(a / 360) * 360) - (b - floor(b / 360) * 360)) AS d, abs((h - floor(h / 24) * 24) - (k - floor(k / 24) * 24)) AS g FROM (
    SELECT o_orderkey, (o_orderkey * 37 % 1440 - 720)::DOUBLE AS a, (o_custkey * 53 % 1440 - 720)::DOUBLE AS b, (o_orderkey % 96 - 48) / 2.0::DOUBLE AS h, (o_custkey % 96 - 48) / 2.0::DOUBLE AS k FROM orders))""",
)
def circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.expr(x).cast("double") for x in ("o_orderkey * 37 % 1440 - 720", "o_custkey * 53 % 1440 - 720"))
    h, k = F.expr("(o_orderkey % 96 - 48) / 2.0D"), F.expr("(o_custkey % 96 - 48) / 2.0D")
    return grid.read(spark, sf_dir, "orders").select("o_orderkey", geo.wrap_degrees(a).alias("wrapped"), geo.angle_gap(a, b).alias("gap"), traffic.wrap_hour(h).alias("hour"), traffic.hour_gap(h, k).alias("hour_gap"))


POINT = "(tail_lat + ((arc_id * 7) % 21 - 10) * 0.0001::DOUBLE)", "(tail_lng + ((arc_id * 11) % 21 - 10) * 0.0001::DOUBLE)"


@query(
    "f08_f10_point_to_segment",
    f"""{grid.WITH}, q AS (SELECT *, {POINT[0]} AS p, {POINT[1]} AS r FROM arcs),
    x AS (SELECT *, radians(tail_lng - r) * 6371000.0 * cos(radians(p)) AS ax, radians(tail_lat - p) * 6371000.0 AS ay, radians(head_lng - r) * 6371000.0 * cos(radians(p)) AS bx, radians(head_lat - p) * 6371000.0 AS yb FROM q),
    y AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (yb - ay)) / ((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)))) AS t,
      cos(radians((tail_lat + head_lat) / 2)) AS s FROM x),
    z AS (SELECT *, greatest(0.0, least(1.0, ((p - tail_lat) * (head_lat - tail_lat) + (r - tail_lng) * s * (head_lng - tail_lng) * s) / ((head_lat - tail_lat) * (head_lat - tail_lat) + (head_lng - tail_lng) * s * (head_lng - tail_lng) * s))) AS u,
      greatest(0.0, least(1.0, ((p - tail_lat) * (head_lat - tail_lat) + (r - tail_lng) * (head_lng - tail_lng)) / ((head_lat - tail_lat) * (head_lat - tail_lat) + (head_lng - tail_lng) * (head_lng - tail_lng)))) AS v FROM y)
    SELECT arc_id, CAST(round(100 * sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (yb - ay), 2))) AS BIGINT) AS plane_cm, CAST(round(u * 10000) AS BIGINT) AS t_scaled,
      CAST(round(100 * {HAV.format(a="p", b="r", c="(tail_lat + u * (head_lat - tail_lat))", d="(tail_lng + u * (head_lng - tail_lng))")}) AS BIGINT) AS scaled_cm, CAST(round(v * 10000) AS BIGINT) AS t_flat FROM z""",
)
def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.arcs_with_ends(spark, sf_dir)
    p, r = F.expr("tail_lat + ((arc_id * 7) % 21 - 10) * 0.0001D"), F.expr("tail_lng + ((arc_id * 11) % 21 - 10) * 0.0001D")
    ends = [F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng")]
    rows = rows.select("arc_id", geo.point_segment_m(p, r, *ends).alias("plane"), geo.segment_projection(p, r, *ends).alias("s"), geo.flat_projection(p, r, *ends).alias("f"))
    cm, parts = (lambda x: F.round(100 * x).cast("bigint")), (lambda x: F.round(x * 10000).cast("bigint"))
    return rows.select("arc_id", cm(F.col("plane")).alias("plane_cm"), parts(F.col("s.t")).alias("t_scaled"), cm(F.col("s.distance_m")).alias("scaled_cm"), parts(F.col("f.t")).alias("t_flat"))


@query(
    "f11_f12_polyline",
    f"""{grid.WITH}, p AS (SELECT node_id, lat, lng, node_id // 50 AS line, node_id % 50 AS pos FROM nodes),
    l AS (SELECT line, sum(CASE WHEN pos > 0 THEN {HAV.format(a="lag_lat", b="lag_lng", c="lat", d="lng")} ELSE 0 END) AS m, count(*) AS n FROM (SELECT *, lag(lat) OVER w AS lag_lat, lag(lng) OVER w AS lag_lng FROM p WINDOW w AS (PARTITION BY line ORDER BY pos)) GROUP BY line),
    s AS (SELECT a.line, a.pos, {HAV.format(a="(a.lat + 0.0004::DOUBLE)", b="(105.7::DOUBLE + 0.0123::DOUBLE)", c="a.lat", d="greatest(a.lng, least(b.lng, 105.7::DOUBLE + 0.0123::DOUBLE))")} AS d FROM p a JOIN p b ON a.line = b.line AND b.pos = a.pos + 1)
    SELECT l.line, l.n AS points, CAST(round(l.m * 100) AS BIGINT) AS length_cm, CAST(min(round(s.d * 100)) AS BIGINT) AS nearest_cm FROM l JOIN s ON l.line = s.line GROUP BY l.line, l.n, l.m""",
)
def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid.nodes(spark, sf_dir).select(F.expr("node_id div 50").alias("line"), F.expr("node_id % 50").alias("pos"), "lat", "lng")
    lines = p.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lng"))).alias("points")).where(F.size("points") > 1)
    nearest = geo.polyline_projection(F.get("points", F.lit(0))["lat"] + 0.0004, F.lit(105.7) + F.lit(0.0123), F.col("points"))
    rows = lines.select("line", F.size("points").cast("bigint").alias("n"), F.element_at(geo.polyline_lengths(F.col("points")), -1).alias("m"), nearest.alias("near"))
    return rows.select("line", F.col("n").alias("points"), F.round(F.col("m") * 100).cast("bigint").alias("length_cm"), F.round(F.col("near.distance_m") * 100).cast("bigint").alias("nearest_cm"))


@query(
    "f13_f14_partial_costs",
    f"""{grid.WITH}, x AS (SELECT *, (arc_id * 13) % 120 AS pos, (arc_id * 29) % 120 AS pos2 FROM arcs)
    SELECT arc_id, CASE WHEN pos = 0 THEN 0 ELSE CAST(floor(travel_time * least(1.0::DOUBLE, pos / geo_distance::DOUBLE) + 0.5) AS BIGINT) END AS to_tail,
    CASE WHEN geo_distance - pos <= 0 THEN 0 ELSE CAST(floor(travel_time * ((geo_distance - pos) / geo_distance::DOUBLE) + 0.5) AS BIGINT) END AS to_head,
    CASE WHEN pos2 < pos THEN NULL WHEN pos2 = pos THEN 0 ELSE CAST(floor(travel_time * least(1.0::DOUBLE, (pos2 - pos) / geo_distance::DOUBLE) + 0.5) AS BIGINT) END AS between FROM x""",
)
def partial_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.arcs(spark, sf_dir).selectExpr("*", "(arc_id * 13) % 120 AS pos", "(arc_id * 29) % 120 AS pos2")
    cost = lambda part: geo.partial_cost(F.col("travel_time"), part.cast("double"), F.col("geo_distance").cast("double"))
    return rows.select("arc_id", cost(F.col("pos")).alias("to_tail"), cost(F.col("geo_distance") - F.col("pos")).alias("to_head"), F.when(F.col("pos2") >= F.col("pos"), cost(F.col("pos2") - F.col("pos"))).alias("between"))


TURNS = f"""{grid.WITH}, t AS (SELECT a.arc_id AS from_arc, b.arc_id AS to_arc, (a.head_lng - a.tail_lng) * cos(radians(a.head_lat)) AS ax, a.head_lat - a.tail_lat AS ay,
  (b.head_lng - b.tail_lng) * cos(radians(a.head_lat)) AS bx, b.head_lat - b.tail_lat AS yb FROM arcs a JOIN arcs b ON a.head = b.tail),
  u AS (SELECT *, ax * yb - ay * bx AS c, degrees(atan2(ax * yb - ay * bx, ax * bx + ay * yb)) AS g FROM t)"""


@query(
    "f15_f19_turn_classes",
    TURNS
    + """ SELECT from_arc, to_arc, CAST(round(g) AS BIGINT) AS angle,
    CASE WHEN abs(g) < 20 THEN 'straight' WHEN abs(g) < 40 THEN CASE WHEN c > 0 THEN 'slight_left' ELSE 'slight_right' END WHEN abs(g) < 110 THEN CASE WHEN c > 0 THEN 'left' ELSE 'right' END
      WHEN abs(g) < 155 THEN CASE WHEN c > 0 THEN 'sharp_left' ELSE 'sharp_right' END WHEN c >= 0 THEN 'u_turn' ELSE 'sharp_right' END AS turn,
    CASE WHEN abs(g) < 25 THEN 'straight' WHEN abs(g) >= 155 THEN 'u_turn' WHEN g > 0 THEN 'left' ELSE 'right' END AS wide,
    CASE WHEN abs(g) < 30 THEN 'exit_straight' WHEN abs(g) >= 135 THEN 'exit_u_turn' WHEN g > 0 THEN 'exit_left' ELSE 'exit_right' END AS roundabout,
    (g > 45 AND g < 135) AS fits_left, (g < -45 AND g > -135) AS fits_right FROM u WHERE abs(g) < 170""",
)
def turn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grid.arcs_with_ends(spark, sf_dir)
    b = a.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("via"), F.col("head_lat").alias("b_lat"), F.col("head_lng").alias("b_lng"))
    t = a.join(b, F.col("head") == F.col("via")).withColumn("t", geo.turn_angle(*[F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng", "b_lat", "b_lng")]))
    angle, cross = F.col("t.angle_deg"), F.col("t.cross")
    return t.where(F.abs(angle) < 170).select(F.col("arc_id").alias("from_arc"), "to_arc", F.round(angle).cast("bigint").alias("angle"), geo.turn_class(angle, cross).alias("turn"), geo.turn_class_wide(angle).alias("wide"), geo.roundabout_exit(angle).alias("roundabout"), geo.direction_matches(angle, F.lit("left_turn")).alias("fits_left"), geo.direction_matches(angle, F.lit("right_turn")).alias("fits_right"))


GAP = "least(abs({h} - {c}), 24 - abs({h} - {c}))"
G = lambda c, s: f"exp(-0.5 * pow({GAP.format(h='h', c=c)} / {s}, 2))"


@query(
    "f20_f25_profiles",
    f"""WITH h AS (SELECT n_nationkey, (n_nationkey * 0.96)::DOUBLE AS h FROM nation),
    w AS (SELECT *, {G(8, 1.2)} AS w1, {G(17.5, 1.2)} AS w2, h / 24 * 2 * pi() AS th FROM h),
    s AS (SELECT *, 50 + (20 - 50) * w1 AS s1, 0.1 + (0.6 - 0.1) * w1 AS o1, greatest(0.0, 1 - greatest(w1, w2)) AS rest FROM w),
    e AS (SELECT *, (s1 + (15 - s1) * w2) * (1 + (0.012 * sin(th * 3 + 0.4) + 0.006 * sin(th * 7 - 1.1)) * rest) AS kmh, least(1.0, greatest(0.0, o1 + (0.7 - o1) * w2 + (0.012 * sin(th * 2 - 0.8) + 0.004 * sin(th * 5 + 0.6)) * rest)) AS occ FROM s)
    SELECT n_nationkey, CAST(round(kmh * 10000) AS BIGINT) AS kmh, CAST(round(occ * 10000) AS BIGINT) AS occupancy, CAST(round((1 + 0.5 * (occ - 0.2)) * 10000) AS BIGINT) AS factor,
    CAST(round((1 + 0.35 * {G(7.5, 1.2)} + 0.45 * {G(17.5, 1.5)} - 0.15 * {G(2, 2.0)}) * 10000) AS BIGINT) AS time_of_day FROM e""",
)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = grid.read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * F.lit(0.96)).alias("h"))
    peaks = F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(s).alias("kmh"), F.lit(o).alias("occupancy")) for h, s, o in ((8.0, 20.0, 0.6), (17.5, 15.0, 0.7))])
    rows = hours.select("n_nationkey", "h", traffic.profile_speed(F.lit(50.0), F.lit(0.1), peaks, F.col("h")).alias("p"))
    parts = lambda x: F.round(x * 10000).cast("bigint")
    return rows.select("n_nationkey", parts(F.col("p.kmh")).alias("kmh"), parts(F.col("p.occupancy")).alias("occupancy"), parts(traffic.occupancy_factor(F.col("p.occupancy"))).alias("factor"), parts(traffic.time_of_day_factor(F.col("h"))).alias("time_of_day"))


@query(
    "f26_f29_weights",
    f"""{grid.WITH} SELECT arc_id, CASE highway WHEN 'primary' THEN 0.85::DOUBLE WHEN 'secondary' THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END AS scale, greatest(1, ((geo_distance * 18000) // kmh) // 5) AS travel_ms, (geo_distance * 3600) // kmh AS live_ms,
    least(2147483646, greatest(1, travel_time * 1000000)) AS clamped, least(2147483646, travel_time + 2147480000) AS added, highway <> 'residential' AS major FROM (SELECT *, 5 + arc_id % 60 AS kmh FROM arcs)""",
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.arcs(spark, sf_dir).selectExpr("*", "5 + arc_id % 60 AS kmh")
    return rows.select(
        "arc_id",
        traffic.congestion_scale(F.col("highway")).alias("scale"),
        traffic.arc_travel_time(F.col("geo_distance"), F.col("kmh")).alias("travel_ms"),
        traffic.live_travel_time(F.col("geo_distance"), F.col("kmh")).alias("live_ms"),
        traffic.clamp_weight(F.col("travel_time") * 1_000_000).alias("clamped"),
        traffic.safe_add(F.col("travel_time"), F.lit(2147480000).cast("bigint")).alias("added"),
        traffic.is_major(F.concat("highway", F.lit("_link"))).alias("major"),
    )


@query("f42_search_text", "SELECT doc_id, length(text) AS n, sha256(replace(lower(strip_accents(text)), 'ß', 'ss')) AS folded FROM documents")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all rows, as digests."""
    from viaduct.functions.text import fold

    docs = grid.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n"), F.sha2(F.encode(fold(F.col("text")), "utf-8"), 256).alias("folded"))


@query(
    "f43_f48_traffic_classes",
    f"""{grid.WITH} SELECT arc_id, CASE WHEN now >= 2147483647 THEN 'red' WHEN base = 0 THEN 'green' WHEN now / base::DOUBLE <= 1.15 THEN 'green' WHEN now / base::DOUBLE <= 1.6 THEN 'yellow' ELSE 'red' END AS status,
    CAST(round(geo_distance * 3600.0 / travel_time * 1000) AS BIGINT) AS kmh, CAST(floor(head_lat / 0.005::DOUBLE) AS BIGINT) AS cell FROM (SELECT *, CASE WHEN arc_id % 11 = 0 THEN 0 ELSE travel_time END AS base, CASE WHEN arc_id % 13 = 0 THEN 2147483647 ELSE travel_time * (100 + arc_id % 97) // 100 END AS now FROM arcs)""",
)
def traffic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.arcs_with_ends(spark, sf_dir).selectExpr("*", "CASE WHEN arc_id % 11 = 0 THEN 0 ELSE travel_time END AS base", "CASE WHEN arc_id % 13 = 0 THEN 2147483647 ELSE travel_time * (100 + arc_id % 97) div 100 END AS now")
    return rows.select("arc_id", traffic.traffic_class(F.col("base"), F.col("now")).alias("status"), milli(traffic.speed_kmh(F.col("geo_distance"), F.col("travel_time"))).alias("kmh"), geo.grid_cell(F.col("head_lat"), 0.005).alias("cell"))


@query(
    "f46_p07_coordinate_checks",
    f"""{grid.WITH}, b AS (SELECT min(lat) AS a, max(lat) AS c, min(lng) AS d, max(lng) AS e FROM nodes),
    q AS (SELECT c_custkey AS id, 20.9::DOUBLE + (c_custkey % 400 - 100) * 0.0005::DOUBLE AS lat, CASE WHEN c_custkey % 17 = 0 THEN 190.0::DOUBLE ELSE 105.7::DOUBLE + (c_custkey % 300 - 100) * 0.0005::DOUBLE END AS lng FROM customer)
    SELECT id, CASE WHEN abs(lat) > 90 OR abs(lng) > 180 THEN 'invalid_range' WHEN NOT (lat BETWEEN a - 1500 / 111320.0::DOUBLE AND c + 1500 / 111320.0::DOUBLE AND lng BETWEEN d - 1500 / (111320.0::DOUBLE * cos(radians((a + c) / 2))) AND e + 1500 / (111320.0::DOUBLE * cos(radians((a + c) / 2)))) THEN 'out_of_bounds' END AS reason FROM q, b""",
)
def coordinate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators.filters import rejection

    box = grid.nodes(spark, sf_dir).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))
    points = grid.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("20.9D + (c_custkey % 400 - 100) * 0.0005D").alias("lat"), F.expr("CASE WHEN c_custkey % 17 = 0 THEN 190.0D ELSE 105.7D + (c_custkey % 300 - 100) * 0.0005D END").alias("lng"))
    # the box is one row
    return points.join(F.broadcast(box)).select("id", rejection(F.col("lat"), F.col("lng"), {c: F.col(c) for c in ("min_lat", "max_lat", "min_lng", "max_lng")}).alias("reason"))


@query("f50_f51_percentiles", "SELECT o_custkey, list_extract(list_sort(list(v)), 1 + CAST(floor(0.95::DOUBLE * (count(*) - 1) + 0.5) AS INTEGER)) AS p95, max(v) AS most, CASE WHEN max(v) >= 1000000 THEN printf('%.2f s', max(v) / 1e6) WHEN max(v) >= 1000 THEN printf('%.2f ms', max(v) / 1e3) ELSE printf('%d us', max(v)) END AS shown FROM (SELECT o_custkey, o_orderkey * 64 AS v FROM orders) GROUP BY o_custkey")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "orders").select("o_custkey", F.expr("o_orderkey * 64").alias("v")).groupBy("o_custkey").agg(F.collect_list("v").alias("all"), F.max("v").alias("most"))
    return rows.select("o_custkey", traffic.nearest_rank(F.col("all"), 0.95).alias("p95"), "most", traffic.duration_text(F.col("most")).alias("shown"))


@query("f52_point_dedup", f"{grid.WITH} SELECT line, 2 * count(*) - 1 AS before, count(*) AS after FROM (SELECT node_id // 50 AS line FROM nodes) GROUP BY line")
def point_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grid.nodes(spark, sf_dir).select(F.expr("node_id div 50").alias("line"), F.expr("node_id % 50").alias("pos"), "lat", "lng")
    both = p.select("line", (F.col("pos") * 2).alias("pos"), "lat", "lng").union(p.where("pos > 0").select("line", F.col("pos") * 2 - 1, "lat", F.col("lng") - 0.000001))
    lines = both.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lng"))).alias("points"))
    return lines.select("line", F.size("points").cast("bigint").alias("before"), F.size(geo.drop_close_points(F.col("points"))).cast("bigint").alias("after"))


@query(
    "p05_p06_viewport",
    f"""{grid.WITH} SELECT arc_id FROM arcs WHERE greatest(tail_lat, head_lat) >= 20.9025::DOUBLE AND least(tail_lat, head_lat) <= 20.9105::DOUBLE AND greatest(tail_lng, head_lng) >= 105.7105::DOUBLE AND least(tail_lng, head_lng) <= 105.7255::DOUBLE""",
)
def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators.filters import in_viewport

    return in_viewport(grid.arcs_with_ends(spark, sf_dir), 20.9025, 20.9105, 105.7105, 105.7255).select("arc_id")


@query("p11_p18_metric_checks", f"{grid.WITH} SELECT count(*) AS arcs, min(CASE WHEN arc_id % 41 = 0 THEN arc_id END) AS first_offender, count(*) FILTER (arc_id % 41 <> 0) AS usable FROM arcs")
def metric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators.filters import metric_report

    metric = grid.arcs(spark, sf_dir).select("arc_id", F.expr("CASE WHEN arc_id % 41 = 0 THEN 3000000000 ELSE travel_time END").alias("weight"))
    return metric_report(metric)
