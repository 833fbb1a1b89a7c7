"""Queries over turn refinement, travel-time functions, live weights and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import traffic
from viaduct.operators import timed, turns
from viaduct.plans.registry import query
from viaduct.plans.relational import LG, cameras, lg
from viaduct.plans.scalars import TURNS
from viaduct.sources import grid

BASE = """t AS (SELECT l_orderkey AS route_id, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_partkey * 37 % 361 - 180 AS DOUBLE) AS a, CAST(l_linenumber * 40 + l_partkey % 30 AS DOUBLE) AS at_m, l_suppkey % 4 + 1 AS degree, l_partkey % 5 = 0 AS roundabout FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
  turns AS (SELECT route_id, pos, CASE WHEN abs(a) < 20 OR pos % 3 = 0 THEN 'straight' WHEN a > 0 THEN 'left' ELSE 'right' END AS direction, a AS angle, at_m, degree, roundabout FROM t)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grid.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    rows = lines.selectExpr(
        "l_orderkey AS route_id", "CAST(l_linenumber AS BIGINT) AS pos", "CAST(l_partkey * 37 % 361 - 180 AS DOUBLE) AS angle",
        "CAST(l_linenumber * 40 + l_partkey % 30 AS DOUBLE) AS at_m", "l_suppkey % 4 + 1 AS degree", "l_partkey % 5 = 0 AS roundabout",
    )
    kind = F.when((F.abs("angle") < 20) | (F.col("pos") % 3 == 0), "straight").when(F.col("angle") > 0, "left").otherwise("right")
    return rows.withColumn("direction", kind).select(*turns.FIELDS)


MERGED = """b AS (SELECT * FROM turns WHERE NOT (degree = 2 AND abs(angle) < 40)),
  i AS (SELECT *, sum(f) OVER (PARTITION BY route_id ORDER BY pos) AS g FROM (SELECT *, CASE WHEN direction = 'straight' AND lag(direction) OVER (PARTITION BY route_id ORDER BY pos) = 'straight' THEN 0 ELSE 1 END AS f FROM b)),
  m AS (SELECT route_id, min(pos) AS pos, min(direction) AS direction, sum(angle) AS angle, arg_min(at_m, pos) AS at_m, arg_min(degree, pos) AS degree, arg_min(roundabout, pos) AS roundabout FROM i GROUP BY route_id, g)"""


@query("w05_w06_merge_straights", f"WITH {BASE}, {MERGED} SELECT * FROM m")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.merge_straights(turns.drop_bends(base(spark, sf_dir)))


ROUND = """j AS (SELECT *, sum(f) OVER (PARTITION BY route_id ORDER BY pos) AS g FROM (SELECT *, CASE WHEN roundabout AND lag(roundabout) OVER (PARTITION BY route_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM m)),
  k AS (SELECT route_id, g, min(pos) AS p1, arg_min(angle, pos) AS a1, arg_min(at_m, pos) AS m1, arg_min(degree, pos) AS d1, max(pos) AS p2, arg_max(at_m, pos) AS m2, arg_max(degree, pos) AS d2, sum(angle) AS net, count(*) AS n FROM j WHERE roundabout GROUP BY route_id, g),
  c AS (SELECT route_id, pos, direction, angle, at_m, degree, roundabout FROM m WHERE NOT roundabout UNION ALL SELECT route_id, p1, 'roundabout_enter', a1, m1, d1, TRUE FROM k
    UNION ALL SELECT route_id, p2, CASE WHEN abs(net) < 30 THEN 'exit_straight' WHEN abs(net) >= 135 THEN 'exit_u_turn' WHEN net > 0 THEN 'exit_left' ELSE 'exit_right' END, net, m2, d2, TRUE FROM k WHERE n > 1)"""


@query("w07_roundabouts", f"WITH {BASE}, {MERGED}, {ROUND} SELECT * FROM c")
def roundabouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.collapse_roundabouts(merged(spark, sf_dir))


STRIP = """s AS (SELECT *, coalesce(lead(at_m) OVER w, 400.0::DOUBLE) - CASE WHEN row_number() OVER w = 1 THEN 0.0::DOUBLE ELSE at_m END AS to_next_m, sum(CASE WHEN direction = 'straight' THEN 0 ELSE 1 END) OVER w AS g FROM c WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
  v AS (SELECT route_id, min(pos) AS pos, arg_min(direction, pos) AS direction, CASE WHEN g = 0 THEN sum(angle) ELSE arg_min(angle, pos) END AS angle, CASE WHEN g = 0 THEN max(at_m) ELSE arg_min(at_m, pos) END AS at_m, arg_min(degree, pos) AS degree, arg_min(roundabout, pos) AS roundabout, sum(to_next_m) AS to_next_m FROM s GROUP BY route_id, g)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id")).distinct().withColumn("length_m", F.lit(400.0))


@query("w08_w09_strip_straights", f"WITH {BASE}, {MERGED}, {ROUND}, {STRIP} SELECT * FROM v")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.strip_straights(turns.with_distances(roundabouts(spark, sf_dir), lengths(spark, sf_dir)))


@query("w10_w11_refine_turns")
def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.refine(base(spark, sf_dir), lengths(spark, sf_dir))


@query(
    "w12_slight_turns",
    TURNS
    + """, deg AS (SELECT tail, count(*) AS degree FROM arcs GROUP BY tail), w AS (SELECT from_arc, to_arc, CAST(round(g, 6) AS DOUBLE) AS angle, a.head AS via, degree FROM u JOIN arcs a ON a.arc_id = from_arc JOIN deg ON deg.tail = a.head WHERE abs(g) < 30),
    o AS (SELECT w.from_arc, w.to_arc, w.angle, x.g AS other, x.to_arc AS other_arc FROM w JOIN u x ON x.from_arc = w.from_arc AND x.to_arc <> w.to_arc),
    n AS (SELECT from_arc, to_arc, min(abs(angle - other)) AS gap FROM o GROUP BY from_arc, to_arc) SELECT w.from_arc, w.to_arc, CASE WHEN degree < 3 OR gap >= 20 OR gap IS NULL THEN 'straight' ELSE 'slight' END AS kind FROM w LEFT JOIN n USING (from_arc, to_arc)""",
)
def slight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.functions import geo

    arcs = grid.arcs_with_ends(spark, sf_dir)
    degree = arcs.groupBy(F.col("tail").alias("via")).agg(F.count("*").alias("degree"))
    b = arcs.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("via"), F.col("head_lat").alias("b_lat"), F.col("head_lng").alias("b_lng"))
    pairs = arcs.select(F.col("arc_id").alias("from_arc"), "tail_lat", "tail_lng", F.col("head").alias("via"), F.col("head_lat").alias("via_lat"), F.col("head_lng").alias("via_lng")).join(b, "via").join(degree, "via")
    angle = geo.turn_angle(*[F.col(c) for c in ("tail_lat", "tail_lng", "via_lat", "via_lng", "b_lat", "b_lng")])
    rows = pairs.withColumn("t", angle).where(F.abs("t.angle_deg") < 30).withColumn("angle", F.round("t.angle_deg", 6)).withColumn("direction", F.lit("straight")).drop("t", "b_lat", "b_lng")
    found = turns.resolve_slight(rows, arcs)
    return found.select("from_arc", "to_arc", F.regexp_replace("direction", "_.*$", "").alias("kind"))


STEP = 14_400_000
TTF = f"""f AS (SELECT arc_id, i * CAST({STEP} AS BIGINT) AS dt, travel_time * (100 + arc_id * (i + 1) % 50) // 100 AS tt, i FROM arcs, (SELECT CAST(range AS BIGINT) AS i FROM range(6)) AS r)"""


def ttfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with ``ttf``, six breakpoints a day."""
    step = F.expr(f"transform(sequence(0L, 5L), i -> named_struct('dt', i * {STEP}L, 'tt', travel_time * (100 + arc_id * (i + 1) % 50) div 100))")
    return grid.arcs(spark, sf_dir).select("arc_id", "tail", "head", "travel_time", step.alias("ttf"))


AT = "(arc_id * 7919 * 1009) % 86400000"


@query("j30_d01_evaluate", f"{grid.WITH}, {TTF}, q AS (SELECT arc_id, {AT} AS t FROM arcs) SELECT q.arc_id, a.tt + CAST(floor((b.tt - a.tt) * (t - a.dt) / {STEP}::DOUBLE) AS BIGINT) AS tt FROM q JOIN f a ON a.arc_id = q.arc_id AND a.i = t // {STEP} JOIN f b ON b.arc_id = q.arc_id AND b.i = (t // {STEP} + 1) % 6")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttfs(spark, sf_dir).select("arc_id", timed.evaluate(F.col("ttf"), F.expr(AT)).alias("tt"))


@query("a15_a18_a19_ttf_bounds", f"{grid.WITH}, {TTF}, s AS (SELECT a.arc_id, a.tt, CAST(floor(1000 * (b.tt - a.tt) / {STEP}::DOUBLE) AS BIGINT) AS slope FROM f a JOIN f b ON a.arc_id = b.arc_id AND b.i = (a.i + 1) % 6) SELECT arc_id, min(tt) AS low, max(tt) AS high, min(slope) AS least_slope, max(slope) AS most_slope, count(*) AS points, min(tt) = max(tt) AS constant FROM s GROUP BY arc_id")
def ttf_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    (low, high), (least, most) = timed.bounds(F.col("ttf")), timed.slopes(F.col("ttf"))
    return ttfs(spark, sf_dir).select("arc_id", low.alias("low"), high.alias("high"), least.alias("least_slope"), most.alias("most_slope"), F.size("ttf").cast("bigint").alias("points"), (low == high).alias("constant"))


A, B = 20_000_000, 50_000_000


def _at(t: int, name: str) -> str:
    i = t // STEP
    return f"(SELECT a.arc_id, a.tt + CAST(floor((b.tt - a.tt) * {t - i * STEP} / {STEP}::DOUBLE) AS BIGINT) AS {name} FROM f a JOIN f b ON a.arc_id = b.arc_id AND a.i = {i} AND b.i = {i + 1})"


@query("a16_a17_ttf_ranges", f"{grid.WITH}, {TTF}, x AS (SELECT * FROM {_at(A, 'u')} JOIN {_at(B, 'v')} USING (arc_id)), m AS (SELECT arc_id, max(tt) FILTER (i = 2) AS p, max(tt) FILTER (i = 3) AS q FROM f GROUP BY arc_id) SELECT arc_id, least(u, v, p, q) AS low, greatest(u, v, p, q) AS high, ((u + p) * {2 * STEP - A} + (p + q) * {STEP} + (q + v) * {B - 3 * STEP}) // {2 * (B - A)} AS mean FROM x JOIN m USING (arc_id)")
def ttf_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.lit(A).cast("bigint"), F.lit(B).cast("bigint")
    inside = timed.points_in_range(F.col("ttf"), start, end)
    return ttfs(spark, sf_dir).select("arc_id", F.array_min(inside).alias("low"), F.array_max(inside).alias("high"), timed.average(F.col("ttf"), start, end).alias("mean"))


@query("d03_d05_live_blend", f"{grid.WITH}, x AS (SELECT arc_id, travel_time AS p, CASE WHEN arc_id % 3 = 0 THEN travel_time * 3 END AS l, 1000 * (arc_id % 10) AS u, 3000 + (arc_id * 17) % 5000 AS t FROM arcs) SELECT arc_id, CASE WHEN l IS NULL THEN p WHEN t < u THEN l ELSE greatest(p, l - (t - u)) END AS blended, CASE WHEN l IS NULL THEN p WHEN t < u THEN greatest(p, least(l, p + u - t)) ELSE p END AS pessimistic, coalesce(l > p, FALSE) AS slower FROM x")
def live_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.arcs(spark, sf_dir).selectExpr("arc_id", "travel_time AS p", "CASE WHEN arc_id % 3 = 0 THEN travel_time * 3 END AS l", "1000 * (arc_id % 10) AS u", "3000 + (arc_id * 17) % 5000 AS t")
    p, live, u, t = (F.col(c) for c in "plut")
    return rows.select("arc_id", timed.live_time(p, live, u, t).alias("blended"), timed.live_time(p, live, u, t, True).alias("pessimistic"), F.coalesce(live > p, F.lit(False)).alias("slower"))


@query("w13_w14_day_smoothing", "WITH b AS (SELECT user_id % 50 AS edge, hour(ts) AS h, CAST(floor(max(value)) AS BIGINT) AS v FROM events GROUP BY 1, 2), g AS (SELECT e.edge, r.h, coalesce(b.v, 0) AS v FROM (SELECT DISTINCT edge FROM b) e CROSS JOIN (SELECT range AS h FROM range(24)) r LEFT JOIN b ON b.edge = e.edge AND b.h = r.h), s AS (SELECT a.edge, a.h, CAST(sum(b.v) // 7 AS BIGINT) AS v FROM g a JOIN g b ON a.edge = b.edge AND (b.h - a.h + 24) % 24 IN (0, 1, 2, 3, 21, 22, 23) GROUP BY a.edge, a.h) SELECT edge, CAST(h AS BIGINT) AS hour, greatest(5, CASE WHEN h >= 23 OR h < 5 THEN max(v) OVER (PARTITION BY edge) ELSE v END) AS kmh FROM s")
def day_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "events").groupBy(F.expr("user_id % 50").alias("edge"), F.hour("ts").alias("h")).agg(F.floor(F.max("value")).alias("v"))
    days = rows.groupBy("edge").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"))
    day = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0).cast("bigint")))
    return days.select("edge", F.posexplode(timed.off_peak(timed.smooth_day(day), 1)).alias("hour", "kmh")).select("edge", F.col("hour").cast("bigint").alias("hour"), "kmh")


GAUSS = lambda c, s: f"exp(-0.5 * pow(least(abs(8.25 - {c}), 24 - abs(8.25 - {c})) / {s}, 2))"


@query(
    "d15_d16_weight_vector",
    f"""{LG}, cam AS (SELECT s_suppkey AS camera_id, (s_suppkey * 37) % (SELECT count(*) * 4 FROM nodes) AS arc_id FROM supplier), cov AS (SELECT a.arc_id, min(c.camera_id) AS camera_id FROM arcs a JOIN arcs x ON x.way_id = a.way_id AND x.antiparallel = a.antiparallel JOIN cam c ON c.arc_id = x.arc_id GROUP BY a.arc_id),
    w AS (SELECT arc_id, CASE WHEN arc_id % 31 = 0 THEN 2147483647 WHEN camera_id IS NOT NULL THEN greatest(1, least(2147483646, CAST(floor(geo_distance * 3600.0::DOUBLE / (10 + camera_id % 40)) AS BIGINT)))
      ELSE greatest(1, least(2147483646, CAST(floor(travel_time * (1 + (0.35 * {GAUSS(7.5, 1.2)} + 0.45 * {GAUSS(17.5, 1.5)} - 0.15 * {GAUSS(2.0, 2.0)}) * CASE highway WHEN 'primary' THEN 0.85::DOUBLE WHEN 'secondary' THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END)) AS BIGINT))) END AS weight FROM arcs LEFT JOIN cov USING (arc_id))
    SELECT from_arc, to_arc, CASE WHEN w.weight = 2147483647 THEN w.weight ELSE least(2147483646, w.weight + turn_cost) END AS weight FROM lg JOIN w ON w.arc_id = to_arc""",
)
def weight_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    first = cameras(spark, sf_dir).groupBy("way_id", "antiparallel").agg(F.min("camera_id").alias("camera_id"))
    speeds = arcs.join(first, ["way_id", "antiparallel"]).select("arc_id", (F.lit(10) + F.col("camera_id") % 40).alias("kmh"))
    closed = arcs.where("arc_id % 31 = 0").select("arc_id")
    return timed.weight_vector(arcs, lg(spark, sf_dir), speeds, closed, 8.25)


@query("d19_fake_traffic", f"{grid.WITH} SELECT count(*) AS arcs, count(*) FILTER (kmh > 40) AS fast FROM (SELECT geo_distance * 3600.0 / travel_time AS kmh FROM arcs)")
def fake_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed.fake_traffic(grid.arcs(spark, sf_dir), 40.0, 0.005)
    return rows.agg(F.count("*").alias("arcs"), F.count_if(F.col("kmh") > 40).alias("fast"))
