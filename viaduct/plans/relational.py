"""Queries over joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.functions import geo
from viaduct.operators import network
from viaduct.plans.registry import query
from viaduct.sources import grid

FORBIDDEN = "(from_arc * 3 + to_arc * 5) % 37 = 0"
LG = f"""{grid.WITH}, pairs AS (SELECT a.arc_id AS from_arc, b.arc_id AS to_arc, a.tail AS t, b.head AS h, b.travel_time AS w FROM arcs a JOIN arcs b ON a.head = b.tail),
  lg AS (SELECT from_arc, to_arc, CASE WHEN t = h THEN CAST(20000 AS BIGINT) ELSE 0 END AS turn_cost, w + CASE WHEN t = h THEN 20000 ELSE 0 END AS weight FROM pairs WHERE NOT ({FORBIDDEN}))"""
#: Paths that run along rows: path p starts at node 50 p and takes up to 12 steps to the right while arcs exist in the node list.
PATHS = "paths AS (SELECT p_partkey AS path_id FROM part WHERE p_partkey % 50 = 0)"


def forbidden_turns(arcs: DataFrame) -> DataFrame:
    a, b = arcs.select(F.col("arc_id").alias("from_arc"), "head"), arcs.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("head"))
    return a.join(b, "head").where(FORBIDDEN).select("from_arc", "to_arc")


def lg(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    return network.line_graph(arcs, forbidden_turns(arcs))


def row_paths(spark: SparkSession, sf_dir: str, steps: int = 12) -> DataFrame:
    """``path_id, nodes``: from the left end of each row to the right."""
    first = grid.nodes(spark, sf_dir).where("node_id % 50 = 0").select(F.col("node_id").alias("path_id"))
    return first.select("path_id", F.expr(f"transform(sequence(0, {steps}), i -> path_id + i)").alias("nodes"))


ROWS = """paths AS (SELECT node_id AS path_id FROM nodes WHERE node_id % 50 = 0),
  steps AS (SELECT path_id, pos, path_id + pos AS tail, path_id + pos + 1 AS head FROM paths, (SELECT CAST(range AS BIGINT) AS pos FROM range(12)) AS r),
  path_arcs AS (SELECT path_id, pos, arc_id FROM steps LEFT JOIN arcs USING (tail, head))"""


@query("j01_positional_join", f"{grid.WITH} SELECT arc_id, travel_time, arc_id * 10 + 1 AS attribute FROM arcs")
def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    return arcs.select("arc_id", "travel_time").join(arcs.select("arc_id", F.expr("arc_id * 10 + 1").alias("attribute")), "arc_id")


@query("j02_j03_line_graph", f"{LG} SELECT * FROM lg")
def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg(spark, sf_dir)


@query("j04_u02_conditional_minus_forbidden", f"{LG} SELECT from_arc, to_arc FROM pairs WHERE (from_arc + to_arc) % 11 = 0 AND NOT ({FORBIDDEN})")
def conditional_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    cond = network.line_graph(arcs).where("(from_arc + to_arc) % 11 = 0").select("from_arc", "to_arc")
    return cond.join(forbidden_turns(arcs), ["from_arc", "to_arc"], "left_anti")


@query("u03_conditional_and_forbidden", f"{LG} SELECT from_arc, to_arc FROM pairs WHERE (from_arc + to_arc) % 11 = 0 AND ({FORBIDDEN})")
def conditional_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    cond = network.line_graph(arcs).where("(from_arc + to_arc) % 11 = 0").select("from_arc", "to_arc")
    return cond.join(forbidden_turns(arcs), ["from_arc", "to_arc"], "left_semi")


@query("j05_j06_live_lookup", f"{grid.WITH} SELECT l_orderkey, l_linenumber, l_partkey AS tail, l_partkey + 1 AS head, arc_id FROM lineitem LEFT JOIN arcs ON tail = l_partkey AND head = l_partkey + 1")
def live_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = grid.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("tail"), (F.col("l_partkey") + 1).alias("head"))
    return network.find_arcs(pairs, grid.arcs(spark, sf_dir))


@query("j07_node_path_to_arcs", f"{grid.WITH}, {ROWS} SELECT * FROM path_arcs")
def path_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.node_paths_to_arcs(row_paths(spark, sf_dir), grid.arcs(spark, sf_dir))


@query("j08_arc_path_to_nodes", f"{grid.WITH}, {ROWS} SELECT path_id, pos + 1 AS pos, head AS node_id FROM path_arcs JOIN arcs USING (arc_id) UNION ALL SELECT path_id, 0, tail FROM path_arcs JOIN arcs USING (arc_id) WHERE pos = 0")
def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.arc_paths_to_nodes(path_arcs(spark, sf_dir), grid.arcs(spark, sf_dir))


@query("j09_reverse_exists", f"{grid.WITH} SELECT a.arc_id FROM arcs a WHERE EXISTS (SELECT 1 FROM arcs b WHERE b.tail = a.head AND b.head = a.tail)")
def reverse_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.with_reverse_arc(grid.arcs(spark, sf_dir)).select("arc_id")


@query("j10_j11_fan_out", f"{LG} SELECT to_arc AS arc_id, count(*) AS incoming, min(from_arc) AS first_incoming, CAST(sum(turn_cost) AS BIGINT) AS turn_costs FROM lg GROUP BY to_arc")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg(spark, sf_dir).groupBy(F.col("to_arc").alias("arc_id")).agg(F.count("*").alias("incoming"), F.min("from_arc").alias("first_incoming"), F.sum("turn_cost").alias("turn_costs"))


CAMERAS = "cameras AS (SELECT s_suppkey AS camera_id, arc_id AS anchor, way_id, antiparallel FROM supplier JOIN arcs ON arc_id = (s_suppkey * 37) % (SELECT count(*) * 4 FROM nodes))"


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = grid.nodes(spark, sf_dir).agg((F.count("*") * 4).alias("n"))
    at = grid.read(spark, sf_dir, "supplier").join(F.broadcast(n)).select(F.col("s_suppkey").alias("camera_id"), F.expr("(s_suppkey * 37) % n").alias("arc_id"))  # n is one row
    return at.join(grid.arcs(spark, sf_dir), "arc_id").select("camera_id", F.col("arc_id").alias("anchor"), "way_id", "antiparallel")


@query("j12_way_siblings_first_camera", f"{grid.WITH}, {CAMERAS} SELECT a.arc_id, min(c.camera_id) AS camera_id FROM arcs a JOIN cameras c ON a.way_id = c.way_id AND a.antiparallel = c.antiparallel GROUP BY a.arc_id")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first camera of a way and direction wins all its arcs: reduce the cameras before the join
    first = cameras(spark, sf_dir).groupBy("way_id", "antiparallel").agg(F.min("camera_id").alias("camera_id"))
    return grid.arcs(spark, sf_dir).join(first, ["way_id", "antiparallel"]).select("arc_id", "camera_id")


@query("j13_propagation_preview", f"{grid.WITH}, {CAMERAS} SELECT c.camera_id, count(*) AS arcs, min(a.tail) AS min_tail, max(a.head) AS max_head, count(*) FILTER (a.arc_id = c.anchor) AS anchors FROM arcs a JOIN cameras c ON a.way_id = c.way_id AND a.antiparallel = c.antiparallel GROUP BY c.camera_id")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = grid.arcs(spark, sf_dir).join(cameras(spark, sf_dir), ["way_id", "antiparallel"])
    return both.groupBy("camera_id").agg(F.count("*").alias("arcs"), F.min("tail").alias("min_tail"), F.max("head").alias("max_head"), F.count_if(F.col("arc_id") == F.col("anchor")).alias("anchors"))


@query("j28_j34_vector_diff", f"{grid.WITH}, o AS (SELECT arc_id, travel_time + CASE WHEN arc_id % 7 = 0 THEN 5 ELSE 0 END AS w FROM arcs WHERE arc_id % 19 <> 0), n AS (SELECT arc_id, travel_time AS v FROM arcs WHERE arc_id % 23 <> 0) SELECT count(*) FILTER (w IS NOT NULL AND v IS NOT NULL AND w <> v) AS changed, count(*) FILTER (v IS NULL) AS dropped, count(*) FILTER (w IS NULL) AS added, CAST(sum(w - v) AS BIGINT) AS delta FROM o FULL JOIN n USING (arc_id)")
def vector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    old = arcs.where("arc_id % 19 <> 0").select("arc_id", F.expr("travel_time + CASE WHEN arc_id % 7 = 0 THEN 5 ELSE 0 END").alias("w"))
    new = arcs.where("arc_id % 23 <> 0").select("arc_id", F.col("travel_time").alias("v"))
    return old.join(new, "arc_id", "full").agg(F.expr("count_if(w <> v)").alias("changed"), F.expr("count_if(v IS NULL)").alias("dropped"), F.expr("count_if(w IS NULL)").alias("added"), F.expr("sum(w - v)").alias("delta"))


@query("j31_d20_live_overrides", f"{grid.WITH}, l AS (SELECT l_partkey * 4 + 2 AS arc_id, CAST(max(l_quantity) AS BIGINT) * 100 - 1000 AS live FROM lineitem GROUP BY l_partkey) SELECT arc_id, CASE WHEN live < 0 THEN 2147483647 ELSE coalesce(live, travel_time) END AS weight, live IS NOT NULL AS is_live FROM arcs LEFT JOIN l USING (arc_id)")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = grid.read(spark, sf_dir, "lineitem").groupBy(F.expr("l_partkey * 4 + 2").alias("arc_id")).agg((F.max("l_quantity").cast("bigint") * 100 - 1000).alias("live"))
    return network.with_overrides(grid.arcs(spark, sf_dir), live)


@query("a01_w03_degrees", f"{grid.WITH} SELECT tail AS node_id, count(*) AS out_degree, CAST(coalesce(sum(count(*)) OVER (ORDER BY tail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_out FROM arcs GROUP BY tail")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(grid.arcs(spark, sf_dir))


@query("a02_a03_ways", f"{grid.WITH} SELECT way_id, count(*) AS arcs, min(arc_id) AS first_arc, min(highway) = max(highway) AS consistent FROM arcs GROUP BY way_id")
def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.ways(grid.arcs(spark, sf_dir))


@query("a04_bounding_box", f"{grid.WITH} SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng FROM nodes")
def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.nodes(spark, sf_dir).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))


@query("a05_w01_route_length", f"{grid.WITH}, {ROWS}, p AS (SELECT path_id, tail_lat AS a, tail_lng AS b, head_lat AS c, head_lng AS d FROM path_arcs JOIN arcs USING (arc_id)) SELECT path_id, count(*) AS arcs, CAST(round(100 * sum(2 * 6371000.0 * asin(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))) AS BIGINT) AS length_cm FROM p GROUP BY path_id")
def route_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = path_arcs(spark, sf_dir).join(grid.arcs_with_ends(spark, sf_dir), "arc_id")
    meters = geo.haversine_m(*[F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng")])
    return rows.groupBy("path_id").agg(F.count("*").alias("arcs"), F.round(100 * F.sum(meters)).cast("bigint").alias("length_cm"))


METRIC = "turned AS (SELECT to_arc AS arc_id, min(weight) AS m FROM lg GROUP BY to_arc), pseudo AS (SELECT arc_id, coalesce(m, travel_time) AS weight FROM arcs LEFT JOIN turned USING (arc_id))"


@query("a06_route_cost", f"{grid.WITH}, {ROWS} SELECT path_id, count(*) AS arcs, CASE WHEN count(*) = count(travel_time) THEN CAST(sum(travel_time) AS BIGINT) END AS cost FROM path_arcs LEFT JOIN arcs USING (arc_id) GROUP BY path_id")
def route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = grid.arcs(spark, sf_dir).select("arc_id", F.col("travel_time").alias("weight"))
    return network.route_costs(path_arcs(spark, sf_dir), metric)


EXACT = "st AS (SELECT path_id, pos, arc_id, lag(arc_id) OVER (PARTITION BY path_id ORDER BY pos) AS from_arc FROM path_arcs), pr AS (SELECT path_id, CASE WHEN st.from_arc IS NULL THEN travel_time ELSE weight END AS w FROM st LEFT JOIN lg ON lg.from_arc = st.from_arc AND lg.to_arc = st.arc_id LEFT JOIN arcs ON arcs.arc_id = st.arc_id), exact AS (SELECT path_id, CASE WHEN count(*) = count(w) THEN CAST(sum(w) AS BIGINT) END AS cost FROM pr GROUP BY path_id)"


@query("a07_line_graph_route_cost", f"{LG}, {ROWS}, {EXACT} SELECT * FROM exact")
def lg_route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.line_graph_route_costs(path_arcs(spark, sf_dir), grid.arcs(spark, sf_dir), lg(spark, sf_dir))


@query("a08_pseudo_normal_weight", f"{LG}, {METRIC} SELECT * FROM pseudo")
def pseudo_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pseudo_normal_weights(grid.arcs(spark, sf_dir), lg(spark, sf_dir))


@query("a09_route_evaluation", f"{LG}, {METRIC}, {ROWS}, {EXACT}, plain AS (SELECT path_id, CASE WHEN count(*) = count(weight) THEN CAST(sum(weight) AS BIGINT) END AS p FROM path_arcs LEFT JOIN pseudo USING (arc_id) GROUP BY path_id) SELECT path_id, coalesce(cost, p) AS cost, CASE WHEN cost IS NOT NULL THEN 'line_graph' WHEN p IS NOT NULL THEN 'pseudo_normal' END AS mode FROM exact JOIN plain USING (path_id)")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.evaluate_routes(path_arcs(spark, sf_dir), grid.arcs(spark, sf_dir), lg(spark, sf_dir))


@query("a10_traffic_overlay", f"{grid.WITH}, m AS (SELECT *, travel_time * (100 + arc_id % 97) // 100 AS now FROM arcs WHERE greatest(tail_lat, head_lat) >= 20.905::DOUBLE AND highway <> 'residential') SELECT CASE WHEN now / travel_time::DOUBLE <= 1.15 THEN 'green' WHEN now / travel_time::DOUBLE <= 1.6 THEN 'yellow' ELSE 'red' END AS status, count(*) AS segments, min(arc_id) AS first_arc FROM m GROUP BY 1")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.functions.traffic import is_major, traffic_class

    rows = grid.arcs_with_ends(spark, sf_dir).where((F.greatest("tail_lat", "head_lat") >= 20.905) & is_major(F.col("highway")))
    now = F.expr("travel_time * (100 + arc_id % 97) div 100")
    return rows.groupBy(traffic_class(F.col("travel_time"), now).alias("status")).agg(F.count("*").alias("segments"), F.min("arc_id").alias("first_arc"))


@query("a11_camera_overlay", f"{grid.WITH}, {CAMERAS} SELECT highway, count(*) AS cameras FROM cameras JOIN arcs ON arc_id = anchor WHERE tail_lat BETWEEN 20.9::DOUBLE AND 20.93::DOUBLE GROUP BY highway")
def camera_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cameras(spark, sf_dir).select("camera_id", "anchor").join(grid.arcs_with_ends(spark, sf_dir), F.col("anchor") == F.col("arc_id"))
    return rows.where(F.col("tail_lat").between(20.9, 20.93)).groupBy("highway").agg(F.count("*").alias("cameras"))


@query("a12_p16_parallel_arcs", f"{grid.WITH}, d AS (SELECT arc_id, tail, head, travel_time AS w FROM arcs UNION ALL SELECT arc_id + 1000000, tail, head, travel_time - arc_id % 3 FROM arcs UNION ALL SELECT 9000000 + node_id, node_id, node_id, 1 FROM nodes) SELECT tail, head, min(w) AS weight, arg_min(arc_id, w * 10000000 + arc_id) AS arc_id FROM d WHERE tail <> head GROUP BY tail, head")
def parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir).select("arc_id", "tail", "head", "travel_time")
    loops = grid.nodes(spark, sf_dir).select(F.expr("9000000 + node_id"), "node_id", F.col("node_id").alias("head"), F.lit(1).cast("bigint"))
    doubled = arcs.union(arcs.select(F.expr("arc_id + 1000000"), "tail", "head", F.expr("travel_time - arc_id % 3"))).union(loops)
    return network.without_loops_and_doubles(doubled)


@query("a13_first_minimum", f"{grid.WITH} SELECT tail, arg_min(arc_id, travel_time * 10000000 + arc_id) AS arc_id, min(travel_time) AS least, max(travel_time) AS most FROM arcs GROUP BY tail")
def first_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.arcs(spark, sf_dir).groupBy("tail").agg(F.min_by("arc_id", F.struct("travel_time", "arc_id")).alias("arc_id"), F.min("travel_time").alias("least"), F.max("travel_time").alias("most"))


@query("a14_speeds", f"{grid.WITH} SELECT highway, CAST(round(1000 * min(k)) AS BIGINT) AS least, CAST(round(1000 * max(k)) AS BIGINT) AS most, CAST(round(1000 * avg(k)) AS BIGINT) AS mean FROM (SELECT highway, geo_distance * 3600.0::DOUBLE / travel_time AS k FROM arcs) GROUP BY highway")
def speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("geo_distance") * 3600.0 / F.col("travel_time")
    milli = lambda x: F.round(1000 * x).cast("bigint")
    return grid.arcs(spark, sf_dir).groupBy("highway").agg(milli(F.min(k)).alias("least"), milli(F.max(k)).alias("most"), milli(F.avg(k)).alias("mean"))


@query("a20_w15_gps_buckets", "WITH e AS (SELECT user_id % 200 AS edge, epoch_ms(ts) AS t, value FROM events), g AS (SELECT *, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS gap FROM e WINDOW w AS (PARTITION BY edge ORDER BY t, value)) SELECT edge, t // 900000 AS bucket, count(*) AS samples, CAST(round(1000 * sum(value * gap) / sum(gap)) AS BIGINT) AS speed FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(gap) > 0")
def gps_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators.timed import bucket_speeds, epoch_ms

    samples = grid.read(spark, sf_dir, "events").select(F.expr("user_id % 200").alias("edge"), epoch_ms(F.col("ts")).alias("t"), F.col("value").alias("speed"))
    return bucket_speeds(samples, unit=1000).select("edge", "bucket", "samples", F.round("speed").cast("bigint").alias("speed"))


@query("a21_w05_runs", f"{grid.WITH}, c AS (SELECT way_id, arc_id, travel_time // 2000 AS level FROM arcs), r AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY way_id ORDER BY arc_id) THEN 0 ELSE 1 END AS fresh FROM c) SELECT way_id, arc_id, level FROM r WHERE fresh = 1")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("way_id").orderBy("arc_id")
    rows = grid.arcs(spark, sf_dir).select("way_id", "arc_id", F.expr("travel_time div 2000").alias("level"))
    return rows.withColumn("last", F.lag("level").over(w)).where("last is null or last <> level").select("way_id", "arc_id", "level")


@query("a22_j33_bench_stats", "WITH r AS (SELECT o_orderpriority AS name, o_orderkey * 7 % 1000 + 1 AS us, o_orderkey % 2 AS run FROM orders), s AS (SELECT name, run, count(*) AS n, min(us) AS least, max(us) AS most, list_extract(list_sort(list(us)), 1 + CAST(floor(0.5::DOUBLE * (count(*) - 1) + 0.5) AS INTEGER)) AS p50, list_extract(list_sort(list(us)), 1 + CAST(floor(0.99::DOUBLE * (count(*) - 1) + 0.5) AS INTEGER)) AS p99 FROM r GROUP BY name, run) SELECT a.name, a.n, a.least, a.most, a.p50, a.p99, b.p50 AS p50_now, b.p50 * 100 > a.p50 * 110 AS slower FROM s a JOIN s b ON a.name = b.name AND a.run = 0 AND b.run = 1")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators.reports import compare_runs, run_stats

    rows = grid.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.expr("o_orderkey * 7 % 1000 + 1").alias("us"), F.expr("o_orderkey % 2").alias("run"))
    return compare_runs(run_stats(rows.where("run = 0")), run_stats(rows.where("run = 1")))


@query("a25_degree_histogram", f"{grid.WITH} SELECT out_degree, count(*) AS nodes FROM (SELECT tail, count(*) AS out_degree FROM arcs GROUP BY tail) GROUP BY out_degree")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.arcs(spark, sf_dir).groupBy("tail").agg(F.count("*").alias("out_degree")).groupBy("out_degree").agg(F.count("*").alias("nodes"))


@query("a28_turn_dedup", f"{LG}, t AS (SELECT from_arc, to_arc, (from_arc + to_arc) % 4 = 0 AS conditional FROM pairs WHERE (from_arc + to_arc) % 11 = 0 UNION ALL SELECT from_arc, to_arc, TRUE FROM pairs WHERE (from_arc + to_arc) % 22 = 0) SELECT from_arc, to_arc, bool_and(conditional) AS conditional FROM t GROUP BY from_arc, to_arc")
def turn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = network.line_graph(grid.arcs(spark, sf_dir)).select("from_arc", "to_arc")
    turns = pairs.where("(from_arc + to_arc) % 11 = 0").selectExpr("*", "(from_arc + to_arc) % 4 = 0 AS conditional").union(pairs.where("(from_arc + to_arc) % 22 = 0").selectExpr("*", "true"))
    return turns.groupBy("from_arc", "to_arc").agg(F.bool_and("conditional").alias("conditional"))


@query("a29_shared_cost", f"{grid.WITH}, {ROWS} SELECT path_id, CAST(sum(travel_time) AS BIGINT) AS shared FROM path_arcs JOIN arcs USING (arc_id) WHERE pos < 7 GROUP BY path_id")
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    short = network.node_paths_to_arcs(row_paths(spark, sf_dir, 7), arcs)
    return network.shared_cost(path_arcs(spark, sf_dir), short, arcs.select("arc_id", F.col("travel_time").alias("weight")))


@query("a31_weight_summary", f"{grid.WITH} SELECT min(w) FILTER (w < 2147483647) AS least, max(w) FILTER (w < 2147483647) AS most, count(*) FILTER (w = 2147483647) AS closed FROM (SELECT CASE WHEN arc_id % 29 = 0 THEN 2147483647 ELSE travel_time END AS w FROM arcs)")
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.expr("CASE WHEN arc_id % 29 = 0 THEN 2147483647 ELSE travel_time END").cast("bigint")
    open_ = F.when(w < 2147483647, w)
    return grid.arcs(spark, sf_dir).agg(F.min(open_).alias("least"), F.max(open_).alias("most"), F.count_if(w == 2147483647).alias("closed"))


@query("a34_bits", "SELECT p_partkey, CAST(bit_count(p_partkey) AS BIGINT) AS ones, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS BIGINT) AS rank FROM part")
def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    return grid.read(spark, sf_dir, "part").select("p_partkey", F.bit_count("p_partkey").cast("bigint").alias("ones"), rank.cast("bigint").alias("rank"))


@query("p08_subgraph", f"{grid.WITH}, k AS (SELECT node_id FROM nodes WHERE lat <= 20.9105::DOUBLE AND lng <= 105.7205::DOUBLE) SELECT arc_id, tail, head FROM arcs WHERE tail IN (SELECT node_id FROM k) AND head IN (SELECT node_id FROM k)")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("lat") <= 20.9105) & (F.col("lng") <= 105.7205)
    return network.subgraph(grid.nodes(spark, sf_dir), grid.arcs(spark, sf_dir), inside)[1].select("arc_id", "tail", "head")


@query("t03_t05_top_k", f"{grid.WITH} SELECT way_id, arc_id, rank FROM (SELECT way_id, arc_id, row_number() OVER (PARTITION BY way_id ORDER BY travel_time, arc_id) AS rank FROM arcs) WHERE rank <= 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("way_id").orderBy("travel_time", "arc_id")).cast("bigint")
    return grid.arcs(spark, sf_dir).select("way_id", "arc_id", rank.alias("rank")).where("rank <= 5")


@query("t04_t09_heaviest_arcs", f"{grid.WITH} SELECT arc_id, travel_time FROM arcs ORDER BY travel_time DESC, arc_id LIMIT 128")
def heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.arcs(spark, sf_dir).select("arc_id", "travel_time").orderBy(F.desc("travel_time"), "arc_id").limit(128)


@query("t06_name_search", "SELECT p_name AS name, count(*) AS parts, min(p_partkey) AS first_part FROM part WHERE contains(lower(p_name), 'a') GROUP BY p_name ORDER BY starts_with(lower(p_name), 'a') DESC, count(*) DESC, p_name LIMIT 20")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators.reports import search_names

    return search_names(grid.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")), "a", 20).select("name", F.col("n").alias("parts"), F.col("first_id").alias("first_part"))


@query("t01_t07_permutation", f"{grid.WITH}, p AS (SELECT node_id, (node_id * 7 + 3) % (SELECT count(*) FROM nodes) AS rank FROM nodes) SELECT a.node_id, b.rank AS chained, c.node_id AS inverse FROM p a JOIN p b ON a.rank = b.node_id JOIN p c ON c.rank = a.node_id")
def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = grid.nodes(spark, sf_dir).select("node_id")
    p = ids.join(F.broadcast(ids.agg(F.count("*").alias("n")))).select("node_id", F.expr("(node_id * 7 + 3) % n").alias("rank"))  # n is one row
    chained = p.join(p.select(F.col("node_id").alias("rank"), F.col("rank").alias("chained")), "rank")
    return chained.join(p.select(F.col("rank").alias("node_id"), F.col("node_id").alias("inverse")), "node_id").select("node_id", "chained", "inverse")


@query("u01_union_nodes", f"{grid.WITH} SELECT arc_id AS lg_node, arc_id AS orig_arc, FALSE AS is_split FROM arcs UNION ALL SELECT arc_id + 1000000, arc_id, TRUE FROM arcs WHERE arc_id % 101 = 0")
def union_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = grid.arcs(spark, sf_dir).select(F.col("arc_id").alias("lg_node"), F.col("arc_id").alias("orig_arc"), F.lit(False).alias("is_split"))
    split = base.where("orig_arc % 101 = 0").select((F.col("lg_node") + 1_000_000).alias("lg_node"), "orig_arc", F.lit(True).alias("is_split"))
    return base.unionByName(split)


@query("u04_back_arcs", f"{grid.WITH} SELECT tail, head FROM arcs UNION SELECT head, tail FROM arcs")
def back_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.closed_under_reversal(grid.arcs(spark, sf_dir))


@query("u06_covered_ranges", 'WITH r AS (SELECT DISTINCT o_custkey AS path_id, o_orderkey % 50 AS start, o_orderkey % 50 + 1 + o_orderkey % 7 AS "end" FROM orders) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.path_id = a.path_id AND (b.start, b."end") <> (a.start, a."end") AND b.start >= a.start AND b."end" <= a."end")')
def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), F.expr("o_orderkey % 50").alias("start"), F.expr("o_orderkey % 50 + 1 + o_orderkey % 7").alias("end"))
    return network.covered_ranges(rows)
