"""Queries over routes, checks and file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import hierarchy, paths, quality, routes
from viaduct.plans.registry import query
from viaduct.plans.relational import LG, forbidden_turns, lg, row_paths
from viaduct.plans.spatial_graph import FEW, few, one, relaxation, weighted
from viaduct.plans.turns_timed import STEP, TTF, ttfs
from viaduct.session import materialize, shared_folder
from viaduct.sources import files, grid


@query("r04_line_graph_distances", f"{LG}, {relaxation('SELECT min(arc_id) AS source FROM arcs', 'weight', '(SELECT from_arc AS tail, to_arc AS head, weight FROM lg)')} SELECT source, node, d + (SELECT travel_time FROM arcs WHERE arc_id = source) AS dist FROM dist")
def lg_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    first = arcs.agg(F.min("arc_id").alias("source"))
    edges = lg(spark, sf_dir).select(F.col("from_arc").alias("tail"), F.col("to_arc").alias("head"), "weight")
    dist = paths.distances(edges, first, 4 * paths.CELL_NODES)
    return dist.join(arcs.select(F.col("arc_id").alias("source"), "travel_time"), "source").select("source", "node", (F.col("dist") + F.col("travel_time")).alias("dist"))


PAIRS = "q AS (SELECT o_orderkey AS query_id, a.arc_id AS src_arc, a.travel_time AS sw, a.head AS sh, (o_orderkey % 10) / 10.0::DOUBLE AS src_t, b.arc_id AS dst_arc, b.tail AS dt, b.travel_time AS dw, (o_custkey % 10) / 10.0::DOUBLE AS dst_t FROM orders JOIN arcs a ON a.head = (o_orderkey % 5) * 5 * 17 AND a.tail % 2 = o_orderkey % 2 JOIN arcs b ON b.tail = o_custkey % 50 AND b.head > b.tail)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grid.arcs(spark, sf_dir)
    o = grid.read(spark, sf_dir, "orders").selectExpr("o_orderkey", "(o_orderkey % 5) * 5 * 17 AS head", "o_orderkey % 2 AS odd", "o_custkey % 50 AS tail", "(o_orderkey % 10) / 10.0D AS src_t", "(o_custkey % 10) / 10.0D AS dst_t")
    # orders meet the arcs of 5 heads and 50 tails, so these are at most 220 rows, and shuffled orders would lie in as many keys
    s = o.join(F.broadcast(a.where("head % 85 = 0 AND head <= 340").select(F.col("arc_id").alias("src_arc"), "head", (F.col("tail") % 2).alias("odd"))), ["head", "odd"])
    return s.join(F.broadcast(a.where("head > tail AND tail < 50").select(F.col("arc_id").alias("dst_arc"), "tail")), "tail").select(F.col("o_orderkey").alias("query_id"), "src_arc", "src_t", "dst_arc", "dst_t")


@query("r03_f14_coordinate_costs", f"{grid.WITH}, {relaxation(FEW)}, {PAIRS} SELECT query_id, src_arc, dst_arc, CASE WHEN src_arc = dst_arc AND dst_t >= src_t THEN CAST(floor(sw * (dst_t - src_t) + 0.5) AS BIGINT) ELSE CAST(floor(sw * (1 - src_t) + 0.5) AS BIGINT) + d + CAST(floor(dw * dst_t + 0.5) AS BIGINT) END AS cost FROM q LEFT JOIN dist ON source = sh AND node = dt")
def coordinate_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = weighted(spark, sf_dir)
    p = pairs(spark, sf_dir).withColumn("query_id", F.struct("query_id", "src_arc", "dst_arc"))
    found = routes.coordinate_costs(p, paths.distances(arcs, few(spark, sf_dir)), arcs)
    return found.select("query_id.query_id", "query_id.src_arc", "query_id.dst_arc", "cost")


HUBS = "SELECT node_id AS source FROM nodes WHERE node_id % 401 = 3"
REV = "(SELECT head AS tail, tail AS head, travel_time FROM arcs)"


PAIRED = "p AS (SELECT c_custkey % 97 AS s, c_custkey % 89 + 100 AS t FROM customer GROUP BY 1, 2)"


@query("j26_g25_hub_labels", f"{grid.WITH}, {PAIRED}, {relaxation('SELECT DISTINCT c_custkey % 97 AS source FROM customer')} SELECT s AS source, t AS target, d AS dist FROM p JOIN dist ON dist.source = s AND dist.node = t")
def hub_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are what a node reaches upwards in the contraction hierarchy; pairs meet in their best common hub."""
    shortcuts = hierarchy.contract(weighted(spark, sf_dir).select("tail", "head", "weight"), hierarchy.order(grid.nodes(spark, sf_dir), 0.001), 3)
    wanted = grid.read(spark, sf_dir, "customer").selectExpr("c_custkey % 97 AS source", "c_custkey % 89 + 100 AS target").distinct()
    return hierarchy.distances(shortcuts, wanted).select("source", "target", "dist")


@query("g05_landmark_bounds", f"{grid.WITH}, {relaxation(HUBS)}, p AS (SELECT c_custkey % 97 AS s, c_custkey % 89 + 100 AS t FROM customer GROUP BY 1, 2) SELECT s AS source, t AS target, greatest(0, max(b.d - a.d)) AS bound FROM p JOIN dist a ON a.node = s JOIN dist b ON b.node = t AND b.source = a.source GROUP BY s, t")
def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks grow with the network, the ends of pairs do not (186 at most), so these are swept backwards to all landmarks."""
    hubs = grid.nodes(spark, sf_dir).where("node_id % 401 = 3").select(F.col("node_id").alias("node"))
    wanted = materialize(grid.read(spark, sf_dir, "customer").selectExpr("c_custkey % 97 AS source", "c_custkey % 89 + 100 AS target").distinct(), "pairs")
    ends = wanted.select(F.explode(F.array("source", "target")).alias("source")).distinct()
    found = hierarchy.rounds(weighted(spark, sf_dir).select("tail", "head", "weight"), hierarchy.order(grid.nodes(spark, sf_dir), 0.001), 3)
    swept = hierarchy.sweep(found, ends, hubs, back=True)
    return routes.landmark_bounds(wanted, materialize(swept.select(F.col("node").alias("landmark"), F.col("source").alias("node"), "dist"), "landmarks"))


@query("g32_r11_alternatives")
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes from node 0 to a few targets: via nodes, their tree paths, and the greedy choice."""
    arcs = weighted(spark, sf_dir)
    targets = few(spark, sf_dir).where("source > 0").select(F.col("source").alias("query_id"))
    ahead = paths.distances(arcs, one(spark))
    flipped = arcs.select("arc_id", F.col("head").alias("tail"), F.col("tail").alias("head"), "weight")
    back = paths.distances(flipped, targets.withColumnRenamed("query_id", "source"))
    from_source = ahead.select("node", "dist").join(F.broadcast(targets.groupBy().agg(F.collect_list("query_id").alias("ids")))).select(F.explode("ids").alias("query_id"), "node", "dist")  # a stated set of queries
    vias = routes.via_candidates(from_source, back.select(F.col("source").alias("query_id"), "node", "dist"))
    first = paths.unpack(vias.select(F.lit(0).cast("bigint").alias("source"), F.col("via").alias("node")).distinct(), paths.parents(ahead, arcs))
    last = paths.unpack(vias.select(F.col("query_id").alias("source"), F.col("via").alias("node")).distinct(), paths.parents(back, flipped))
    tree1 = paths.parents(ahead, arcs).select(F.col("node"), "arc_id")
    tree2 = paths.parents(back, flipped).select("source", "node", "arc_id")
    weight = arcs.select("arc_id", "weight")
    a = vias.join(first.select(F.col("target").alias("via"), "node"), "via").join(tree1, "node").join(weight, "arc_id").select("query_id", "via", "cost", "arc_id", "weight")
    b = vias.join(last.select(F.col("source").alias("query_id"), F.col("target").alias("via"), "node"), ["query_id", "via"]).join(tree2.withColumnRenamed("source", "query_id"), ["query_id", "node"]).join(weight, "arc_id").select("query_id", "via", "cost", "arc_id", "weight")
    whole = a.union(b).groupBy("query_id", "via", "cost").agg(F.collect_list(F.struct("arc_id", "weight")).alias("arcs"))
    return routes.accept_alternatives(whole, 3)


@query("d02_time_dependent_arrivals", f"{grid.WITH}, {TTF}, g AS (SELECT f.arc_id, tail, head, f.i, f.tt AS t0, n.tt AS t1 FROM f JOIN f n ON n.arc_id = f.arc_id AND n.i = (f.i + 1) % 6 JOIN arcs ON arcs.arc_id = f.arc_id), arr(node, d) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), CAST(28000000 AS BIGINT) UNION SELECT g.head, CAST(min(r.d + g.t0 + floor((g.t1 - g.t0) * (r.d - g.i * {STEP}) / {STEP}::DOUBLE)) AS BIGINT) FROM arr r JOIN g ON g.tail = r.node AND g.i = r.d // {STEP} LEFT JOIN recurring.arr p ON p.node = g.head WHERE p.d IS NULL OR r.d + g.t0 + floor((g.t1 - g.t0) * (r.d - g.i * {STEP}) / {STEP}::DOUBLE) < p.d GROUP BY g.head) SELECT CAST(0 AS BIGINT) AS source, node, d AS arrival FROM arr")
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.arrivals(ttfs(spark, sf_dir), one(spark), 28_000_000)


@query("d06_time_dependent_line_graph", f"{LG}, {TTF} SELECT from_arc, to_arc, turn_cost, min(tt) + turn_cost AS low, max(tt) + turn_cost AS high, count(*) AS points FROM lg JOIN f ON f.arc_id = from_arc GROUP BY from_arc, to_arc, turn_cost")
def td_line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.operators import timed

    rows = lg(spark, sf_dir).join(ttfs(spark, sf_dir).select(F.col("arc_id").alias("from_arc"), "ttf"), "from_arc")
    shifted = F.transform("ttf", lambda p: F.struct(p["dt"].alias("dt"), (p["tt"] + F.col("turn_cost")).alias("tt")))
    low, high = timed.bounds(shifted)
    return rows.select("from_arc", "to_arc", "turn_cost", low.alias("low"), high.alias("high"), F.size("ttf").cast("bigint").alias("points"))


@query("p10_network_checks", f"""{LG}, t AS (SELECT from_arc, to_arc FROM pairs WHERE (from_arc * 3 + to_arc * 5) % 37 = 0) SELECT * FROM (VALUES ('arc ids unique', 'PASS', 0), ('heads exist', 'PASS', 0), ('tails exist', 'PASS', 0), ('no loops', 'PASS', 0), ('coordinates in range', 'PASS', 0), ('travel times up to a day', 'PASS', 0), ('turns unique', 'PASS', 0), ('turns of known arcs', 'PASS', 0), ('turns meet', 'PASS', 0), ('order is a permutation', 'PASS', 0)) AS v("check", status, offenders)
UNION ALL SELECT 'speeds plausible', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FROM arcs WHERE geo_distance >= 100 AND (geo_distance * 3600.0 / travel_time > 180 OR geo_distance * 3600.0 / travel_time < 1)
UNION ALL SELECT 'no isolated nodes', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FROM nodes WHERE node_id NOT IN (SELECT tail FROM arcs) AND node_id NOT IN (SELECT head FROM arcs)
UNION ALL SELECT 'no forbidden turn', 'PASS', 0 UNION ALL SELECT 'edges meet', 'PASS', 0 UNION ALL SELECT 'turn costs', 'PASS', 0""")
def network_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, arcs = grid.nodes(spark, sf_dir), grid.arcs(spark, sf_dir)
    turns = forbidden_turns(arcs)
    order = nodes.select("node_id", F.col("node_id").alias("rank"))
    return quality.check_network(nodes, arcs, turns, order).unionByName(quality.check_line_graph(lg(spark, sf_dir), arcs, turns))


@query("p14_sample_reasons", "SELECT reason, count(*) AS samples FROM (SELECT CASE WHEN event_id % 17 = 0 THEN 'no_edge' WHEN value < 5 THEN 'invalid' WHEN event_id % 11 > 9 THEN 'out_of_range' WHEN value - 5 > 60 THEN 'too_fast' ELSE 'ok' END AS reason FROM events) GROUP BY reason")
def sample_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 17 <> 0 THEN user_id END AS edge", "value - 5 AS kmh", "40.0D AS limit_kmh", "event_id % 11 / 9.0D AS fraction")
    return quality.sample_reasons(rows)


@query("s01_s03_k01_vectors", f"{grid.WITH} SELECT CAST(tail // 500 AS VARCHAR) AS part, CAST(row_number() OVER (PARTITION BY tail // 500 ORDER BY arc_id) - 1 AS BIGINT) AS pos, travel_time AS value FROM arcs")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows = grid.arcs(spark, sf_dir).withColumn("part", F.expr("tail div 500"))
    files.save_payloads(files.encode_vectors(rows, "part", "arc_id", "travel_time", "u32"), folder)
    content = spark.read.format("binaryFile").load(folder)
    return files.decode_vectors(content, "u32").select(F.element_at(F.split("path", "/"), -1).alias("part"), "pos", "value")


@query("s17_ragged", "SELECT p_partkey AS id, p_partkey % 4 AS n, CAST(list_sum([x * 7 FOR x IN range(CAST(p_partkey % 4 AS BIGINT))]) AS BIGINT) AS total FROM part")
def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = grid.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 4").alias("n"))
    start = F.expr("(id div 4) * 6 + CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END")
    bounds = ids.select(F.col("id").alias("pos"), start.alias("value"))
    end = ids.orderBy(F.desc("id")).limit(1).select((F.col("id") + 1).alias("pos"), (start + F.col("n")).alias("value"))
    values = ids.where("n > 0").select(F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k", "v"), start.alias("s")).select((F.col("s") + F.col("k")).alias("pos"), (F.col("v") * 7).alias("value"))
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return files.ragged(bounds.union(end), values).select("id", F.size("items").cast("bigint").alias("n"), F.when(F.size("items") > 0, total).alias("total"))


@query("s27_k13_dimacs", f"{grid.WITH} SELECT tail, head, travel_time AS weight FROM arcs")
def dimacs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/dimacs-{uuid.uuid4().hex}"
    files.write_dimacs(weighted(spark, sf_dir)).write.text(folder)
    return files.read_dimacs(spark.read.text(folder))[0]


@query("k14_metis", f"{grid.WITH}, b AS (SELECT tail AS u, head AS v FROM arcs UNION SELECT head, tail FROM arcs) SELECT u AS node_id, string_agg(CAST(v + 1 AS VARCHAR), ' ' ORDER BY v) AS value FROM b GROUP BY u")
def metis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.write_metis(weighted(spark, sf_dir))


@query("s21_s23_text_feeds", 'SELECT l_partkey AS "from", l_suppkey AS "to", CASE WHEN l_linenumber = 3 THEN 2147483647 ELSE CAST(l_linenumber AS BIGINT) * 1500 END AS weight FROM lineitem')
def text_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grid.read(spark, sf_dir, "lineitem").selectExpr("concat_ws(';', l_partkey, l_suppkey, CASE WHEN l_linenumber = 3 THEN 0 ELSE 40 END, 100, l_linenumber * 1.5) AS value")
    return files.read_incidents(lines)


@query("s19_k08_geojson", f"{grid.WITH} SELECT node_id AS path_id, CAST(13 AS BIGINT) AS points, CAST(round(lat * 1000) AS BIGINT) AS lat, CAST(round((lng + 0.012::DOUBLE) * 1000) AS BIGINT) AS last_lng FROM nodes WHERE node_id % 50 = 0")
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = "named_struct('lat', 20.9D + (x div 50) * 0.001D, 'lng', 105.7D + (x % 50) * 0.001D)"
    rows = row_paths(spark, sf_dir).withColumn("points", F.expr(f"transform(nodes, x -> {point})"))
    text = rows.select(F.col("path_id").alias("name"), files.route_geojson(F.col("points"), F.lit(1), F.lit(2.0)).alias("geojson"))
    parsed = files.parse_routes(text)
    at = lambda i, c: F.round(F.element_at("points", i)[c] * 1000).cast("bigint")
    return parsed.select(F.col("name").alias("path_id"), F.size("points").cast("bigint").alias("points"), at(1, "lat").alias("lat"), at(-1, "lng").alias("last_lng"))


@query("k16_polyline")
def polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = row_paths(spark, sf_dir)
    return rows.select("path_id", files.polyline(F.expr("transform(nodes, x -> 20.9D + (x div 50) * 0.001D)"), F.expr("transform(nodes, x -> 105.7D + (x % 50) * 0.001D)")).alias("polyline"))


@query("a27_metric_merging")
def metric_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    metrics = arcs.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("metric"), "arc_id", "travel_time").selectExpr("metric", "arc_id", "travel_time * (100 + (metric div 2) * 20 + metric % 2) AS weight")
    return routes.merge_metrics(metrics, 3)
