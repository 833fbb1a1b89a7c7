"""Queries over answers to route requests, restrictions and travel-time functions as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import osm as tags_of
from viaduct.functions import ttf
from viaduct.operators import answers, hierarchy, network, paths, restrictions, splits, timed
from viaduct.plans.mapdata import RESTRICTED, grid_ways, one_way_arcs
from viaduct.plans.registry import query
from viaduct.plans.relational import LG, ROWS, forbidden_turns, lg, path_arcs
from viaduct.plans.routes_files import PAIRS, pairs
from viaduct.plans.spatial_graph import FEW, ONE, few, one, relaxation, weighted
from viaduct.plans.turns_timed import STEP, TTF, ttfs
from viaduct.session import materialize, shared_folder
from viaduct.sources import grid
from viaduct.sources import osm as loader

LG_ARCS = "(SELECT from_arc AS tail, to_arc AS head, weight FROM lg)"
STARTS = "SELECT arc_id AS source FROM arcs WHERE head IN (SELECT DISTINCT (o_orderkey % 5) * 5 * 17 FROM orders)"


@query(
    "r05_turn_graph_coordinates",
    f"""{LG}, {relaxation(STARTS, 'weight', LG_ARCS)}, {PAIRS.replace("JOIN arcs b ON b.tail = o_custkey % 50 AND b.head > b.tail", "JOIN arcs b ON b.arc_id = CASE WHEN o_orderkey % 3 = 0 THEN a.arc_id ELSE (o_custkey % 50) * 4 + 3 END")},
    cyc AS (SELECT dist.source, min(d + weight) AS c FROM dist JOIN lg ON from_arc = node AND to_arc = dist.source GROUP BY dist.source)
    SELECT query_id, src_arc, dst_arc, src_arc = dst_arc AND dst_t >= src_t AS direct, CASE WHEN src_arc = dst_arc AND dst_t >= src_t THEN CASE WHEN dst_t = src_t THEN 0 ELSE CAST(floor(sw * (dst_t - src_t) + 0.5) AS BIGINT) END
      ELSE CASE WHEN src_arc = dst_arc THEN c ELSE d END - dw + CAST(floor(sw * (1 - src_t) + 0.5) AS BIGINT) + CAST(floor(dw * dst_t + 0.5) AS BIGINT) END AS cost
    FROM q LEFT JOIN dist ON source = src_arc AND node = dst_arc AND src_arc <> dst_arc LEFT JOIN cyc ON cyc.source = src_arc""",
)
def turn_graph_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    edges = lg(spark, sf_dir)
    o = grid.read(spark, sf_dir, "orders").selectExpr("o_orderkey", "(o_orderkey % 5) * 5 * 17 AS head", "o_orderkey % 2 AS odd", "o_custkey % 50 AS tail", "(o_orderkey % 10) / 10.0D AS src_t", "(o_custkey % 10) / 10.0D AS dst_t")
    # the arcs of 5 heads, as in pairs
    s = o.join(F.broadcast(arcs.where("head % 85 = 0 AND head <= 340").select(F.col("arc_id").alias("src_arc"), "head", (F.col("tail") % 2).alias("odd"))), ["head", "odd"])
    p = s.withColumn("dst_arc", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN src_arc ELSE tail * 4 + 3 END")).select(F.col("o_orderkey").alias("query_id"), "src_arc", "src_t", "dst_arc", "dst_t")
    starts = arcs.join(o.select("head").distinct(), "head", "left_semi").select(F.col("arc_id").alias("source"))
    dist = paths.distances(edges.select(F.col("from_arc").alias("tail"), F.col("to_arc").alias("head"), "weight"), starts, 4 * paths.CELL_NODES)
    return answers.turn_graph_costs(p, dist, edges, arcs).select("query_id", "src_arc", "dst_arc", "direct", "cost")


@query("r06_turn_graph_paths", f"{grid.WITH}, {ROWS}, k AS (SELECT path_id, pos, arc_id, count(*) OVER (PARTITION BY path_id) AS n FROM path_arcs WHERE arc_id IS NOT NULL), r AS (SELECT path_id, pos, arc_id, n, row_number() OVER (PARTITION BY path_id ORDER BY pos) - 1 AS q FROM k), m AS (SELECT path_id, count(*) FILTER (q BETWEEN 1 AND n - 2) AS arcs, min(CASE WHEN n > 2 AND q = 1 THEN tail WHEN n = 2 AND q = 0 THEN head END) AS first_node, max(CASE WHEN n > 2 AND q = n - 2 THEN head WHEN n = 2 AND q = 0 THEN head END) AS last_node FROM r JOIN arcs USING (arc_id) GROUP BY path_id) SELECT * FROM m")
def turn_graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths along rows, whose every seventh arc is a split node."""
    from pyspark.sql import Window

    order = Window.partitionBy("path_id").orderBy("pos")
    rows = path_arcs(spark, sf_dir).where("arc_id is not null").select("path_id", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), F.expr("CASE WHEN arc_id % 7 = 0 THEN arc_id + 100000000 ELSE arc_id END").alias("lg_node"))
    arcs = grid.arcs(spark, sf_dir)
    originals = arcs.select(F.col("arc_id").alias("lg_node"), "arc_id").union(arcs.select(F.col("arc_id") + 100000000, "arc_id"))
    found = answers.materialised(rows, originals, arcs)
    return found.select("path_id", F.size("route_arcs").cast("bigint").alias("arcs"), F.get("nodes", F.lit(0)).alias("first_node"), F.try_element_at("nodes", F.lit(-1)).alias("last_node"))


@query(
    "w04_around_via",
    f"""WITH s AS (SELECT l_orderkey AS path_id, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN l_linenumber = 1 THEN 0 ELSE min(l_partkey) % 50 + 1 END AS cost FROM lineitem GROUP BY l_orderkey, l_linenumber), a AS (SELECT *, sum(cost) OVER (PARTITION BY path_id ORDER BY pos) AS run FROM s),
    v AS (SELECT path_id, min(run) AS via_run, min(pos) AS via_pos, min(path_id % 40 + 5) AS half FROM a WHERE pos = 1 + path_id % 4 GROUP BY path_id),
    e AS (SELECT path_id, coalesce(max(pos) FILTER (pos <= via_pos AND run <= greatest(via_run - half, 0)), min(pos)) AS first_pos, coalesce(min(pos) FILTER (pos >= via_pos AND run >= via_run + half), max(pos)) AS last_pos FROM a JOIN v USING (path_id) GROUP BY path_id)
    SELECT path_id, first_pos, last_pos, CAST(y.run - x.run AS BIGINT) AS cost FROM e JOIN a x USING (path_id) JOIN a y USING (path_id) WHERE x.pos = first_pos AND y.pos = last_pos""",
)
def around_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grid.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").cast("bigint").alias("pos")).agg(F.min("l_partkey").alias("part"))
    steps = lines.select("path_id", "pos", F.col("pos").alias("node"), F.expr("CASE WHEN pos = 1 THEN 0 ELSE part % 50 + 1 END").alias("cost"))
    half = lines.select("path_id").distinct().selectExpr("path_id", "1 + path_id % 4 AS via", "path_id % 40 + 5 AS half")
    return answers.around_via(steps, half).select("path_id", "first_pos", "last_pos", F.col("cost").cast("bigint").alias("cost"))


@query("p12_filtered_distances", f"{grid.WITH}, {relaxation(ONE, arcs='(SELECT * FROM arcs WHERE arc_id % 17 <> 3 AND travel_time < 6000)')} SELECT node, d AS dist FROM dist")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.distances(weighted(spark, sf_dir).where("arc_id % 17 <> 3 AND weight < 6000"), one(spark)).select("node", "dist")


@query("p17_request_limits", "SELECT o_orderkey, CASE WHEN o_orderkey % 14 < 1 THEN 'no_routes' WHEN o_orderkey % 14 > 10 THEN 'too_many_routes' WHEN o_custkey % 9 > o_orderkey % 8 THEN 'invalid_box' END AS error FROM orders")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "orders")
    box = {"min_lat": F.expr("o_custkey % 9"), "max_lat": F.expr("o_orderkey % 8"), "min_lng": F.lit(0), "max_lng": F.lit(0)}
    return rows.select("o_orderkey", answers.request_error(F.expr("o_orderkey % 14"), box).alias("error"))


@query("p09_kept_by_bits", f"{grid.WITH} SELECT arc_id, bit_count(tail) % 2 = 1 AS kept FROM arcs")
def kept_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    bits = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("pos"), (F.bit_count("node_id") % 2 == 1).alias("bit"))
    out = lambda keep: answers.kept_by_bits(arcs, bits, "tail", keep).select("arc_id", F.lit(keep).alias("kept"))
    return out(True).union(out(False))


@query("u05_merged_neighbours", f"{grid.WITH}, n AS (SELECT tail AS a, list(head ORDER BY head) AS l FROM arcs GROUP BY tail) SELECT arc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(coalesce(x.l, []), coalesce(y.l, []))), lambda v: v <> tail AND v <> head)), ',') AS neighbours FROM arcs LEFT JOIN n x ON x.a = tail LEFT JOIN n y ON y.a = head")
def merged_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir).select("arc_id", "tail", "head")
    lists = arcs.groupBy("tail").agg(F.sort_array(F.collect_list("head")).alias("l"))
    rows = arcs.join(lists.withColumnRenamed("l", "a"), "tail", "left").join(lists.select(F.col("tail").alias("head"), F.col("l").alias("b")), "head", "left")
    empty = F.array().cast("array<bigint>")
    found = answers.merged_neighbours(F.coalesce("a", empty), F.coalesce("b", empty), F.array("tail", "head"))
    return rows.select("arc_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("neighbours"))


@query("t08_permuted_values", f"{grid.WITH} SELECT (node_id * 7 + 3) % (SELECT count(*) FROM nodes) AS pos, size AS value FROM nodes")
def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid.nodes(spark, sf_dir)
    order = nodes.join(F.broadcast(nodes.agg(F.count("*").alias("n")))).select(F.col("node_id").alias("pos"), F.expr("(node_id * 7 + 3) % n").alias("rank"))  # n is one row
    return answers.permuted(nodes.select(F.col("node_id").alias("pos"), F.col("size").alias("value")), order)


@query("a12_unified_parallels", f"{grid.WITH}, d AS (SELECT arc_id, tail, head, travel_time FROM arcs UNION ALL SELECT arc_id + 1000000, tail, head, travel_time - arc_id % 3 FROM arcs) SELECT arc_id, min(travel_time) OVER (PARTITION BY tail, head) AS travel_time FROM d")
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir).select("arc_id", "tail", "head", "travel_time")
    return network.unify_parallel(arcs.union(arcs.selectExpr("arc_id + 1000000", "tail", "head", "travel_time - arc_id % 3"))).select("arc_id", "travel_time")


@query("r12_turn_diagnosis", f"{LG} SELECT p.from_arc, p.to_arc, CASE WHEN (p.from_arc * 3 + p.to_arc * 5) % 37 = 0 THEN 'forbidden' ELSE 'allowed' END AS status, turn_cost FROM pairs p LEFT JOIN lg USING (from_arc, to_arc)")
def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = grid.nodes(spark, sf_dir).select("node_id")
    found = answers.diagnosis(grid.arcs_with_ends(spark, sf_dir), lg(spark, sf_dir), forbidden_turns(grid.arcs(spark, sf_dir)), near)
    return found.select("from_arc", "to_arc", "status", "turn_cost")


@query("r13_profiles", f"{grid.WITH} SELECT arc_id, travel_time * 2 AS weight, 'bicycle,car' AS profiles FROM arcs")
def by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}"
    arcs = grid.arcs(spark, sf_dir)
    rows = arcs.select(F.lit("car").alias("profile"), "arc_id", F.col("travel_time").alias("weight")).union(arcs.select(F.lit("bicycle"), "arc_id", F.col("travel_time") * 2))
    rows.write.partitionBy("profile").parquet(folder)
    return answers.of_profile(spark, folder, "bicycle").withColumn("profiles", F.lit(",".join(answers.profiles(spark, folder))))


UPDATED = "up AS (SELECT arc_id, tail, head, CASE WHEN arc_id % 19 = 0 THEN NULL WHEN arc_id % 7 = 0 THEN travel_time * 2 ELSE travel_time END AS travel_time FROM arcs), live AS (SELECT * FROM up WHERE travel_time IS NOT NULL)"


@query("r14_link_queries", f"{grid.WITH}, {UPDATED}, {relaxation(FEW, arcs='live')}, {PAIRS.replace('JOIN arcs a', 'JOIN live a').replace('JOIN arcs b', 'JOIN live b')} SELECT query_id, src_arc, dst_arc, CASE WHEN src_arc = dst_arc AND dst_t >= src_t THEN CAST(floor(sw * (dst_t - src_t) + 0.5) AS BIGINT) ELSE CAST(floor(sw * (1 - src_t) + 0.5) AS BIGINT) + d + CAST(floor(dw * dst_t + 0.5) AS BIGINT) END AS cost FROM q LEFT JOIN dist ON source = sh AND node = dt")
def link_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs(spark, sf_dir)
    updates = arcs.where("arc_id % 19 = 0 OR arc_id % 7 = 0").select("arc_id", F.expr("CASE WHEN arc_id % 19 = 0 THEN -1 ELSE travel_time * 2 END").alias("live"))
    p = pairs(spark, sf_dir).withColumn("query_id", F.struct("query_id", "src_arc", "dst_arc"))
    found = answers.link_costs(p, arcs, updates, paths.distances)
    return found.select("query_id.query_id", "query_id.src_arc", "query_id.dst_arc", "cost")


@query("a33_random_queries")
def random_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.random_queries(grid.nodes(spark, sf_dir), 1000, 42)


@query("g14_breadth_first_order", f"{grid.WITH}, hop AS (SELECT tail, head, CAST(1 AS BIGINT) AS travel_time FROM arcs), {relaxation(ONE, arcs='hop')} SELECT node, row_number() OVER (ORDER BY d, node) - 1 AS rank FROM dist")
def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.breadth_first_order(grid.arcs(spark, sf_dir), one(spark))


@query("g29_hierarchy_stats")
def hierarchy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.stats(hierarchy.contract(weighted(spark, sf_dir).select("tail", "head", "weight"), hierarchy.order(grid.nodes(spark, sf_dir), 0.001), 3))


@query("g33_penalty_routes")
def penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = few(spark, sf_dir).where("source > 0").select(F.col("source").alias("query_id"), F.lit(0).cast("bigint").alias("source"), F.col("source").alias("target"))
    return answers.penalty_routes(weighted(spark, sf_dir), queries, 3)


@query("d09_sampled_arrivals")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals at all nodes over the arcs that are best in one of four windows of the day."""
    timed_arcs = ttfs(spark, sf_dir)
    targets = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("node"))
    return paths.arrivals(answers.sampled_subgraph(timed_arcs, one(spark), targets), one(spark), 28_000_000)


@query("d07_d08_reduced_functions", f"{grid.WITH}, {TTF} SELECT arc_id, min(tt) AS least, count(*) AS points, min(CASE WHEN i = 0 AND arc_id % 3 = 0 THEN 1 ELSE tt END) AS least_fixed FROM f GROUP BY arc_id")
def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ttfs(spark, sf_dir)
    closed = F.concat("ttf", F.array(F.struct(F.lit(ttf.DAY_MS).cast("bigint").alias("dt"), F.get("ttf", F.lit(0))["tt"].alias("tt"))))
    zero = F.transform("ttf", lambda p: F.struct(p["dt"].alias("dt"), F.when((p["dt"] == 0) & (F.col("arc_id") % 3 == 0), 0).otherwise(p["tt"]).alias("tt")))
    return rows.select("arc_id", F.get(ttf.constant_lower(F.col("ttf")), F.lit(0))["tt"].alias("least"), F.size(ttf.without_period_end(closed)).cast("bigint").alias("points"), timed.bounds(ttf.no_zero(zero))[0].alias("least_fixed"))


HOUR = 3_600_000
SPANS = [(start, start + hours) for start in range(6, 22) for hours in (1, 2, 4, 8) if start + hours <= 22]


@query(
    "d10_interval_minima",
    f"""{grid.WITH}, {TTF}, s(a, b) AS (VALUES {", ".join(f"({a * HOUR}, {b * HOUR})" for a, b in SPANS)}), e AS (SELECT f.arc_id, a AS span_start, b AS span_end, t, f.tt + CAST(floor((g.tt - f.tt) * (t - f.dt) / {STEP}::DOUBLE) AS BIGINT) AS tt FROM s, (SELECT a AS t FROM s UNION SELECT b FROM s) AS x JOIN f ON f.i = t // {STEP} JOIN f g ON g.arc_id = f.arc_id AND g.i = (f.i + 1) % 6 WHERE t = a OR t = b),
    m AS (SELECT arc_id, span_start, span_end, tt FROM e UNION ALL SELECT arc_id, a, b, tt FROM f JOIN s ON dt BETWEEN a AND b) SELECT arc_id, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end, min(tt) AS least FROM m GROUP BY 1, 2, 3""",
)
def interval_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed.interval_minima(ttfs(spark, sf_dir).select("arc_id", "ttf"), [(a * HOUR, b * HOUR) for a, b in SPANS]).select("arc_id", "span_start", "span_end", "least")


@query("d17_window_averages", f"{grid.WITH}, {TTF}, v AS (SELECT arc_id, max(tt) FILTER (i = 0) AS p0, max(tt) FILTER (i = 1) AS p1, max(tt) FILTER (i = 2) AS p2, max(tt) FILTER (i = 5) AS p5 FROM f GROUP BY arc_id), x AS (SELECT *, p5 + CAST(floor((p0 - p5) * {2 * HOUR} / {STEP}::DOUBLE) AS BIGINT) AS u, p1 + CAST(floor((p2 - p1) * {HOUR} / {STEP}::DOUBLE) AS BIGINT) AS w FROM v) SELECT arc_id, ((u + p0) * {2 * HOUR} + (p0 + p1) * {STEP} + (p1 + w) * {HOUR}) // {2 * 7 * HOUR} AS night FROM x")
def window_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean from 22 to 5 o'clock, over midnight."""
    return ttfs(spark, sf_dir).select("arc_id", ttf.average(F.col("ttf"), 22 * HOUR, 5 * HOUR).alias("night"))


@query("f49_speed_profiles")
def speed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = F.expr("transform(sequence(0, 7), i -> named_struct('at', i * 10800000L, 'kmh', 20 + (arc_id * (i + 3)) % 60))")
    found = grid.arcs(spark, sf_dir).select("arc_id", ttf.speed_profile(speeds, F.col("geo_distance") * 50).alias("ttf"))
    return found.select("arc_id", F.posexplode("ttf").alias("pos", "p")).select("arc_id", F.col("pos").cast("bigint").alias("pos"), "p.dt", "p.tt")


AT = 31_000_000



@query("d11_linked_functions", f"{LG}, {TTF}, k AS (SELECT a.arc_id, a.tt + (b.tt - a.tt) * ({AT} - a.dt) / {STEP}::DOUBLE AS x, a.dt FROM f a JOIN f b ON b.arc_id = a.arc_id AND b.i = a.i + 1 WHERE a.i = {AT // STEP}), l AS (SELECT from_arc, to_arc, x, {AT} + x AS t FROM lg JOIN k ON k.arc_id = from_arc), r AS (SELECT from_arc, to_arc, l.x + a.tt + (b.tt - a.tt) * (t - a.dt) / {STEP}::DOUBLE AS linked FROM l JOIN f a ON a.arc_id = to_arc AND a.i = CAST(floor(t / {STEP}) AS BIGINT) JOIN f b ON b.arc_id = to_arc AND b.i = a.i + 1), g AS (SELECT from_arc, to_arc, least(k.x, m.x) AS merged FROM lg JOIN k ON k.arc_id = from_arc JOIN k m ON m.arc_id = to_arc) SELECT from_arc, to_arc, CAST(floor(linked * 10 + 0.48371) AS BIGINT) AS linked, CAST(floor(merged * 10 + 0.48371) AS BIGINT) AS merged FROM r JOIN g USING (from_arc, to_arc)")
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of two arcs in a row, linked and merged, at one time."""
    f = ttfs(spark, sf_dir).select("arc_id", "ttf")
    rows = lg(spark, sf_dir).join(f.toDF("from_arc", "f"), "from_arc").join(f.toDF("to_arc", "g"), "to_arc")
    tenth = lambda x: F.floor(10 * ttf.value_at(x, F.lit(float(AT))) + 0.48371)  # no value falls on a border
    return rows.select("from_arc", "to_arc", tenth(ttf.link("f", "g")).alias("linked"), tenth(ttf.merge("f", "g")).alias("merged"))


@query("d25_directed_arcs", f"{grid.WITH}, r AS (SELECT node_id // 50 AS id, node_id, node_id % 50 AS pos, lat, lng FROM nodes UNION ALL SELECT 1000000 + node_id % 50, node_id, node_id // 50, lat, lng FROM nodes WHERE node_id % 50 % 7 = 0), u AS (SELECT *, count(*) OVER (PARTITION BY node_id) AS uses, max(pos) OVER (PARTITION BY id) AS last FROM r WHERE id % 3 <> 1 AND id IN (SELECT id FROM r GROUP BY id HAVING count(*) > 1)), e AS (SELECT *, lead(node_id) OVER (PARTITION BY id ORDER BY pos) AS head FROM u WHERE uses > 1 OR pos = 0 OR pos = last) SELECT id AS way_id, node_id AS tail, head, FALSE AS antiparallel FROM e WHERE head IS NOT NULL UNION ALL SELECT id, head, node_id, TRUE FROM e WHERE head IS NOT NULL AND id % 3 = 0")
def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of a profile that leaves out every third one and opens another third in both directions."""
    tags = F.create_map(F.lit("highway"), F.expr("CASE WHEN id % 3 = 1 THEN 'steps' ELSE 'residential' END"), F.lit("oneway"), F.expr("CASE WHEN id % 3 = 0 THEN 'no' ELSE 'yes' END"))
    ways = grid_ways(spark, sf_dir).withColumn("tags", tags)
    nodes = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), "lat", "lng")
    t = F.col("tags")
    return loader.directed_arcs(ways, nodes, tags_of.used_by_cars(t), tags_of.car_direction(t), tags_of.car_speed(t)).select("way_id", "tail", "head", "antiparallel")


@query("g31_split_chains", f"{LG}, c AS (SELECT x.from_arc AS a, x.to_arc AS b, y.to_arc AS d, row_number() OVER (ORDER BY x.from_arc, x.to_arc, y.to_arc) AS n FROM lg x JOIN lg y ON y.from_arc = x.to_arc WHERE x.from_arc % 41 = 0 AND x.to_arc = x.from_arc + 4 AND y.to_arc = x.from_arc + 8), f AS (SELECT from_arc AS from_node, CASE WHEN EXISTS (SELECT 1 FROM c WHERE a = from_arc AND b = to_arc) THEN 100000000 + to_arc ELSE to_arc END AS to_node, weight FROM lg UNION ALL SELECT 100000000 + b, to_arc, weight FROM c JOIN lg ON from_arc = b AND to_arc <> d) SELECT CASE WHEN from_node >= 100000000 THEN from_node - 100000000 ELSE from_node END AS from_arc, CASE WHEN to_node >= 100000000 THEN to_node - 100000000 ELSE to_node END AS to_arc, from_node >= 100000000 AS from_split, to_node >= 100000000 AS to_split, weight FROM f")
def split_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arcs in a row to the right, from every 41st one on, may not follow each other."""
    edges = materialize(lg(spark, sf_dir), "turns").hint("merge")  # read four times
    x = edges.where("from_arc % 41 = 0 AND to_arc = from_arc + 4").select("from_arc", "to_arc")
    y = edges.where("to_arc = from_arc + 4").select(F.col("from_arc").alias("to_arc"), F.col("to_arc").alias("last"))
    chains = x.join(y, "to_arc").select(F.col("from_arc").alias("chain_id"), F.array("from_arc", "to_arc", "last").alias("arcs"), F.lit(False).alias("mandatory"))
    found, nodes = splits.split_chains(edges.select(F.col("from_arc").alias("from_node"), F.col("to_arc").alias("to_node"), "weight"), chains, 100_000_000)
    side = lambda c: nodes.select(F.col("node").alias(f"{c}_node"), F.col("orig").alias(f"{c}_orig"))
    rows = found.join(side("from"), "from_node", "left").join(side("to"), "to_node", "left")
    return rows.select(F.coalesce("from_orig", "from_node").alias("from_arc"), F.coalesce("to_orig", "to_node").alias("to_arc"), F.col("from_orig").isNotNull().alias("from_split"), F.col("to_orig").isNotNull().alias("to_split"), "weight")


def conditional_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations at junctions: conditional ones, some with a motor car tag that goes first, and plain ones."""
    arcs = one_way_arcs(spark, sf_dir)
    b = arcs.where("head > tail").select(F.col("tail").alias("via"), F.col("way_id").alias("tw"))
    rows = arcs.where("arc_id % 9 = 0").select("arc_id", F.col("way_id").alias("fw"), F.col("head").alias("via")).join(b, "via").where("tw <> fw")
    member = lambda kind, c, role: F.struct(F.lit(kind).alias("type"), F.col(c).alias("id"), F.lit(role).alias("role"))
    pair = lambda key, value, when: F.when(F.expr(when), F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")))
    tags = F.map_from_entries(F.array_compact(F.array(
        pair("type", "restriction", "arc_id % 13 <> 0"), pair("restriction", "no_u_turn", "true"),
        pair("restriction:conditional", "no_left_turn @ (Mo-Fr 07:00-09:00)", "arc_id % 2 = 0"), pair("restriction:motorcar:conditional", "only_straight_on @ (Sa 10:00-12:00)", "arc_id % 5 = 0"),
    )))
    return rows.select(F.col("arc_id").alias("id"), tags.alias("tags"), F.array(member("way", "fw", "from"), member("node", "via", "via"), member("way", "tw", "to")).alias("members"))


SCANNED = RESTRICTED.split(", f AS (")[0].replace("rel AS", "rel0 AS") + ", sc AS (SELECT relation_id, CASE WHEN relation_id % 5 = 0 THEN 'mandatory' ELSE 'prohibitive' END AS kind, CASE WHEN relation_id % 5 = 0 THEN 'straight_on' ELSE 'left_turn' END AS direction, fw AS from_way, tw AS to_way, via AS via_node, CASE WHEN relation_id % 5 = 0 THEN 'Sa 10:00-12:00' ELSE 'Mo-Fr 07:00-09:00' END AS condition FROM rel0 WHERE relation_id % 13 <> 0 AND (relation_id % 2 = 0 OR relation_id % 5 = 0))"


@query("d27_conditional_scan", f"{grid.WITH}, {SCANNED} SELECT * FROM sc")
def conditional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restrictions.scan(conditional_relations(spark, sf_dir)).drop("via_ways")


@query("j25_conditional_turns", f"{grid.WITH}, {SCANNED}, p AS (SELECT kind, condition, via_node, x.arc_id AS from_arc, y.arc_id AS to_arc FROM sc JOIN arcs2 x ON x.way_id = from_way AND x.head = via_node JOIN arcs2 y ON y.way_id = to_way AND y.tail = via_node) SELECT from_arc, to_arc, condition FROM p WHERE kind = 'prohibitive' UNION SELECT from_arc, z.arc_id, condition FROM p JOIN arcs z ON z.tail = via_node AND z.arc_id <> to_arc WHERE kind = 'mandatory'")
def conditional_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = grid.arcs_with_ends(spark, sf_dir).withColumn("way_id", F.col("way_id") * 2 + F.col("antiparallel").cast("bigint"))
    return restrictions.conditional_turns(restrictions.scan(conditional_relations(spark, sf_dir)), arcs)


@query("j24_via_way_chains", f"{grid.WITH} SELECT a.head AS junction, a.arc_id * 10 + CAST(a.tail % 2 AS BIGINT) AS relation_id, concat_ws(',', a.arc_id, b.arc_id, c.arc_id, d.arc_id) AS arcs, a.tail % 2 = 1 AS mandatory FROM arcs a JOIN arcs b ON b.tail = a.head AND b.head = a.head + 50 JOIN arcs c ON c.tail = b.head AND c.head = b.head + 50 JOIN arcs d ON d.tail = c.head AND d.head = c.head + 1 WHERE a.head = a.tail + 1")
def via_way_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each row, two steps down a column, and on along the row there: the way between has an arc of its own between the junctions."""
    arcs = grid.arcs_with_ends(spark, sf_dir).withColumn("way_id", F.col("way_id") * 2 + F.col("antiparallel").cast("bigint"))
    member = lambda c, role: F.struct(F.lit("way").alias("type"), c.alias("id"), F.lit(role).alias("role"))
    row = lambda node: F.expr(f"({node} div 50) * 2")
    members = F.array(member(row("head"), "from"), member(F.expr("(1000000 + head % 50) * 2"), "via"), member(row("(head + 100)"), "to"))
    tags = F.create_map(F.lit("type"), F.lit("restriction"), F.lit("restriction"), F.when(F.col("tail") % 2 == 1, "only_straight_on").otherwise("no_straight_on"))
    rel = arcs.where("head = tail + 1").select(F.expr("arc_id * 10 + tail % 2").alias("id"), tags.alias("tags"), members.alias("members"))
    found = restrictions.via_way_chains(restrictions.scan(rel), arcs)
    out = found.select(F.col("key.relation_id").alias("relation_id"), "mandatory", F.array_join(F.transform("arcs", lambda x: x.cast("string")), ",").alias("arcs"), F.get("arcs", F.lit(0)).alias("arc_id"))
    return out.join(arcs.select("arc_id", F.col("head").alias("junction")), "arc_id").select("junction", "relation_id", "arcs", "mandatory")
