"""Queries over feeds, exchange formats, caches and reports: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.plans.registry import query
from viaduct.plans.relational import LG, lg, row_paths
from viaduct.plans.spatial_graph import weighted
from viaduct.plans.turns_timed import TTF, ttfs
from viaduct.session import shared_folder
from viaduct.sources import feeds, files, grid, pbf


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def navigation(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the four navigation tables, with the arcs to the right and down as links."""
    folder = fresh(spark, "navigation")
    arcs, nodes = grid.arcs(spark, sf_dir).where("head > tail"), grid.nodes(spark, sf_dir)
    hundred = lambda c: f"CAST(round({c} * 100000) AS BIGINT)"
    filled = lambda last, values: F.concat_ws("\t", *[F.coalesce(values.get(i, F.lit("")).cast("string"), F.lit("")) for i in range(last + 1)])
    arcs.select(F.concat_ws("\t", "arc_id", "tail", "head").alias("value")).write.text(f"{folder}/rdf_link/rdf_link.txt")
    direction = F.expr("CASE arc_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'T' ELSE 'B' END")
    limit = lambda n: F.expr(f"CASE WHEN arc_id % {n} = 0 THEN 30 END")
    nav = filled(26, {0: F.col("arc_id"), 4: F.expr("arc_id % 5 + 1"), 6: direction, 19: F.expr("arc_id % 8 + 1"), 25: limit(4), 26: limit(6)})
    arcs.where("arc_id % 11 <> 5").select(nav.alias("value")).write.text(f"{folder}/rdf_nav_link/rdf_nav_link.txt")
    nodes.select(F.concat_ws("\t", "node_id", F.expr(hundred("lat")), F.expr(hundred("lng")), F.lit("x")).alias("value")).write.text(f"{folder}/rdf_node/rdf_node.txt")
    ends = grid.arcs_with_ends(spark, sf_dir).where("head > tail AND arc_id % 2 = 0")
    points = F.array(*[F.concat_ws("\t", F.col("arc_id"), F.lit(n), F.expr(hundred(f"{c}_lat")) + 30 * (n == 1), F.expr(hundred(f"{d}_lng"))) for n, c, d in ((0, "tail", "tail"), (1, "tail", "head"), (2, "head", "head"))])
    ends.select(F.explode(points).alias("value")).write.text(f"{folder}/adas_link_geometry/adas_link_geometry.txt")
    return folder


DIRECTED = """l AS (SELECT * FROM arcs WHERE head > tail AND arc_id % 11 <> 5), lim AS (SELECT *, CASE WHEN arc_id % 4 = 0 THEN 30 ELSE 999 END AS lf, CASE WHEN arc_id % 6 = 0 THEN 30 ELSE 999 END AS lt, [36.11, 31.94, 26.388, 22.22, 16.66, 11.11, 5.55, 1.38][arc_id % 8 + 1] AS own FROM l),
  dir AS (SELECT arc_id * 2 AS arc_id, arc_id AS link_id, 'F' AS direction, tail, head, least(own, lf / 3.6) AS speed FROM lim WHERE arc_id % 3 <> 1 UNION ALL SELECT arc_id * 2 + 1, arc_id, 'T', head, tail, least(own, lt / 3.6) FROM lim WHERE arc_id % 3 <> 0)"""


@query("s20_d22_navigation", f"{grid.WITH}, {DIRECTED} SELECT arc_id, link_id, direction, tail, head, link_id % 5 + 1 AS functional_class, CAST(round(100 * speed) AS BIGINT) AS speed_cm FROM dir")
def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = navigation(spark, sf_dir)
    tables = [feeds.read_navigation(spark, folder, t) for t in feeds.TABLES]
    arcs, _ = feeds.import_navigation(*tables, box=(0, 0, 9_000_000, 18_000_000))
    # the times are whole milliseconds, so a speed is known to a part in some thousand
    speed = F.expr("round(100 * least(element_at(array(36.11D, 31.94D, 26.388D, 22.22D, 16.66D, 11.11D, 5.55D, 1.38D), CAST(link_id % 8 + 1 AS INT)), CASE WHEN (direction = 'F' AND link_id % 4 = 0) OR (direction = 'T' AND link_id % 6 = 0) THEN 30 / 3.6D ELSE 999 END))")
    near = F.abs(F.col("travel_time") - 100_000 * F.col("length_m") / speed) <= 0.6 + F.col("travel_time") / 100
    return arcs.select("arc_id", "link_id", "direction", "tail", "head", F.col("functional_class").cast("bigint").alias("functional_class"), F.when(near, speed).cast("bigint").alias("speed_cm"))


@query("d23_k18_link_ids", f"{grid.WITH}, {DIRECTED} SELECT tail, head, link_id, direction FROM dir")
def link_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = navigation(spark, sf_dir)
    links = feeds.read_navigation(spark, folder, "rdf_link").join(feeds.read_navigation(spark, folder, "rdf_nav_link"), "link_id")
    path = fresh(spark, "links")
    feeds.write_links_csv(feeds.link_ids(links).withColumn("length_m", F.lit(1.0)), path)
    return spark.read.option("header", True).csv(path).select(F.col("tail").cast("bigint"), F.col("head").cast("bigint"), F.col("linkId").cast("bigint").alias("link_id"), "direction")


@query("s25_traces", "SELECT user_id AS link_id, event_id % 2 = 0 AS ahead, count(*) AS samples, count(*) FILTER (event_id % 17 <> 0) AS with_speed, CAST(max(event_id) AS BIGINT) AS last_t FROM events GROUP BY 1, 2")
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "traces")
    rows = grid.read(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 17 = 0 THEN 'none' ELSE CAST(value / 3.6 AS STRING) END AS mm_speed_mps", "event_id AS timestampUTC_ms", "'x' AS other", "user_id AS mm_linkId", "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS mm_isFromRef")
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    found = feeds.read_traces(spark, path)
    return found.groupBy("link_id", (F.col("direction") == "F").alias("ahead")).agg(F.count("*").alias("samples"), F.count("kmh").alias("with_speed"), F.max("t").alias("last_t"))


@query("s26_timed_graph", f"{grid.WITH}, {TTF} SELECT tail, head, count(*) AS points, CAST(sum(floor(tt / 1000.0::DOUBLE * 1000)) AS BIGINT) AS total, max(dt) AS last FROM f JOIN arcs USING (arc_id) GROUP BY tail, head")
def timed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "timed")
    feeds.write_timed_graph(ttfs(spark, sf_dir)).write.text(path)
    rows = feeds.read_timed_graph(spark.read.text(path))
    total = F.aggregate("ttf", F.lit(0).cast("bigint"), lambda have, p: have + p["tt"])
    return rows.select("tail", "head", F.size("ttf").cast("bigint").alias("points"), total.alias("total"), F.element_at("ttf", -1)["dt"].alias("last"))


@query("s29_k11_cache", f"{grid.WITH} SELECT arc_id, travel_time, FALSE AS stale FROM arcs")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cached for one graph is found for it, in whatever order, and not for a changed one."""
    path, arcs = fresh(spark, "cache"), grid.arcs(spark, sf_dir)
    feeds.save_cache({"metric": arcs.select("arc_id", "travel_time")}, path, arcs)
    stale = feeds.load_cache(path, arcs.where("arc_id > 3")) is not None
    return feeds.load_cache(path, arcs.repartition(3))["metric"].withColumn("stale", F.lit(stale))


@query("s30_query_sets", "SELECT c_custkey % 97 AS from_node, c_custkey % 89 AS to_node, count(*) AS queries FROM customer GROUP BY 1, 2")
def query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "queries")
    rows = grid.read(spark, sf_dir, "customer").selectExpr("c_custkey % 97 AS from_node", "c_custkey % 89 AS to_node", "array(20.9D, 105.7D) AS from_coords")
    feeds.write_queries(rows, path)
    return feeds.read_queries(spark, path).groupBy("from_node", "to_node").agg(F.count("*").alias("queries"))


@query("k04_turn_graph_folder", f"{LG} SELECT from_arc, to_arc, weight, turn_cost FROM lg")
def turn_graph_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "turns")
    feeds.save_turn_graph(grid.arcs(spark, sf_dir).select(F.col("arc_id").alias("lg_node"), "arc_id"), lg(spark, sf_dir), folder)
    return feeds.load_graph(spark, folder)["arcs"].select("from_arc", "to_arc", "weight", "turn_cost")


@query("s06_s05_graph_folder", f"{grid.WITH} SELECT arc_id, tail, head, lat, lng FROM arcs JOIN nodes ON node_id = tail")
def graph_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph lies one folder deeper than asked for."""
    folder = fresh(spark, "graph")
    feeds.save_graph(grid.nodes(spark, sf_dir), grid.arcs(spark, sf_dir), f"{folder}/graph")
    found = feeds.load_graph(spark, folder)
    return found["arcs"].join(found["nodes"].select(F.col("node_id").alias("tail"), "lat", "lng"), "tail").select("arc_id", "tail", "head", "lat", "lng")


@query("k15_drawings", f"{grid.WITH} SELECT printf('%d -> %d[label=\"%d\"];', tail, head, travel_time) AS value FROM arcs")
def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.dot(weighted(spark, sf_dir))


@query("k15_svg_lines", f"{grid.WITH} SELECT round(tail_lng * 1000 - 105700) AS x, count(*) AS lines FROM arcs GROUP BY 1")
def svg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = {"min_lat": 20.9, "max_lat": 21.9, "min_lng": 105.7, "max_lng": 106.0}
    at = F.regexp_extract("value", r'x1="([0-9.-]+)"', 1).cast("double")
    return feeds.svg(grid.arcs_with_ends(spark, sf_dir), box, 300).groupBy(F.round(at).alias("x")).agg(F.count("*").alias("lines"))


@query("k19_reports", "SELECT o_orderpriority AS program, count(*) AS runs, CAST(sum(o_orderkey) AS BIGINT) AS total, 'r1' AS git_revision FROM orders GROUP BY 1")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS program", "o_orderkey AS run", "'running_time_ms' AS key", "o_orderkey AS value")
    doc = F.from_json("value", "program string, git_revision string, algo_runs array<map<string,bigint>>")
    found = feeds.report(rows, git_revision="r1").select(doc.alias("d")).select("d.*")
    total = F.aggregate("algo_runs", F.lit(0).cast("bigint"), lambda have, r: have + r["running_time_ms"])
    return found.select("program", F.size("algo_runs").cast("bigint").alias("runs"), total.alias("total"), "git_revision")


@query("k10_k07_answer_files", f"{grid.WITH} SELECT node_id AS query_id, node_id * 10 AS distance_ms, CAST(13 AS BIGINT) AS points FROM nodes WHERE node_id % 50 = 0")
def answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON and as GeoJSON, read again and put together."""
    point = "named_struct('lat', 20.9D + (x div 50) * 0.001D, 'lng', 105.7D + (x % 50) * 0.001D)"
    rows = row_paths(spark, sf_dir).select(F.col("path_id").alias("query_id"), F.expr(f"transform(nodes, x -> {point})").alias("points"), (F.col("path_id") * 10).alias("distance_ms"), F.col("path_id").cast("double").alias("distance_m"))
    plain, shapes = fresh(spark, "answers"), fresh(spark, "answers")
    feeds.route_files(rows, plain)
    feeds.route_files(rows, shapes, geojson=True)
    texts = spark.read.text(shapes).select(F.get_json_object("value", "$.properties.distance_ms").cast("bigint").alias("distance_ms"), F.col("value").alias("geojson"))
    parsed = files.parse_routes(texts.withColumnRenamed("distance_ms", "name")).select(F.col("name").alias("distance_ms"), F.size("points").cast("bigint").alias("points"))
    return spark.read.json(plain).select("query_id", "distance_ms").join(parsed, "distance_ms").select("query_id", "distance_ms", "points")


@query("k09_route_collections", "SELECT o_custkey AS query_id, count(*) AS routes, least(count(*), 5) AS colours FROM orders GROUP BY 1")
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    point = F.array(F.struct(F.lit(20.9).alias("lat"), F.lit(105.7).alias("lng")), F.struct(F.lit(21.0).alias("lat"), F.lit(105.8).alias("lng")))
    rows = grid.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), index.alias("route_index"), point.alias("points"), F.col("o_orderkey").alias("distance_ms"), F.lit(1.0).alias("distance_m"))
    found = files.routes_geojson(rows).select("query_id", F.from_json("geojson", "features array<struct<properties:struct<stroke:string>>>").alias("d"))
    return found.select("query_id", F.size("d.features").cast("bigint").alias("routes"), F.size(F.array_distinct(F.transform("d.features", lambda f: f["properties"]["stroke"]))).cast("bigint").alias("colours"))


@query("s21_s24_speed_feeds", "SELECT l_partkey AS \"from\", l_suppkey AS \"to\", CAST(l_linenumber AS DOUBLE) * 10 AS kmh, l_linenumber % 3 <> 0 AS varied FROM lineitem")
def speed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live speeds of every line, and which of them a day's feed keeps: constant days go."""
    rows = grid.read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("k"))
    live = files.read_live_speeds(rows.select(F.concat_ws(",", "l_partkey", "l_suppkey", F.col("l_linenumber") * 10).alias("value")))
    day = rows.select("l_partkey", "l_linenumber").distinct().select(F.concat_ws(",", "l_partkey", "l_linenumber", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(288)), lambda i: F.when((F.col("l_linenumber") % 3 != 0) & (i == 7), "90").otherwise("40")), ",")).alias("value"))
    kept = files.read_day_speeds(day).select("from", (F.col("to") * 10).cast("double").alias("kmh"), F.lit(True).alias("v"))
    return live.join(kept, ["from", "kmh"], "left").select("from", "to", "kmh", F.coalesce("v", F.lit(False)).alias("varied"))


@query("a23_described_runs", """WITH r AS (SELECT o_orderkey AS q, (o_orderkey * 7 % 1000 + 1)::DOUBLE AS a, (o_orderkey * 11 % 900 + 1)::DOUBLE AS b FROM orders), s AS (SELECT 'baseline' AS series, a AS v FROM r UNION ALL SELECT 'compare', b FROM r UNION ALL SELECT 'difference', b - a FROM r UNION ALL SELECT 'ratio', b / a FROM r)
SELECT series, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM s GROUP BY series""")
def described_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "orders")
    found = feeds.compared_runs(rows.selectExpr("o_orderkey AS query_id", "o_orderkey * 7 % 1000 + 1 AS ms"), rows.selectExpr("o_orderkey AS query_id", "o_orderkey * 11 % 900 + 1 AS ms"))
    return found.select("series", "count", *[F.round(c, 6).alias(c) for c in feeds.STATISTICS[1:]])


@query("a24_compared_profiles", f"{LG}, c AS (SELECT 1 AS n, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM arcs) AS arcs, (SELECT count(*) FROM pairs) - (SELECT count(*) FROM lg) AS turns, (SELECT min(travel_time) FROM arcs) AS a, (SELECT max(travel_time) FROM arcs) AS b, (SELECT avg(travel_time) FROM arcs) AS m, (SELECT count(*) FROM arcs WHERE highway <> 'primary') AS fewer, (SELECT min(travel_time) * 2 FROM arcs WHERE highway <> 'primary') AS a2, (SELECT max(travel_time) * 2 FROM arcs WHERE highway <> 'primary') AS b2, (SELECT avg(travel_time * 2) FROM arcs WHERE highway <> 'primary') AS m2), v AS (SELECT unnest([{{'measure': 'nodes', 'x': nodes::DOUBLE, 'y': nodes::DOUBLE}}, {{'measure': 'arcs', 'x': arcs::DOUBLE, 'y': fewer::DOUBLE}}, {{'measure': 'turns', 'x': turns::DOUBLE, 'y': 0::DOUBLE}}, {{'measure': 'tt_min', 'x': a::DOUBLE, 'y': a2::DOUBLE}}, {{'measure': 'tt_max', 'x': b::DOUBLE, 'y': b2::DOUBLE}}, {{'measure': 'tt_mean', 'x': m, 'y': m2}}], recursive := true) FROM c) SELECT measure, round(x, 3) AS car, round(y, 3) AS bicycle, round(y - x, 3) AS delta FROM v")
def compared_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viaduct.plans.relational import forbidden_turns

    nodes, arcs = grid.nodes(spark, sf_dir), grid.arcs(spark, sf_dir)
    turns = forbidden_turns(arcs)
    slow = arcs.where("highway <> 'primary'").withColumn("travel_time", F.col("travel_time") * 2)
    found = feeds.compared_profiles({"car": (nodes, arcs, turns), "bicycle": (nodes, slow, turns.limit(0))})
    return found.select("measure", *[F.round(c, 3).alias(c) for c in ("car", "bicycle", "delta")])


PBF_SQL = """w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'residential' END AS highway FROM part)
  SELECT 'node' AS kind, node_id AS id, CAST(round(lat * 10000000) AS BIGINT) AS a, CAST(round(lng * 10000000) AS BIGINT) AS b, NULL AS highway FROM nodes UNION ALL SELECT 'way', id, 3, id + id + 1 + id - 5, highway FROM w UNION ALL SELECT 'relation', id, 2, id * 2, NULL FROM w"""


def map_file(spark: SparkSession, sf_dir: str) -> str:
    """Map files of nodes, ways of three nodes each and relations of two members, one file a block of ids, written on the executors' side."""
    folder = fresh(spark, "map")
    nodes = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("id"), "lat", "lng")

    def encode(key, rows):
        import pandas as pd

        objects = []
        for r in rows.sort_values("id").itertuples(index=False):
            i = int(r.id)
            objects.append({"kind": "node", "id": i, "lat": r.lat, "lng": r.lng, "tags": {"k": str(i)} if i % 3 == 0 else {}})
            objects.append({"kind": "way", "id": i, "refs": [i, i + 1, i - 5], "tags": {"highway": "residential"} if i % 2 == 0 else {}})
            objects.append({"kind": "relation", "id": i, "members": [{"type": "way", "id": i, "role": "from"}, {"type": "node", "id": i, "role": "via"}], "tags": {"type": "restriction"}})
        return pd.DataFrame({"path": [f"{key[0]}.pbf"], "content": [pbf.encode(objects)]})

    blocks = nodes.withColumn("block", F.expr("id div 700")).groupBy("block").applyInPandas(encode, "path string, content binary")
    files.save_payloads(blocks, folder)
    return folder


@query("s11_s12_map_files", f"{grid.WITH}, {PBF_SQL}")
def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = pbf.ordered(spark, map_file(spark, sf_dir))
    tenth = lambda c: F.round(F.col(c) * 10_000_000).cast("bigint")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda have, x: have + x)
    out = nodes.select(F.lit("node").alias("kind"), "id", tenth("lat").alias("a"), tenth("lng").alias("b"), F.lit(None).cast("string").alias("highway"))
    out = out.union(ways.select(F.lit("way"), "id", F.size("refs").cast("bigint"), total("refs"), F.try_element_at("tags", F.lit("highway"))))
    return out.union(relations.select(F.lit("relation"), "id", F.size("members").cast("bigint"), total(F.transform("members", lambda m: m["id"])), F.lit(None).cast("string")))


@query("s13_read_speed", "SELECT CAST(3 * count(*) AS BIGINT) AS objects, TRUE AS timed FROM part")
def read_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, n = pbf.read_speed(spark, map_file(spark, sf_dir))
    return spark.createDataFrame([(n, seconds > 0)], "objects bigint, timed boolean")
