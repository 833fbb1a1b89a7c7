"""Queries against their SQL on small tables that hold what only larger ones have, and plans at the size of larger ones."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import DIR, rows

from viaduct.operators import hierarchy, paths, timed
from viaduct.plans import catalog, routes_files
from viaduct.session import Tables
from viaduct.sources import osm
from viaduct.streaming import packets

START = datetime.datetime(2024, 1, 1)


def differences(spark, folder, name, **tables) -> None:
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = catalog.QUERIES[name](spark, str(folder)).toPandas()
    wanted = con.execute(catalog.ORACLE_SQL[name]).df()
    assert len(wanted) > 0
    assert rows(found) == rows(wanted)


def parts(keys) -> dict:
    keys = list(keys)
    return {"p_partkey": keys, "p_size": pa.array([k % 50 + 1 for k in keys], pa.int32()), "p_name": [f"part {k % 7}" for k in keys]}


def events(rows) -> dict:
    """From (microseconds after the start, value, k, event id modulo 4)."""
    return {
        "event_id": [4 * n + r[3] for n, r in enumerate(rows)],
        "user_id": [0] * len(rows),
        "ts": pa.array([START + datetime.timedelta(microseconds=r[0]) for r in rows], pa.timestamp("us")),
        "value": [float(r[1]) for r in rows],
        "props": [f'{{"k": {r[2]}}}' for r in rows],
    }


def test_halves_of_a_decimetre(spark, tmp_path):
    differences(spark, tmp_path, "f01_f04_distances", part=parts(range(2000, 2200)))


def test_cosines_near_one(spark, tmp_path):
    # at this latitude Java and C differ in the last bit
    differences(spark, tmp_path, "f01_f04_distances", part=parts(range(224_750, 224_850)))


def test_milliseconds_of_samples_are_rounded(spark, tmp_path):
    samples = [(1_000_499, 10, 1, 3), (1_003_500, 1000, 1, 3), (1_007_501, 10, 1, 3), (1_009_999, 500, 1, 3)]
    differences(spark, tmp_path, "a20_w15_gps_buckets", events=events(samples))


def test_halves_of_window_means(spark, tmp_path):
    # the mean occupancy is 0.6125, but 1000 times the quotient of the sums is less than 612.5
    differences(spark, tmp_path, "z02_a30_windows", events=events([(1, 10, 47, 1), (2, 20, 86, 3), (3, 30, 10, 2), (4, 40, 89, 2)]))


def test_sums_of_windows_do_not_depend_on_the_split(spark):
    # one by one in the order of ids the ones vanish in 1e16, together they do not
    rows = [(n, 0, START, v, 0.5, 1.0) for n, v in enumerate([1e16, *[1.0] * 7])]
    table = spark.createDataFrame(rows[::-1], "event_id long, edge long, ts timestamp, kmh double, occupancy double, confidence double")
    for n in (1, 3, 8):
        found = packets.windowed(table.repartition(n), order="event_id").collect()
        assert [(r.n, r.kmh) for r in found] == [(8, 1e16 / 8)]


#: By finding: their arcs, turns and line graphs grow with the network, so none may go through the driver.
SHUFFLED = ["a07_line_graph_route_cost", "a09_route_evaluation", "r06_turn_graph_paths", "d11_linked_functions", "j25_conditional_turns", "d15_d16_weight_vector", "j13_propagation_preview", "r12_turn_diagnosis", "a08_pseudo_normal_weight", "d06_time_dependent_line_graph", "g31_split_chains"]


@pytest.mark.parametrize("name", SHUFFLED)
def test_no_arcs_are_broadcast(spark, name):
    # to these tables what 10 MB are to tables of 1 GB
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "14k")
    try:
        plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_junctions_of_long_ways(spark):
    # by way, the pairs of the two long ways would be 600 million rows
    members = spark.range(20_000).selectExpr("1L AS way_id", "id AS node").union(spark.range(20_000).selectExpr("2L", "id + 19999")).union(spark.createDataFrame([(3, 5), (3, 6), (4, 7)], "way_id long, node long"))
    more = [(-1, 1, 3), (-2, 3, 2), (-3, 4, 4), (-4, 9, 1), (-5, 4, 9)]
    pairs = spark.range(30_000).selectExpr("id AS pair_id", "1L AS a", "2L AS b").union(spark.createDataFrame(more, "pair_id long, a long, b long"))
    found = dict(osm.way_junctions(pairs, members).collect())
    assert found == {n: 19_999 for n in range(30_000)} | {-1: None, -2: None, -3: 7, -5: None}


def test_ancestors_are_marked_once(spark):
    # a path of 20,000 nodes with every node a target: as pairs, 200 million rows
    tree = spark.range(1, 20_000).selectExpr("0L AS source", "id AS node", "id - 1 AS parent")
    end = spark.createDataFrame([(0, 19_999), (0, 7)], "source long, node long")
    assert paths.with_ancestors(end, tree).count() == 20_000
    assert paths.with_ancestors(tree, tree).count() == 20_000


def test_paths_are_not_written(spark, monkeypatch):
    # a path of 3000 nodes that goes to and fro between cells, and 300 nodes beside: 4.5 million rows, of which none is kept
    written = []
    plain = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda frame, name: written.append(plain(frame, name)) or written[-1])
    spot = [(n * 7) % 3000 for n in range(3000)]
    up = {spot[n]: spot[n - 1] for n in range(1, 3000)} | {3000 + n: spot[n * 9] for n in range(300)}
    tree = spark.createDataFrame([(0, v, u) for v, u in up.items()], "source long, node long, parent long")
    found = paths.unpack(spark.createDataFrame([(0, v) for v in [0, *up]], "source long, node long"), tree, 1000)
    depth = {}
    for v in [0, *up]:
        steps, u = 0, v
        while u in up:
            u, steps = up[u], steps + 1
        depth[v] = steps
    assert found.count() == sum(n + 1 for n in depth.values())
    assert sum(f.count() for f in written) < found.count() / 2
    for v in (0, 1, 2999, 3299):
        way = [v]
        while way[-1] in up:
            way.append(up[way[-1]])
        assert sorted(found.where(F.col("target") == v).select("hops_to_target", "node").collect()) == list(enumerate(way))


def test_rounds_keep_only_entries_of_cells(spark, monkeypatch):
    # a chain over ten cells: what a round writes holds no node inside a cell
    written = []
    plain = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, frame, name: written.append(plain(self, frame, name).count()) or plain(self, frame, name))
    arcs = spark.range(999).selectExpr("id AS tail", "id + 1 AS head", "1L AS weight")
    found = paths.distances(arcs, spark.createDataFrame([(0,)], "source long"), 100)
    assert dict(found.select("node", "dist").collect()) == {n: n for n in range(1000)}
    assert max(written) <= 11


def test_points_of_an_average_are_made_once(spark):
    f = F.from_json(F.lit("[]"), "array<struct<dt: bigint, tt: bigint>>")
    assert str(timed.area(f, F.lit(1), F.lit(9))).count("array_sort") == 1


def test_interval_minima_evaluate_each_moment_once(spark):
    functions = [[(0, 50), (30, 10), (70, 90)], [(0, 7)], [(0, 9), (99, 1)]]
    spans = [(a, b) for a in range(0, 100, 7) for b in range(a + 1, 101, 13) if b < 100]
    rows = spark.createDataFrame(list(enumerate(functions)), "id long, ttf array<struct<dt: bigint, tt: bigint>>")
    found = timed.interval_minima(rows, spans, 100)
    each = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in spans])
    inside = lambda t: timed.evaluate(F.col("ttf"), F.col(t), 100)
    points = F.concat(F.array(inside("a"), inside("b")), F.transform(F.filter("ttf", lambda p: p["dt"].between(F.col("a"), F.col("b"))), lambda p: p["tt"]))
    wanted = rows.select("id", "ttf", F.inline(each)).select("id", "a", "b", F.array_min(points))
    assert sorted(found.select("id", "span_start", "span_end", "least").collect()) == sorted(wanted.collect())


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_orders_are_not_shuffled_by_a_handful_of_heads(spark):
    # by head and side all orders would lie in ten keys
    found = plan(routes_files.pairs(spark, DIR))
    assert found.count("BroadcastHashJoin") == 2


def test_sources_of_link_queries_are_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(paths, "distances", lambda arcs, sources: seen.append(plan(sources)) or spark.createDataFrame([], "source long, node long, dist long"))
    catalog.QUERIES["r14_link_queries"](spark, DIR)
    assert len(seen) == 1 and "orders.parquet" not in seen[0] and "Join" not in seen[0]


def test_corners_of_chains_are_found_once(spark):
    assert "ATAN2" not in plan(catalog.QUERIES["j24_via_way_chains"](spark, DIR))


def test_landmarks_are_swept_from_the_ends_of_pairs(spark, monkeypatch):
    # landmarks grow with the network: from each of them, all nodes would be billions of rows at 1 GB
    seen = []
    monkeypatch.setattr(hierarchy, "rounds", lambda *_: [])
    monkeypatch.setattr(hierarchy, "sweep", lambda found, sources, targets, back: seen.append((sources.count(), targets.count(), back)) or sources.selectExpr("source", "source AS node", "0L AS dist"))
    catalog.QUERIES["g05_landmark_bounds"](spark, DIR)
    assert len(seen) == 1 and 0 < seen[0][0] <= 186 and seen[0][1:] == (1, True)
