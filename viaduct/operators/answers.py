"""Answers to route requests: coordinate queries on turn graphs, paths as shapes, request checks, profiles and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.functions import geo
from viaduct.functions.traffic import CLOSED
from viaduct.operators import network, paths
from viaduct.session import materialize

MOST_ROUTES = 10


def request_error(routes: Column, box: dict[str, Column] | None = None) -> Column:
    """Why a request is refused, null if it is not: no routes, more than ten, or a box whose minima exceed its maxima."""
    out = F.when(F.coalesce(routes, F.lit(0)) < 1, "no_routes").when(routes > MOST_ROUTES, "too_many_routes")
    return out if box is None else out.when((box["min_lat"] > box["max_lat"]) | (box["min_lng"] > box["max_lng"]), "invalid_box")


def turn_graph_costs(pairs: DataFrame, dist: DataFrame, edges: DataFrame, arcs: DataFrame) -> DataFrame:
    """``query_id, cost, direct`` from a place on one arc to a place on another, by turn-graph distances between arcs.

    ``pairs``: ``query_id, src_arc, src_t, dst_arc, dst_t``; ``dist``: ``source, node, dist`` between arcs, without the source arc's own time. The
    target arc counts as far as it is driven, and so does the source arc. On one arc forwards the way is direct; backwards it is the
    cheapest cycle: out by any turn and back into the arc.
    """
    a, b = (arcs.select(F.col("arc_id").alias(f"{p}_arc"), F.col("travel_time").alias(f"{p}_weight")) for p in ("src", "dst"))
    back = dist.join(edges.select(F.col("from_arc").alias("node"), F.col("to_arc").alias("source"), "weight"), ["source", "node"])
    cycles = back.groupBy("source").agg(F.min(F.col("dist") + F.col("weight")).alias("dist")).select(F.col("source").alias("src_arc"), F.col("source").alias("dst_arc"), "dist")
    ways = dist.where("source <> node").select(F.col("source").alias("src_arc"), F.col("node").alias("dst_arc"), "dist").unionByName(cycles)
    both = pairs.select("src_arc", "dst_arc").distinct().join(a, "src_arc").join(b, "dst_arc").join(ways, ["src_arc", "dst_arc"], "left")
    rows = pairs.join(both, ["src_arc", "dst_arc"])  # what two arcs have in common is joined once
    part = lambda p, share: geo.partial_cost(F.col(f"{p}_weight"), share, F.lit(1.0))
    direct = (F.col("src_arc") == F.col("dst_arc")) & (F.col("dst_t") >= F.col("src_t"))
    whole = F.col("dist") - F.col("dst_weight") + part("src", 1 - F.col("src_t")) + part("dst", F.col("dst_t"))
    return rows.select("query_id", "src_arc", "dst_arc", F.when(direct, part("src", F.col("dst_t") - F.col("src_t"))).otherwise(whole).alias("cost"), direct.alias("direct"))


def materialised(lg_paths: DataFrame, originals: DataFrame, arcs: DataFrame, trimmed: bool = True) -> DataFrame:
    """``path_id, route_arcs, nodes`` of turn-graph paths ``path_id, pos, lg_node``.

    ``originals``: ``lg_node, arc_id``, split nodes included. Trimmed paths lose their first and last arc, on which the places lie; of two
    arcs or one nothing is left but the node between them.
    """
    whole = Window.partitionBy("path_id")
    rows = lg_paths.withColumn("n", F.count("*").over(whole)).join(originals.hint("merge"), "lg_node").join(arcs.select("arc_id", "tail", "head"), "arc_id")
    inner = F.col("pos").between(1, F.col("n") - 2) if trimmed else F.lit(True)
    step = F.struct("pos", "arc_id", "tail", "head")
    out = rows.groupBy("path_id").agg(F.array_sort(F.collect_list(F.when(inner, step))).alias("s"), F.max("n").alias("n"), F.min_by("head", "pos").alias("first_head"))
    arc_ids, tails = F.transform("s", lambda x: x["arc_id"]), F.transform("s", lambda x: x["tail"])
    left = F.when(F.lit(trimmed) & (F.col("n") >= 2), F.array("first_head")).otherwise(F.array().cast("array<bigint>"))
    return out.select("path_id", arc_ids.alias("route_arcs"), F.when(F.size("s") > 0, F.concat(tails, F.array(F.element_at("s", -1)["head"]))).otherwise(left).alias("nodes"))


def around_via(steps: DataFrame, half: DataFrame) -> DataFrame:
    """``path_id, first_pos, last_pos, cost``: the stretch of a path that lies ``half`` around its via node.

    ``steps``: ``path_id, pos, node, cost`` with the cost of the step to the node, 0 at the start; ``half``: ``path_id, via, half``. It begins at the
    last node at least ``half`` before the via node, or at the start, and ends likewise; a via node that isn't on the path gives nothing.
    """
    order = Window.partitionBy("path_id").orderBy("pos")
    far = steps.withColumn("at", F.sum("cost").over(order)).join(half, "path_id")
    via = far.where("node = via").groupBy("path_id").agg(F.min(F.struct("pos", "at")).alias("v")).select("path_id", F.col("v.pos").alias("via_pos"), F.col("v.at").alias("via_at"))
    rows = far.join(via, "path_id")
    before = F.max(F.when((F.col("pos") <= F.col("via_pos")) & (F.col("at") <= F.greatest(F.col("via_at") - F.col("half"), F.lit(0))), F.struct("pos", "at")))
    behind = F.min(F.when((F.col("pos") >= F.col("via_pos")) & (F.col("at") >= F.col("via_at") + F.col("half")), F.struct("pos", "at")))
    ends = rows.groupBy("path_id").agg(F.coalesce(before, F.min(F.struct("pos", "at"))).alias("a"), F.coalesce(behind, F.max(F.struct("pos", "at"))).alias("b"))
    return ends.select("path_id", F.col("a.pos").alias("first_pos"), F.col("b.pos").alias("last_pos"), (F.col("b.at") - F.col("a.at")).alias("cost"))


def link_costs(queries: DataFrame, arcs: DataFrame, updates: DataFrame, dist_of) -> DataFrame:
    """``query_id, cost, direct`` of link queries with fractions after sparse updates ``arc_id, live`` of the weights.

    ``dist_of(arcs, sources)`` gives distances over ``tail, head, weight``.
    """
    from viaduct.operators import routes

    fresh = network.with_overrides(arcs, updates).where(F.col("weight") < CLOSED).select("arc_id", "weight").join(arcs.select("arc_id", "tail", "head"), "arc_id")
    # the rounds read their sources several times, and all queries would be made each time
    heads = materialize(queries.select(F.col("src_arc").alias("arc_id")).distinct().join(fresh, "arc_id").select(F.col("head").alias("source")).distinct(), "heads")
    return routes.coordinate_costs(queries, dist_of(fresh, heads), fresh)


def profiles(spark: SparkSession, path: str) -> list[str]:
    """The profiles that a folder has graphs of, by its ``profile=`` parts."""
    return sorted(r.profile for r in spark.read.parquet(path).select("profile").distinct().collect())


def of_profile(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """One profile's rows; only its files are read. An unknown profile is an error."""
    rows = spark.read.parquet(path).where(F.col("profile") == profile)
    if rows.isEmpty():
        raise ValueError(f"no profile {profile}")
    return rows.drop("profile")


def diagnosis(arcs: DataFrame, edges: DataFrame, forbidden: DataFrame, near: DataFrame) -> DataFrame:
    """``node_id, from_arc, to_arc, angle_deg, kind, status, turn_cost`` of every turn at the nodes ``node_id``.

    The status says ``forbidden``, ``allowed`` or ``missing``, if the turn graph lacks it though nothing forbids it.
    """
    b = arcs.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("node_id"), F.col("head_lat").alias("b_lat"), F.col("head_lng").alias("b_lng"))
    a = arcs.select(F.col("arc_id").alias("from_arc"), F.col("head").alias("node_id"), "tail_lat", "tail_lng", F.col("head_lat").alias("via_lat"), F.col("head_lng").alias("via_lng"))
    pairs = a.join(near, "node_id", "left_semi").join(b, "node_id")
    angle = geo.turn_angle(*[F.col(c) for c in ("tail_lat", "tail_lng", "via_lat", "via_lng", "b_lat", "b_lng")])["angle_deg"]
    rows = pairs.withColumn("angle_deg", angle).join(forbidden.withColumn("banned", F.lit(True)), ["from_arc", "to_arc"], "left").join(edges.select("from_arc", "to_arc", "turn_cost"), ["from_arc", "to_arc"], "left")
    status = F.when(F.col("banned"), "forbidden").when(F.col("turn_cost").isNotNull(), "allowed").otherwise("missing")
    return rows.select("node_id", "from_arc", "to_arc", "angle_deg", geo.turn_class_wide(F.col("angle_deg")).alias("kind"), status.alias("status"), "turn_cost")


def kept_by_bits(rows: DataFrame, bits: DataFrame, pos: str, keep: bool = True) -> DataFrame:
    """The rows whose position ``pos`` has a set bit in ``pos, bit``, or the others."""
    return rows.join(bits.where("bit").select(F.col("pos").alias(pos)), pos, "left_semi" if keep else "left_anti")


def permuted(values: DataFrame, order: DataFrame) -> DataFrame:
    """``pos, value`` after every value has moved to ``rank`` of its ``pos`` in the order."""
    return values.join(order, "pos").select(F.col("rank").alias("pos"), "value")


def merged_neighbours(a: Column, b: Column, gone: Column) -> Column:
    """The union of two sorted neighbour lists without those in ``gone``, sorted: what contraction leaves."""
    return F.array_sort(F.array_except(F.array_union(a, b), gone))


def random_queries(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """``query_id, source, target``: pairs of nodes drawn by a hash of the seed and the query's number; the same seed draws the same pairs.

    A draw is a point between 0 and 1, and the node whose own share of that span holds it is taken; shares follow the order of ids. Nodes are
    numbered inside blocks and over the blocks, never in one task.
    """
    ids = nodes.select("node_id").distinct().withColumn("block", F.expr("node_id div 65536"))
    sizes = ids.groupBy("block").agg(F.count("*").alias("n"))
    # one row a block
    base = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("node_id")) - 1
    ranked = ids.withColumn("own", rank).join(base, "block").select("node_id", (F.col("own") + F.col("base")).alias("rank"))
    total = sizes.agg(F.sum("n").alias("total"))
    draws = nodes.sparkSession.range(count).join(F.broadcast(total))  # total is one row
    pick = lambda side: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(side)), F.col("total"))
    draws = draws.select(F.col("id").alias("query_id"), pick(0).alias("a"), pick(1).alias("b"))
    first = draws.join(ranked.select(F.col("rank").alias("a"), F.col("node_id").alias("source")), "a")
    return first.join(ranked.select(F.col("rank").alias("b"), F.col("node_id").alias("target")), "b").select("query_id", "source", "target")


def breadth_first_order(arcs: DataFrame, source: DataFrame) -> DataFrame:
    """``node, rank``: nodes in order of their hops from the source, then by id. Ranks are counted inside each level."""
    hops = paths.distances(arcs.select("tail", "head", F.lit(1).alias("weight")), source)
    levels = hops.groupBy("dist").agg(F.count("*").alias("n"))
    base = levels.select("dist", F.coalesce(F.sum("n").over(Window.orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a level
    own = F.row_number().over(Window.partitionBy("dist").orderBy("node")) - 1
    return hops.withColumn("own", own).join(base, "dist").select("node", (F.col("own") + F.col("base")).alias("rank"))


def sampled_subgraph(ttfs: DataFrame, source: DataFrame, targets: DataFrame, windows: tuple[tuple[int, int], ...] = ((22, 5), (7, 10), (11, 15), (16, 19))) -> DataFrame:
    """The arcs of ``arc_id, tail, head, ttf`` on a shortest path to a target by the mean travel times of one of the windows (hours)."""
    from viaduct.functions import ttf

    hour, out = ttf.DAY_MS // 24, None
    means = [ttf.average(F.col("ttf"), start * hour, end * hour).alias(f"w{i}") for i, (start, end) in enumerate(windows)]
    metrics = materialize(ttfs.select("arc_id", "tail", "head", *means), "metrics").hint("merge")
    for i in range(len(windows)):
        metric = metrics.select("arc_id", "tail", "head", F.col(f"w{i}").alias("weight"))
        dist = paths.distances(metric, source)
        tree = materialize(paths.parents(dist, metric), "tree")
        on = paths.with_ancestors(dist.join(targets.select("node"), "node", "left_semi"), tree)
        used = tree.join(on.hint("merge"), ["source", "node"], "left_semi").select("arc_id")
        out = used if out is None else out.union(used)
    return ttfs.join(out.distinct(), "arc_id", "left_semi")


def penalty_routes(arcs: DataFrame, queries: DataFrame, routes: int, percent: int = 30) -> DataFrame:
    """``query_id, round, arc_id, weight``: a shortest route of each query, then again after the arcs of the earlier routes got ``percent`` dearer.

    ``queries``: ``query_id, source, target``; each has a copy of the network, so all of them are routed at once.
    """
    span = arcs.agg(F.greatest(F.max("tail"), F.max("head")) + 1).first()[0]
    place = lambda c: F.col("query_id") * span + F.col(c)
    copies = queries.select("query_id").join(arcs.select("arc_id", "tail", "head", "weight")).select("query_id", "arc_id", place("tail").alias("tail"), place("head").alias("head"), "weight")  # a copy a query
    own = copies.select("query_id", "arc_id", "weight")
    ends = queries.select("query_id", place("source").alias("source"), place("target").alias("node"))
    out = None
    for n in range(routes):
        keyed = copies.withColumn("arc_id", F.struct("query_id", "arc_id"))
        dist = paths.distances(copies, ends.select("source"))
        tree = materialize(paths.parents(dist, keyed).join(dist, ["source", "node"]), "tree").hint("merge")
        # of a path's nodes none is farther than its target
        near = tree.join(dist.join(ends, ["source", "node"]).groupBy("source").agg(F.max("dist").alias("most")), "source").where("dist <= most")
        on = paths.with_ancestors(ends, near)
        used = materialize(tree.join(on.hint("merge"), ["source", "node"], "left_semi").select("arc_id.query_id", "arc_id.arc_id"), "used")
        found = used.join(own, ["query_id", "arc_id"]).select("query_id", F.lit(n).cast("bigint").alias("round"), "arc_id", "weight")
        out = found if out is None else out.union(found)
        dearer = used.withColumn("hit", F.lit(True))
        copies = copies.join(dearer, ["query_id", "arc_id"], "left").withColumn("weight", F.when(F.col("hit"), F.expr(f"weight * {100 + percent} div 100")).otherwise(F.col("weight"))).drop("hit")
    return out
