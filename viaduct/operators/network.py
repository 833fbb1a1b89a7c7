"""Relational operators on arcs, turns and ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.traffic import CLOSED

U_TURN_MS = 20_000


def line_graph(arcs: DataFrame, forbidden: DataFrame | None = None, u_turn_ms: int = U_TURN_MS) -> DataFrame:
    """``from_arc, to_arc, turn_cost, weight``: pairs of arcs that meet, without the forbidden ones; going back costs extra.

    The weight is the target arc's travel time plus the turn cost.
    """
    after = arcs.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("via"), F.col("head").alias("next"), F.col("travel_time").alias("target_time"))
    pairs = arcs.select(F.col("arc_id").alias("from_arc"), "tail", "head").join(after, F.col("head") == F.col("via"))
    if forbidden is not None:
        pairs = pairs.join(forbidden.hint("merge"), ["from_arc", "to_arc"], "left_anti")
    cost = F.when(F.col("tail") == F.col("next"), F.lit(u_turn_ms)).otherwise(F.lit(0)).cast("bigint")
    return pairs.select("from_arc", "to_arc", cost.alias("turn_cost"), (F.col("target_time") + cost).alias("weight")).hint("merge")  # no arcs go through the driver


def reverse(arcs: DataFrame) -> DataFrame:
    return arcs.withColumnsRenamed({"tail": "head", "head": "tail"})


def with_reverse_arc(arcs: DataFrame) -> DataFrame:
    """Arcs whose opposite direction exists too."""
    return arcs.join(arcs.select(F.col("tail").alias("head"), F.col("head").alias("tail")).distinct(), ["tail", "head"], "left_semi")


def closed_under_reversal(arcs: DataFrame) -> DataFrame:
    """``tail, head`` of all arcs and their opposites, each once."""
    return arcs.select("tail", "head").union(arcs.select("head", "tail")).distinct()


def find_arcs(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The least arc of each (tail, head) of ``pairs``; null if there is none."""
    least = arcs.groupBy("tail", "head").agg(F.min("arc_id").alias("arc_id"))
    return pairs.join(least, ["tail", "head"], "left")


def node_paths_to_arcs(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """``path_id, pos, arc_id`` from ``path_id, nodes``: the least arc between consecutive nodes."""
    steps = paths.select("path_id", F.posexplode(F.arrays_zip(F.col("nodes").alias("tail"), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("head"))).alias("pos", "step"))
    steps = steps.select("path_id", F.col("pos").cast("bigint").alias("pos"), F.col("step.tail").alias("tail"), F.col("step.head").alias("head")).where("head is not null")
    return find_arcs(steps, arcs).select("path_id", "pos", "arc_id")


def arc_paths_to_nodes(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """``path_id, pos, node_id`` from ``path_id, pos, arc_id``: the first tail, then all heads."""
    both = paths.join(arcs.select("arc_id", "tail", "head"), "arc_id")
    return both.where("pos = 0").select("path_id", F.lit(0).cast("bigint").alias("pos"), F.col("tail").alias("node_id")).union(both.select("path_id", F.col("pos") + 1, "head"))


def degrees(arcs: DataFrame) -> DataFrame:
    """``node_id, out_degree, first_out`` for all tails: counts and where each node's arcs begin in (tail, head) order.

    Offsets are prefix sums: inside blocks of 4096 nodes, then over the blocks.
    """
    count = arcs.groupBy(F.col("tail").alias("node_id")).agg(F.count("*").alias("out_degree")).withColumn("block", F.expr("node_id div 4096"))
    inner = Window.partitionBy("block").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block
    blocks = count.groupBy("block").agg(F.sum("out_degree").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = count.select("*", F.coalesce(F.sum("out_degree").over(inner), F.lit(0)).alias("before")).join(blocks, "block")
    return rows.select("node_id", "out_degree", (F.col("before") + F.col("base")).alias("first_out"))


def ways(arcs: DataFrame) -> DataFrame:
    """``way_id, arcs, first_arc, consistent``: consistent if all arcs of a way have the same road class."""
    return arcs.groupBy("way_id").agg(F.count("*").alias("arcs"), F.min("arc_id").alias("first_arc"), (F.min("highway") == F.max("highway")).alias("consistent"))


def unify_parallel(arcs: DataFrame, weight: str = "travel_time") -> DataFrame:
    """All arcs with the least weight of their (tail, head)."""
    least = F.min(weight).over(Window.partitionBy("tail", "head"))
    return arcs.withColumn(weight, least)


def without_loops_and_doubles(arcs: DataFrame, weight: str = "travel_time") -> DataFrame:
    """``tail, head, weight, arc_id``: no loops, and of parallel arcs the lightest one, then the least id."""
    best = F.min(F.struct(F.col(weight).alias("weight"), "arc_id"))
    return arcs.where("tail <> head").groupBy("tail", "head").agg(best.alias("b")).select("tail", "head", "b.weight", "b.arc_id")


def subgraph(nodes: DataFrame, arcs: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes inside, and the arcs between them."""
    kept = nodes.where(inside)
    ids = kept.select("node_id")
    out = arcs.join(ids.withColumnRenamed("node_id", "tail"), "tail", "left_semi").join(ids.withColumnRenamed("node_id", "head"), "head", "left_semi")
    return kept, out


def pseudo_normal_weights(arcs: DataFrame, lg_metric: DataFrame) -> DataFrame:
    """``arc_id, weight``: the least weight of the turns into an arc, or the arc's own travel time."""
    least = lg_metric.groupBy(F.col("to_arc").alias("arc_id")).agg(F.min("weight").alias("turned"))
    return arcs.join(least, "arc_id", "left").select("arc_id", F.coalesce("turned", "travel_time").alias("weight"))


def route_costs(path_arcs: DataFrame, metric: DataFrame) -> DataFrame:
    """``path_id, arcs, cost``: saturating sums of the path's arc weights; null if an arc has none."""
    rows = path_arcs.join(metric, "arc_id", "left")
    total = F.when(F.count_if(F.col("weight").isNull()) == 0, F.least(F.sum("weight"), F.lit(4294967295)))
    return rows.groupBy("path_id").agg(F.count("*").alias("arcs"), total.alias("cost"))


def line_graph_route_costs(path_arcs: DataFrame, arcs: DataFrame, lg: DataFrame) -> DataFrame:
    """``path_id, cost``: the first arc's travel time plus the weights of the turns; null if a turn is missing."""
    order = Window.partitionBy("path_id").orderBy("pos")
    steps = path_arcs.select("path_id", "pos", "arc_id", F.lag("arc_id").over(order).alias("from_arc"))
    priced = steps.join(lg.select("from_arc", F.col("to_arc").alias("arc_id"), "weight"), ["from_arc", "arc_id"], "left").join(arcs.select("arc_id", "travel_time"), "arc_id", "left")
    step = F.when(F.col("from_arc").isNull(), F.col("travel_time")).otherwise(F.col("weight"))
    return priced.groupBy("path_id").agg(F.when(F.count_if(step.isNull()) == 0, F.sum(step)).alias("cost"))


def evaluate_routes(path_arcs: DataFrame, arcs: DataFrame, lg: DataFrame) -> DataFrame:
    """``path_id, cost, mode``: the exact line-graph cost, else the sum of pseudo-normal weights."""
    exact = line_graph_route_costs(path_arcs, arcs, lg)
    plain = route_costs(path_arcs, pseudo_normal_weights(arcs, lg)).withColumnRenamed("cost", "plain")
    both = exact.join(plain, "path_id")
    return both.select("path_id", F.coalesce("cost", "plain").alias("cost"), F.when(F.col("cost").isNotNull(), "line_graph").when(F.col("plain").isNotNull(), "pseudo_normal").alias("mode"))


def with_overrides(arcs: DataFrame, live: DataFrame) -> DataFrame:
    """``arc_id, weight, is_live``: the live weight where there is one; a negative one closes the arc."""
    weight = F.when(F.col("live") < 0, F.lit(CLOSED).cast("bigint")).otherwise(F.coalesce("live", "travel_time"))
    return arcs.join(live, "arc_id", "left").select("arc_id", weight.alias("weight"), F.col("live").isNotNull().alias("is_live"))


def covered_ranges(ranges: DataFrame) -> DataFrame:
    """``path_id, start, end``: ranges that contain no other range of their path, by a sweep from the right."""
    after = Window.partitionBy("path_id").orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.distinct().withColumn("least", F.min("end").over(after)).where("least is null or least > end").drop("least")


def shared_cost(a: DataFrame, b: DataFrame, metric: DataFrame) -> DataFrame:
    """``path_id, shared``: the cost of the arcs that both paths of an id use."""
    both = a.select("path_id", "arc_id").distinct().join(b.select("path_id", "arc_id").distinct(), ["path_id", "arc_id"])
    return both.join(metric, "arc_id").groupBy("path_id").agg(F.sum("weight").alias("shared"))
