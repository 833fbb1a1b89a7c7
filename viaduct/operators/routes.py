"""Route-level operators on distances: coordinate queries, hub labels, landmarks, alternatives, link speeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.geo import partial_cost
from viaduct.operators import paths


def coordinate_costs(pairs: DataFrame, dist: DataFrame, arcs: DataFrame) -> DataFrame:
    """``query_id, cost, direct``: from a place on one arc to a place on another.

    ``pairs``: ``query_id, src_arc, src_t, dst_arc, dst_t``. Along one arc forwards the way is direct; else the rest of the source arc,
    the distance from its head to the target's tail, and the beginning of the target arc. What two arcs have in common is joined once, so
    that many pairs from or to the same arc never lie in one task.
    """
    a, b = (arcs.select(F.col("arc_id").alias(f"{p}_arc"), F.col("tail").alias(f"{p}_tail"), F.col("head").alias(f"{p}_head"), F.col("weight").alias(f"{p}_weight")) for p in ("src", "dst"))
    ways = pairs.select("src_arc", "dst_arc").distinct().join(a, "src_arc").join(b, "dst_arc")
    one = F.lit(1.0)
    part = lambda p, share: partial_cost(F.col(f"{p}_weight"), share, one)
    direct = (F.col("src_arc") == F.col("dst_arc")) & (F.col("dst_t") >= F.col("src_t"))
    far = dist.select(F.col("source").alias("src_head"), F.col("node").alias("dst_tail"), "dist")
    routed = pairs.join(ways.join(far, ["src_head", "dst_tail"], "left"), ["src_arc", "dst_arc"])
    whole = part("src", 1 - F.col("src_t")) + F.col("dist") + part("dst", F.col("dst_t"))
    return routed.select("query_id", F.when(direct, part("src", F.col("dst_t") - F.col("src_t"))).otherwise(whole).alias("cost"), direct.alias("direct"))


def hub_distances(pairs: DataFrame, to_hub: DataFrame, from_hub: DataFrame) -> DataFrame:
    """``source, target, dist, hub`` over the best common hub of forward labels ``node, hub, dist`` and backward ones; ties by hub."""
    up = pairs.join(to_hub.select(F.col("node").alias("source"), "hub", F.col("dist").alias("d1")), "source")
    both = up.join(from_hub.select(F.col("node").alias("target"), "hub", F.col("dist").alias("d2")), ["target", "hub"])
    return both.groupBy("source", "target").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("dist"), "hub")).alias("b")).select("source", "target", "b.dist", "b.hub")


def prune_labels(labels: DataFrame, between: DataFrame) -> DataFrame:
    """Labels ``node, hub, dist`` without those that another hub reaches as cheaply: ``between`` has ``hub, other, dist`` from hub to hub."""
    other = labels.select("node", F.col("hub").alias("other"), F.col("dist").alias("via"))
    through = other.join(between.select(F.col("other"), "hub", F.col("dist").alias("rest")), "other").where("other <> hub")
    bad = labels.join(through, ["node", "hub"]).where("via + rest <= dist AND other < hub").select("node", "hub").distinct()
    return labels.join(bad, ["node", "hub"], "left_anti")


def landmark_bounds(pairs: DataFrame, from_landmark: DataFrame) -> DataFrame:
    """``source, target, bound``: the best lower bound d(l, target) - d(l, source) over landmarks, 0 at least."""
    s = pairs.join(from_landmark.select("landmark", F.col("node").alias("source"), F.col("dist").alias("d1")), "source")
    both = s.join(from_landmark.select("landmark", F.col("node").alias("target"), F.col("dist").alias("d2")), ["landmark", "target"])
    return both.groupBy("source", "target").agg(F.greatest(F.max(F.col("d2") - F.col("d1")), F.lit(0).cast("bigint")).alias("bound"))


def farthest_landmarks(arcs: DataFrame, first: int, k: int) -> list[int]:
    """k landmarks, each the node farthest from those chosen; k is small."""
    spark, chosen = arcs.sparkSession, [first]
    for _ in range(k - 1):
        seeds = spark.createDataFrame([(c,) for c in chosen], "source bigint")
        near = paths.distances(arcs, seeds).groupBy("node").agg(F.min("dist").alias("dist"))
        chosen.append(near.orderBy(F.desc("dist"), "node").first().node)
    return chosen


def via_candidates(ahead: DataFrame, back: DataFrame, stretch: float = 1.5) -> DataFrame:
    """``query_id, via, cost``: meeting nodes up to ``stretch`` times the best cost; of nodes with the same cost the least.

    ``ahead``: ``query_id, node, dist`` from the source; ``back`` to the target.
    """
    both = ahead.join(back.select("query_id", "node", F.col("dist").alias("rest")), ["query_id", "node"]).withColumn("cost", F.col("dist") + F.col("rest"))
    best = Window.partitionBy("query_id")
    near = both.withColumn("best", F.min("cost").over(best)).where(F.col("cost") <= F.floor(F.col("best") * stretch))
    return near.groupBy("query_id", "cost").agg(F.min("node").alias("via")).select("query_id", "via", "cost")


def accept_alternatives(candidates: DataFrame, k: int, sharing: float = 0.8) -> DataFrame:
    """``query_id, route_index, via, cost``: greedily, cheapest first, a candidate whose shared cost with every accepted route is at most ``sharing`` of the best.

    ``candidates``: ``query_id, via, cost, arcs ARRAY<STRUCT<arc_id, weight>>``; a route that uses an arc twice is left out. The accepted set
    feeds later decisions, so each query is one fold.
    """

    def choose(key, rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int, dict]] = []
        best = None
        for via, cost, arcs in rows.sort_values(["cost", "via"])[["via", "cost", "arcs"]].itertuples(index=False):
            own = {a["arc_id"]: a["weight"] for a in arcs}
            best = cost if best is None else best
            if len(own) < len(arcs) or any(sum(w for a, w in own.items() if a in other) > int(best * sharing) for _, _, other in taken):
                continue
            taken.append((via, cost, own))
            if len(taken) == k:
                break
        return pd.DataFrame([(key[0], i, v, c) for i, (v, c, _) in enumerate(taken)], columns=["query_id", "route_index", "via", "cost"])

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id bigint, route_index bigint, via bigint, cost bigint")


def link_speeds(links: DataFrame, traces: DataFrame) -> DataFrame:
    """``trip, link_id, entered, quality, velocity`` from sparse positions.

    ``links``: ``trip, seq, link_id, length, limit`` in driving order; ``traces``: ``trip, seq, ts (ms), link_id, fraction``. Between two positions the
    speed is the same share of every link's limit. The quality of a link is the part of it that an interval covers, weighed by the
    link's share of the interval's length; ``entered`` is extrapolated to the link's start.
    """
    order = Window.partitionBy("trip").orderBy("seq")
    free = F.col("length") / F.col("limit")
    placed = links.withColumn("start", F.coalesce(F.sum(free).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("end", F.col("start") + free).withColumnRenamed("seq", "link_seq")
    at = traces.join(placed.select("trip", "link_id", "link_seq", "start", "end", "length"), ["trip", "link_id"]).withColumn("tau", F.col("start") + F.col("fraction") * (F.col("end") - F.col("start")))
    steps = at.select("trip", "seq", "ts", "tau", "link_seq", F.lead("ts").over(order).alias("ts2"), F.lead("tau").over(order).alias("tau2"), F.lead("link_seq").over(order).alias("last")).where("tau2 > tau")
    parts = steps.select("*", F.explode(F.sequence("link_seq", "last")).alias("s")).drop("link_seq").join(placed.withColumnRenamed("link_seq", "s"), ["trip", "s"])
    low, high = F.greatest("start", "tau"), F.least("end", "tau2")
    rate = (F.col("ts2") - F.col("ts")) / (F.col("tau2") - F.col("tau"))  # ms a unit of free time
    parts = parts.withColumn("covered", high - low).where("covered > 0").withColumn("rate", rate)
    meters = F.col("covered") * F.col("limit")
    parts = parts.withColumn("m", meters).withColumn("all", F.sum("m").over(Window.partitionBy("trip", "seq"))).withColumn("ms", F.col("covered") * F.col("rate"))
    entered = F.min_by(F.col("ts") + (F.col("start") - F.col("tau")) * F.col("rate"), F.col("seq"))
    out = parts.groupBy("trip", "s", "link_id").agg(entered.alias("entered"), F.sum(F.col("m") / F.col("length") * F.col("m") / F.col("all")).alias("quality"), (F.sum("m") / F.sum("ms") * 3.6).alias("velocity"))
    return out.select("trip", "link_id", F.floor("entered").alias("entered"), "quality", "velocity")


def merge_metrics(metrics: DataFrame, groups: int) -> DataFrame:
    """``metric, grp``: agglomerative merging of ``metric, arc_id, weight`` by the least loss, the sum of squared differences from the smaller weight.

    One join gives the losses of all pairs of the current groups; the number of metrics is small.
    """
    spark = metrics.sparkSession
    member = {r.metric: r.metric for r in metrics.select("metric").distinct().collect()}
    while len(set(member.values())) > groups:
        names = spark.createDataFrame(list(member.items()), metrics.select("metric", F.col("metric").alias("grp")).schema)
        least = metrics.join(F.broadcast(names), "metric").groupBy("grp", "arc_id").agg(F.min("weight").alias("w"))  # a row a metric
        a, b = least.toDF("g", "arc_id", "u"), least.toDF("h", "arc_id", "v")
        loss = a.join(b, "arc_id").where("g < h").groupBy("g", "h").agg(F.sum(F.pow(F.col("u") - F.col("v"), F.lit(2))).alias("loss"))
        best = loss.orderBy("loss", "g", "h").first()
        member = {m: best.g if g == best.h else g for m, g in member.items()}
    return spark.createDataFrame(sorted(member.items()), metrics.select("metric", F.col("metric").alias("grp")).schema)
