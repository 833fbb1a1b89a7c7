"""Conditional and via-way turn restrictions: from relations ``id, tags, members`` to pairs and chains of arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions import geo, osm
from viaduct.session import Tables, materialize
from viaduct.sources.osm import crossings

#: Tags by priority, the conditional ones first: fixed values of the profiles.
CAR_TAGS = (("restriction:motorcar:conditional", "restriction:conditional"), ("restriction:motorcar", "restriction"))
MOTORCYCLE_TAGS = (("restriction:motorcycle:conditional", "restriction:conditional"), ("restriction:motorcycle", "restriction"))


def scan(relations: DataFrame, tags: tuple[tuple[str, str], tuple[str, str]] = CAR_TAGS) -> DataFrame:
    """``relation_id, kind, direction, from_way, to_way, via_node, via_ways, condition`` of conditional and of unconditional via-way restrictions.

    A row for each pair of a from way and a to way. ``condition`` is empty if the restriction always holds. A conditional tag hides an
    unconditional one. Left out: other relation types, via relations, both a via node and via ways, no from or no to way, mandatory
    ones with several, values that can't be read, and unconditional ones with a via node, which the plain decoder has.
    """
    t = F.col("tags")
    first = lambda keys: F.coalesce(*[osm.tag(t, k) for k in keys])
    ids = lambda role, kind: F.transform(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == kind)), lambda m: m["id"])
    rows = relations.select(
        F.col("id").alias("relation_id"), osm.tag(t, "type").alias("type"), first(tags[0]).alias("conditional"), first(tags[1]).alias("plain"),
        ids("from", "way").alias("froms"), ids("to", "way").alias("tos"), ids("via", "way").alias("via_ways"), ids("via", "node").alias("via_nodes"), F.size(ids("via", "relation")).alias("via_relations"),
    )
    rows = rows.where((F.col("type") == "restriction") | F.col("type").startswith("restriction:")).withColumn("via_node", F.element_at(F.concat(F.array(F.lit(None).cast("bigint")), "via_nodes"), -1))
    rows = rows.where((F.col("via_relations") == 0) & ~(F.col("via_node").isNotNull() & (F.size("via_ways") > 0)) & (F.size("froms") > 0) & (F.size("tos") > 0))
    split = osm.conditional(F.col("conditional"))
    rows = rows.withColumn("c", split).where(F.col("conditional").isNotNull() | (F.col("plain").isNotNull() & (F.size("via_ways") > 0)))
    rows = rows.withColumn("r", osm.restriction(F.when(F.col("conditional").isNotNull(), F.col("c.value")).otherwise(F.col("plain")))).where("r is not null")
    rows = rows.where((F.col("r.kind") != "mandatory") | ((F.size("froms") == 1) & (F.size("tos") == 1)))
    condition = F.when(F.col("conditional").isNotNull(), F.col("c.condition")).otherwise("")
    rows = rows.select("relation_id", F.col("r.kind").alias("kind"), F.col("r.direction").alias("direction"), F.explode("froms").alias("from_way"), "tos", "via_node", "via_ways", condition.alias("condition"))
    return rows.select("relation_id", "kind", "direction", "from_way", F.explode("tos").alias("to_way"), "via_node", "via_ways", "condition")


def _steps(found: DataFrame) -> DataFrame:
    """``key, step, way, next_way``: neighbours of each chain of ways."""
    ways = F.concat(F.array("from_way"), "via_ways", F.array("to_way"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("via_ways")), lambda i: F.struct(i.alias("step"), F.get(ways, i).alias("way"), F.get(ways, i + 1).alias("next_way")))
    return found.select("key", "via_node", "direction", "kind", "condition", F.size("via_ways").alias("vias"), F.inline(pairs))


def _keyed(found: DataFrame) -> DataFrame:
    return found.withColumn("key", F.struct("relation_id", "from_way", "to_way"))


def corners(found: DataFrame, arcs: DataFrame, angles: bool = True) -> DataFrame:
    """``key, step, junction, from_arc, to_arc``: the pair of arcs at each junction of each restriction whose junctions and arcs are all unique.

    ``arcs``: ``arc_id, way_id, tail, head`` and the coordinates of both ends. The junction is the via node, if arcs know it, else the only node that
    both ways share. If several arcs fit at the entry, the only one whose angle fits the direction counts.
    """
    steps = _steps(_keyed(found))
    ends = arcs.select("way_id", F.col("tail").alias("node")).union(arcs.select("way_id", "head")).distinct()
    only = crossings(ends).toDF("way", "next_way", "only")
    known = ends.select("node").distinct().withColumnRenamed("node", "via_node").withColumn("known", F.lit(True))
    placed = steps.join(only, ["way", "next_way"], "left").join(known.hint("merge"), "via_node", "left").withColumn("junction", F.when(F.col("known") & (F.col("vias") == 0), F.col("via_node")).otherwise(F.col("only"))).where("junction is not null")
    a = arcs.select(F.col("arc_id").alias("from_arc"), F.col("way_id").alias("way"), F.col("head").alias("junction"), "tail_lat", "tail_lng", F.col("head_lat").alias("via_lat"), F.col("head_lng").alias("via_lng"))
    b = arcs.select(F.col("arc_id").alias("to_arc"), F.col("way_id").alias("next_way"), F.col("tail").alias("junction"), F.col("head_lat").alias("b_lat"), F.col("head_lng").alias("b_lng"))
    pairs = placed.join(a, ["way", "junction"]).join(b, ["next_way", "junction"])
    # the angle of the turn, counter-clockwise, with plain degrees
    turn = F.degrees(F.atan2(F.col("b_lat") - F.col("via_lat"), F.col("b_lng") - F.col("via_lng")) - F.atan2(F.col("via_lat") - F.col("tail_lat"), F.col("via_lng") - F.col("tail_lng")))
    fits = geo.direction_matches(turn, F.col("direction")) if angles else F.lit(False)
    counted = pairs.groupBy("key", "step", "junction", "vias").agg(
        F.count("*").alias("n"), F.count_if(fits).alias("fit"), F.min(F.struct("from_arc", "to_arc")).alias("any"), F.min(F.when(fits, F.struct("from_arc", "to_arc"))).alias("fitting"),
    )
    pair = F.when(F.col("n") == 1, F.col("any")).when((F.col("step") == 0) & (F.col("fit") == 1), F.col("fitting"))
    good = counted.withColumn("pair", pair).where("pair is not null")
    # all junctions of a chain, and none twice
    whole = good.groupBy("key", "vias").agg(F.count("*").alias("n"), F.count_distinct("junction").alias("d")).where("n = vias + 1 and d = n").select("key")
    return good.join(whole, "key", "left_semi").select("key", "step", "junction", F.col("pair.from_arc").alias("from_arc"), F.col("pair.to_arc").alias("to_arc"))


def conditional_turns(found: DataFrame, arcs: DataFrame) -> DataFrame:
    """``from_arc, to_arc, condition``: forbidden pairs, for mandatory restrictions all other exits of each junction.

    Of a pair that is forbidden at all times its conditions go; different conditions of a pair stay.
    """
    kinds = _keyed(found).select("key", "kind", "condition").distinct()
    at = corners(found, arcs).join(kinds, "key")
    exits = arcs.select(F.col("arc_id").alias("exit"), F.col("tail").alias("junction"))
    other = at.where("kind = 'mandatory'").join(exits, "junction").where("exit <> to_arc").select("from_arc", F.col("exit").alias("to_arc"), "condition")
    rows = at.where("kind = 'prohibitive'").select("from_arc", "to_arc", "condition").union(other).distinct()
    always = F.max(F.col("condition") == "").over(Window.partitionBy("from_arc", "to_arc"))
    return rows.withColumn("always", always).where("not always or condition = ''").drop("always")


def via_way_chains(found: DataFrame, arcs: DataFrame, most_steps: int = 1000) -> DataFrame:
    """``key, mandatory, arcs``: the arcs of each unconditional via-way restriction in driving order.

    Between two junctions the via way is followed from arc to arc as long as exactly one of its arcs goes on (not back); a way that
    forks, ends or takes more than ``most_steps`` drops the restriction. One join a step for all chains at once.
    """
    plain = materialize(found.where((F.col("condition") == "") & (F.size("via_ways") > 0)), "via-ways")
    at = materialize(corners(plain, arcs), "corners").hint("merge")  # every step and the legs at the end read it
    ways = _steps(_keyed(plain)).select("key", "step", F.col("next_way").alias("way"))
    order = Window.partitionBy("key").orderBy("step")
    gaps = at.join(ways, ["key", "step"]).withColumn("target", F.lead("junction").over(order)).where("target is not null")
    heads = arcs.select(F.col("arc_id").alias("to_arc"), F.col("head").alias("here"))
    front = gaps.join(heads, "to_arc").select("key", "step", "way", "target", "here", F.array().cast("array<bigint>").alias("walked"))
    leaving = arcs.groupBy(F.col("way_id").alias("way"), F.col("tail").alias("here")).agg(F.count("*").alias("n"), F.min("arc_id").alias("next_arc"), F.min("head").alias("next_node")).where("n = 1").drop("n")
    leaving = materialize(leaving.join(ways.select("way").distinct().hint("merge"), "way", "left_semi"), "leaving").hint("merge")
    done, tables = None, Tables(arcs.sparkSession)
    front = tables.write(front, "chains")
    for _ in range(most_steps):
        there = front.where("here = target").select("key", "step", "walked")
        done = there if done is None else done.union(there)
        front = front.where("here <> target").join(leaving, ["way", "here"]).select("key", "step", "way", "target", F.col("next_node").alias("here"), F.concat("walked", F.array("next_arc")).alias("walked"))
        front = tables.write(front, "chains")
        if front.isEmpty():
            break
    mandatory = _keyed(plain).select("key", (F.col("kind") == "mandatory").alias("mandatory")).distinct()
    legs = at.join(done, ["key", "step"], "left").withColumn("last", F.lead("junction").over(order).isNull())
    good = legs.groupBy("key").agg(F.bool_and(F.col("last") | F.col("walked").isNotNull()).alias("whole"), F.array_sort(F.collect_list(F.struct("step", "from_arc", "to_arc", "walked"))).alias("s")).where("whole")
    empty = F.array().cast("array<bigint>")
    rest = F.flatten(F.transform("s", lambda x: F.concat(F.array(x["to_arc"]), F.coalesce(x["walked"], empty))))
    return good.join(mandatory, "key").select("key", "mandatory", F.concat(F.array(F.get("s", F.lit(0))["from_arc"]), rest).alias("arcs"))


def matched(found: Column, wanted: Column) -> Column:
    """Whether a 128-bit set, as two numbers, has all bits of another."""
    return (found["high"].bitwiseAND(wanted["high"]) == wanted["high"]) & (found["low"].bitwiseAND(wanted["low"]) == wanted["low"])
