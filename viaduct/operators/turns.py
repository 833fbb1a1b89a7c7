"""Turn instructions of routes: gaps and islands over ordered turns.

Turns are rows ``route_id, pos, direction, angle, at_m (distance from the start), degree, roundabout``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions import geo

FIELDS = ("route_id", "pos", "direction", "angle", "at_m", "degree", "roundabout")
SLIGHT, SHARP, U_TURN, STRAIGHT, NEAR_M = 40.0, 110.0, 155.0, 20.0, 50.0


def _order():
    return Window.partitionBy("route_id").orderBy("pos")


def _islands(rows: DataFrame, member) -> DataFrame:
    """Rows with ``island``: consecutive members share one, every other row has its own."""
    before = F.coalesce(F.lag(member).over(_order()), F.lit(False))
    fresh = F.when(member & before, 0).otherwise(1)
    return rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(_order())).drop("fresh")


def drop_bends(rows: DataFrame) -> DataFrame:
    """Without bends of less than 40 degrees where no other road leaves; their angles are not handed on."""
    return rows.where(~((F.col("degree") == 2) & (F.abs("angle") < SLIGHT)))


def merge_straights(rows: DataFrame) -> DataFrame:
    """Consecutive straights become their first one, with the sum of their angles."""
    island = _islands(rows, F.col("direction") == "straight").groupBy("route_id", "island")
    first = F.min(F.struct("pos", "direction", "at_m", "degree", "roundabout")).alias("f")
    return island.agg(first, F.sum("angle").alias("angle")).select("route_id", "f.pos", "f.direction", "angle", "f.at_m", "f.degree", "f.roundabout")


def collapse_roundabouts(rows: DataFrame) -> DataFrame:
    """A run on a roundabout becomes its entry and an exit that is classed by the run's net angle."""
    marked = _islands(rows, F.col("roundabout"))
    plain = marked.where("not roundabout").select(*FIELDS)
    runs = marked.where("roundabout").groupBy("route_id", "island").agg(F.min(F.struct("pos", "angle", "at_m", "degree")).alias("a"), F.max(F.struct("pos", "at_m", "degree")).alias("z"), F.sum("angle").alias("net"), F.count("*").alias("n"))
    enter = runs.select("route_id", "a.pos", F.lit("roundabout_enter").alias("direction"), "a.angle", "a.at_m", "a.degree", F.lit(True).alias("roundabout"))
    leave = runs.where("n > 1").select("route_id", "z.pos", geo.roundabout_exit(F.col("net")).alias("direction"), F.col("net").alias("angle"), "z.at_m", "z.degree", F.lit(True).alias("roundabout"))
    return plain.union(enter).union(leave)


def with_distances(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``to_next_m``: the first turn counts from the start, the last one to the route's ``length_m``."""
    start = F.when(F.row_number().over(_order()) == 1, 0.0).otherwise(F.col("at_m"))
    end = F.coalesce(F.lead("at_m").over(_order()), F.col("length_m"))
    return rows.join(lengths, "route_id").withColumn("to_next_m", end - start).drop("length_m")


def strip_straights(rows: DataFrame) -> DataFrame:
    """Straights hand their distance to the turn before them; those before any turn are kept as one."""
    turn = F.when(F.col("direction") == "straight", 0).otherwise(1)
    grouped = rows.withColumn("g", F.sum(turn).over(_order())).groupBy("route_id", "g")
    first, last = F.min(F.struct("pos", "direction", "angle", "at_m", "degree", "roundabout")).alias("f"), F.max(F.struct("pos", "at_m")).alias("l")
    out = grouped.agg(first, last, F.sum("to_next_m").alias("to_next_m"), F.sum("angle").alias("sum"))
    lead = F.col("g") == 0
    return out.select("route_id", "f.pos", "f.direction", F.when(lead, F.col("sum")).otherwise(F.col("f.angle")).alias("angle"), F.when(lead, F.col("l.at_m")).otherwise(F.col("f.at_m")).alias("at_m"), "f.degree", "f.roundabout", "to_next_m")


def collapse_compounds(rows: DataFrame) -> DataFrame:
    """Greedy from the left: two turns to one side at most 50 m apart become one, right ones up to 110 degrees in sum, left ones from 155.

    A fold over each route's array, as each pair depends on the one before.
    """
    fields = [c for c in ("pos", "direction", "angle", "at_m", "degree", "roundabout", "to_next_m")]
    whole = rows.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct(*fields, F.lit(False).alias("merged")))).alias("turns"))

    def step(have, b):
        a = F.element_at(have, -1)
        total = a["angle"] + b["angle"]
        big = (F.abs(a["angle"]) >= STRAIGHT) & (F.abs(b["angle"]) >= STRAIGHT) & (b["at_m"] - a["at_m"] <= NEAR_M) & ~a["merged"]
        right = big & (a["angle"] < 0) & (b["angle"] < 0) & (F.abs(total) <= SHARP)
        left = big & (a["angle"] > 0) & (b["angle"] > 0) & (F.abs(total) >= U_TURN)
        kind = F.when(left, F.lit("u_turn")).otherwise(geo.turn_class(total, F.lit(-1.0)))
        one = F.struct(a["pos"].alias("pos"), kind.alias("direction"), total.alias("angle"), a["at_m"].alias("at_m"), a["degree"].alias("degree"), (a["roundabout"] | b["roundabout"]).alias("roundabout"), (a["to_next_m"] + b["to_next_m"]).alias("to_next_m"), F.lit(True).alias("merged"))
        return F.when((F.size(have) > 0) & (right | left), F.concat(F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(have, F.array(b)))

    first = F.slice("turns", 1, 1)
    folded = F.aggregate(F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(0))), first, step)
    return whole.select("route_id", F.inline(folded)).drop("merged")


def refine(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The whole chain, in its fixed order."""
    merged = collapse_roundabouts(merge_straights(drop_bends(rows)))
    return collapse_compounds(strip_straights(with_distances(merged, lengths)))


def resolve_slight(turns: DataFrame, arcs: DataFrame, gap: float = 20.0) -> DataFrame:
    """At three exits or more, a straight or slight turn is slight towards its side of the nearest other exit within ``gap`` degrees, else straight.

    ``turns`` has ``from_arc, to_arc, angle, direction, degree`` and the corner's coordinates; ``arcs`` has end coordinates.
    """
    mild = F.col("direction").isin("straight", "slight_left", "slight_right") & (F.col("degree") >= 3)
    other = arcs.select(F.col("tail").alias("via"), F.col("arc_id").alias("other_arc"), F.col("head_lat").alias("o_lat"), F.col("head_lng").alias("o_lng"))
    near = turns.where(mild).join(other, "via").where("other_arc <> to_arc")
    angle = geo.turn_angle(*[F.col(c) for c in ("tail_lat", "tail_lng", "via_lat", "via_lng", "o_lat", "o_lng")])["angle_deg"]
    near = near.withColumn("other", angle).groupBy("from_arc", "to_arc").agg(F.min_by("other", F.struct(F.abs(F.col("angle") - F.col("other")), "other_arc")).alias("other"))
    joined = turns.join(near, ["from_arc", "to_arc"], "left")
    side = F.when(F.col("angle") > F.col("other"), "slight_left").otherwise("slight_right")
    return joined.withColumn("direction", F.when(mild, F.when(F.abs(F.col("angle") - F.col("other")) < gap, side).otherwise("straight")).otherwise(F.col("direction"))).drop("other")
