"""Named checks of a network, one row each: PASS, WARN or FAIL and how many rows offend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _row(frame: DataFrame, name: str, bad: str, level: str = "FAIL") -> DataFrame:
    n = F.count_if(F.expr(bad))
    return frame.agg(n.alias("offenders")).select(F.lit(name).alias("check"), F.when(F.col("offenders") == 0, "PASS").otherwise(level).alias("status"), "offenders")


def _exists(frame: DataFrame, name: str, level: str = "FAIL") -> DataFrame:
    return _row(frame, name, "true", level)


def check_network(nodes: DataFrame, arcs: DataFrame, turns: DataFrame, order: DataFrame, box: tuple[float, float, float, float] = (0.0, 30.0, 100.0, 115.0)) -> DataFrame:
    """All checks of nodes, arcs, forbidden turns ``from_arc, to_arc`` and the order ``node_id, rank``."""
    ids = nodes.select("node_id")
    kmh = "geo_distance * 3600.0 / travel_time"
    ends = arcs.select("arc_id", "tail", "head")
    a, b = ends.select(F.col("arc_id").alias("from_arc"), F.col("head").alias("at")), ends.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("out"))
    placed = turns.join(a, "from_arc", "left").join(b, "to_arc", "left")
    n = order.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    rows = [
        _exists(arcs.groupBy("arc_id").count().where("count > 1"), "arc ids unique"),
        _exists(ends.join(ids.withColumnRenamed("node_id", "head"), "head", "left_anti"), "heads exist"),
        _exists(ends.join(ids.withColumnRenamed("node_id", "tail"), "tail", "left_anti"), "tails exist"),
        _row(arcs, "no loops", "tail = head", "WARN"),
        _row(nodes, "coordinates in range", f"NOT (lat BETWEEN {box[0]} AND {box[1]} AND lng BETWEEN {box[2]} AND {box[3]})"),
        _row(arcs, "travel times up to a day", f"travel_time <= 0 OR travel_time > {DAY_MS}"),
        _row(arcs, "speeds plausible", f"geo_distance >= 100 AND ({kmh} > 180 OR {kmh} < 1)", "WARN"),
        _exists(turns.groupBy("from_arc", "to_arc").count().where("count > 1"), "turns unique"),
        _row(placed, "turns of known arcs", "at IS NULL OR out IS NULL"),
        _row(placed, "turns meet", "at <> out"),
        _exists(ids.join(ends.select(F.col("tail").alias("node_id")).union(ends.select("head")), "node_id", "left_anti"), "no isolated nodes", "WARN"),
        _row(n, "order is a permutation", "n <> d OR low <> 0 OR high <> n - 1"),
    ]
    return reduce(DataFrame.unionByName, rows)


def check_windows(windows: DataFrame) -> DataFrame:
    """Checks of ``from_arc, to_arc, windows``: day bits, minutes, overlaps."""
    w = windows.select("from_arc", "to_arc", F.posexplode("windows").alias("pos", "w")).select("from_arc", "to_arc", "pos", "w.*")
    other = w.select("from_arc", "to_arc", F.col("pos").alias("p"), F.col("day_mask").alias("d"), F.col("start_min").alias("s"), F.col("end_min").alias("e"))
    overlap = w.join(other, ["from_arc", "to_arc"]).where("pos < p AND (day_mask & d) <> 0 AND start_min < e AND s < end_min AND start_min < end_min AND s < e")
    return reduce(DataFrame.unionByName, [_row(w, "day bits", "day_mask <= 0 OR day_mask > 127"), _row(w, "minutes", "start_min NOT BETWEEN 0 AND 1439 OR end_min NOT BETWEEN 0 AND 1440"), _exists(overlap, "no overlaps", "WARN")])


def check_line_graph(lg: DataFrame, arcs: DataFrame, turns: DataFrame) -> DataFrame:
    """No forbidden turn is in it, every edge joins arcs that meet, turn costs are not negative."""
    a, b = arcs.select(F.col("arc_id").alias("from_arc"), F.col("head").alias("at")), arcs.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("out"), "travel_time")
    placed = lg.join(a, "from_arc", "left").join(b, "to_arc", "left")
    return reduce(DataFrame.unionByName, [_exists(lg.join(turns, ["from_arc", "to_arc"], "left_semi"), "no forbidden turn"), _row(placed, "edges meet", "at IS NULL OR out IS NULL OR at <> out"), _row(placed, "turn costs", "weight - travel_time < 0")])


def sample_reasons(samples: DataFrame) -> DataFrame:
    """``reason, samples`` of GPS samples ``edge, kmh, limit_kmh, fraction``: why each is left out, or ``ok``."""
    reason = F.when(F.col("edge").isNull(), "no_edge").when(F.col("kmh").isNull() | (F.col("kmh") < 0), "invalid").when(~F.col("fraction").between(0, 1), "out_of_range").when(F.col("kmh") > 1.5 * F.col("limit_kmh"), "too_fast").otherwise("ok")
    return samples.groupBy(reason.alias("reason")).agg(F.count("*").alias("samples"))
