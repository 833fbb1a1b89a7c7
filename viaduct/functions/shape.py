"""Shapes of routes: ``array<struct<lat, lng>>`` columns and what happens to them around snapped places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions import geo

#: Positions closer than this, in metres, are the same place on a polyline; points closer than a metre are one point. Fixed values.
SAME_PLACE_M, ONE_POINT_M = 1e-3, 1.0


def meters(a: Column, b: Column) -> Column:
    return geo.haversine_m(a["lat"], a["lng"], b["lat"], b["lng"])


def expanded(polylines: Column) -> Column:
    """``struct(points, ends)``: the polylines one after another without repeated neighbours, and at which point each one ends."""
    flat = F.flatten(polylines)
    fresh = F.transform(flat, lambda p, i: F.when((i == 0) | ~p.eqNullSafe(F.get(flat, i - 1)), 1).otherwise(0))
    points = F.filter(flat, lambda p, i: F.get(fresh, i) == 1)
    zero = F.lit(0)
    sizes = F.transform(polylines, lambda x: F.size(x))
    kept = lambda n: F.aggregate(F.slice(fresh, 1, n), zero, lambda total, x: total + x)
    ends = F.transform(sizes, lambda _, i: kept(F.aggregate(F.slice(sizes, 1, i + 1), zero, lambda total, x: total + x)) - 1)
    return F.struct(points.alias("points"), ends.alias("ends"))


def between(points: Column, low: Column, high: Column) -> Column:
    """The inner points strictly between two positions along a polyline, in the order from ``low`` to ``high``."""
    at = geo.polyline_lengths(points)
    least, most = F.least(low, high) + SAME_PLACE_M, F.greatest(low, high) - SAME_PLACE_M
    inside = F.filter(points, lambda p, i: (i > 0) & (i < F.size(points) - 1) & (F.get(at, i) >= least) & (F.get(at, i) <= most))
    inside = F.when(F.abs(high - low) <= SAME_PLACE_M, F.slice(points, 1, 0)).otherwise(inside)
    return F.when(low <= high, inside).otherwise(F.reverse(inside))


def connector(points: Column, snap_m: Column, to_head: Column) -> Column:
    """The inner points from a snapped place to the polyline's head, or back to its tail."""
    end = F.element_at(geo.polyline_lengths(points), -1)
    return F.when(to_head, between(points, snap_m, F.greatest(end, snap_m))).otherwise(F.reverse(between(points, F.lit(0.0), snap_m)))


def with_start(route: Column, projected: Column, connecting: Column) -> Column:
    """``struct(points, added)``: the projected place, unless the next point is it, and the connector before the route."""
    first = F.coalesce(F.get(connecting, F.lit(0)), F.get(route, F.lit(0)))
    place = F.when(first.isNull() | (meters(projected, first) >= ONE_POINT_M), F.array(projected)).otherwise(F.slice(F.array(projected), 1, 0))
    before = F.concat(place, connecting)
    return F.struct(F.concat(before, route).alias("points"), F.size(before).alias("added"))


def with_end(route: Column, projected: Column, connecting: Column) -> Column:
    """``struct(points, added)``: the mirror of ``with_start``; the connector is in the direction of travel."""
    found = with_start(F.reverse(route), projected, F.reverse(connecting))
    return F.struct(F.reverse(found["points"]).alias("points"), found["added"].alias("added"))


def clipped_start(frame: DataFrame, points: str, out: str) -> DataFrame:
    """``frame`` with ``out``: ``struct(points, clipped)``, the column ``points`` without the way back to its first point, the anchor.

    Of the segments from the second point on, the one nearest to the anchor (the first of equals; the search stops once a segment under 10 m
    is followed by one three times as far) takes its place, if it is nearer than the second point. The steps are columns of their own, so
    none is worked out more than once.
    """
    hits, best = unused(f"{out}_hits", frame.columns), unused(f"{out}_best", frame.columns)
    p = F.col(points)
    n, at = F.size(p), lambda i: F.get(p, i)
    anchor = at(F.lit(0))
    project = lambda a, b: geo.flat_projection(anchor["lat"], anchor["lng"], a["lat"], a["lng"], b["lat"], b["lng"])
    segments = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))

    def step(have: Column, hit: Column) -> Column:
        better = ~have["over"] & (hit["h"]["distance_m"] < have["m"])
        m = F.when(better, hit["h"]["distance_m"]).otherwise(have["m"])
        over = have["over"] | ((m < 10) & (hit["h"]["distance_m"] > m * 3))
        return F.struct(m.alias("m"), F.when(better, hit["i"]).otherwise(have["segment"]).alias("segment"), F.when(better, hit["h"]["t"]).otherwise(have["t"]).alias("t"), over.alias("over"))

    start = F.struct(F.lit(1e300).alias("m"), F.lit(0).alias("segment"), F.lit(0.0).alias("t"), F.lit(False).alias("over"))
    rows = frame.withColumn(hits, F.transform(segments, lambda i: F.struct(i.alias("i"), project(at(i), at(i + 1)).alias("h"))))
    rows = rows.withColumn(best, F.aggregate(hits, start, step))
    s, t = F.col(best)["segment"], F.col(best)["t"]
    real = (n >= 3) & ~((s <= 1) & (t < 0.01)) & (F.col(best)["m"] < meters(anchor, at(F.lit(1))))
    crossing = F.struct((at(s)["lat"] + (at(s + 1)["lat"] - at(s)["lat"]) * t).alias("lat"), (at(s)["lng"] + (at(s + 1)["lng"] - at(s)["lng"]) * t).alias("lng"))
    cut = F.concat(F.array(anchor, crossing), F.slice(p, s + 2, F.greatest(n - s - 1, F.lit(0))))
    found = F.struct(F.when(real, cut).otherwise(p).alias("points"), F.when(real, F.greatest(s - 1, F.lit(0))).otherwise(F.lit(0)).alias("clipped"))
    return rows.withColumn(out, found).drop(hits, best)


def clipped_end(frame: DataFrame, points: str, out: str) -> DataFrame:
    """The mirror of ``clipped_start``: the anchor is the last point."""
    turned = unused(f"{out}_turned", frame.columns)
    rows = clipped_start(frame.withColumn(turned, F.reverse(points)), turned, out).drop(turned)
    return rows.withColumn(out, F.col(out).withField("points", F.reverse(F.col(out)["points"])))


def unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def remapped_turns(turns: Column, added: Column, clipped_front: Column, clipped_back: Column, route_points: Column) -> Column:
    """Turns ``array<struct<.., coordinate_index>>`` after the shape has changed: those in clipped parts go, index 0 stays."""
    i = lambda t: t["coordinate_index"]
    kept = F.filter(turns, lambda t: (i(t) == 0) | ((i(t) >= clipped_front) & (i(t) < F.greatest(route_points - clipped_back, F.lit(0)))))
    return F.transform(kept, lambda t: t.withField("coordinate_index", F.when(i(t) == 0, i(t)).otherwise(i(t) + added - clipped_front)))


def deviation(candidate: Column, costs: Column, reference: Column) -> Column:
    """``struct(a_pos, b_pos, cost_s_a, cost_b_t)``: where node paths part and meet again, and the candidate's costs before and after; null if one begins like the other to its end."""
    n, m, zero = F.size(candidate), F.size(reference), F.lit(0).cast("bigint")
    least = F.least(n, m)
    apart = F.filter(F.sequence(F.lit(0), F.greatest(least - 2, F.lit(0))), lambda i: F.get(candidate, i + 1) != F.get(reference, i + 1))
    a = F.get(apart, F.lit(0))
    room = F.least(n - 1 - a, m - 1)
    back = F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(1)) - 1), lambda k: F.get(candidate, n - 1 - k) != F.get(reference, m - 1 - k))
    same = F.coalesce(F.get(back, F.lit(0)), room)
    total = lambda part: F.aggregate(part, zero, lambda have, x: have + x)
    tail = F.slice(costs, n - same + 1, F.greatest(same - 1, F.lit(0)))
    found = F.struct(a.alias("a_pos"), (n - same).alias("b_pos"), total(F.slice(costs, 1, a)).alias("cost_s_a"), total(tail).alias("cost_b_t"))
    return F.when((n >= 2) & (m >= 2) & a.isNotNull(), found)
