"""Geometry on coordinates in degrees, as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Radii in metres and metres a degree: fixed values of the formulas.
RADIUS_M, SPHERE_M, DEGREE_M = 6_371_000.0, 6_371_000.785, 111_320.0


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


@F.pandas_udf(DoubleType())
def _central_angle(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
    """By the C library, as SQL takes it: near 1 the arc cosine multiplies last bits, which Java's sines and cosines round otherwise."""

    def angle(a: float, b: float, d: float) -> float:
        if not (math.isfinite(a) and math.isfinite(b) and math.isfinite(d)):
            return math.nan
        return math.acos(max(-1.0, min(1.0, math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(d))))

    return pd.Series([angle(*x) for x in zip(a.tolist(), b.tolist(), d.tolist(), strict=True)], dtype="float64")


def spherical_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines; the cosine is clamped, so equal points are 0 apart."""
    return SPHERE_M * _central_angle(F.radians(lat1), F.radians(lat2), F.radians(lng1 - lng2))


def ellipsoid_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Short distances on the WGS84 ellipsoid, by its radii of curvature at the mean latitude."""
    a, e2 = 6_378_137.0, 0.00669437999014
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - e2 * F.sin(mid) * F.sin(mid)
    north = F.radians(lat2 - lat1) * (a * (1 - e2)) / (w * F.sqrt(w))
    east = F.radians(lng2 - lng1) * a / F.sqrt(w) * F.cos(mid)
    return F.sqrt(north * north + east * east)


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360; 0 for equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    x = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when((lat1 == lat2) & (lng1 == lng2), 0.0).when(x < 0, x + 360).otherwise(x)


def wrap_degrees(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0)) + 0.0  # no negative zero


def angle_gap(a: Column, b: Column) -> Column:
    d = F.abs(wrap_degrees(a) - wrap_degrees(b))
    return F.least(d, 360 - d)


def point_segment_m(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """Distance to a segment in the plane that touches the globe at the point."""
    east = lambda x: F.radians(x - lng) * RADIUS_M * F.cos(F.radians(lat))
    north = lambda y: F.radians(y - lat) * RADIUS_M
    ax, ay, dx, dy = east(a_lng), north(a_lat), east(b_lng) - east(a_lng), north(b_lat) - north(a_lat)
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(_clamped(-(ax * dx + ay * dy) / F.nullif(size, F.lit(0.0)), 0.0, 1.0))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def segment_projection(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """``struct(distance_m, t)``: projection with longitudes scaled at the segment's middle latitude."""
    scale = F.cos(F.radians((a_lat + b_lat) / 2))
    dx, dy = b_lat - a_lat, (b_lng - a_lng) * scale
    size = dx * dx + dy * dy
    t = F.when(size < 1e-20, 0.0).otherwise(_clamped(((lat - a_lat) * dx + (lng - a_lng) * scale * dy) / F.nullif(size, F.lit(0.0)), 0.0, 1.0))
    return F.struct(haversine_m(lat, lng, a_lat + t * (b_lat - a_lat), a_lng + t * (b_lng - a_lng)).alias("distance_m"), t.alias("t"))


def flat_projection(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """``struct(distance_m, t)`` with unscaled degrees, as clipping uses it."""
    dx, dy = b_lat - a_lat, b_lng - a_lng
    size = dx * dx + dy * dy
    t = F.when(size < 1e-14, 0.0).otherwise(_clamped(((lat - a_lat) * dx + (lng - a_lng) * dy) / F.nullif(size, F.lit(0.0)), 0.0, 1.0))
    return F.struct(haversine_m(lat, lng, a_lat + t * dx, a_lng + t * dy).alias("distance_m"), t.alias("t"))


def polyline_lengths(points: Column, meters=haversine_m) -> Column:
    """Running length at every point of ``array<struct<lat, lng>>``, from 0."""
    pairs = F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.coalesce(meters(a["lat"], a["lng"], b["lat"], b["lng"]), F.lit(0.0)))
    steps = F.slice(pairs, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    start = F.array(F.lit(0.0))
    return F.aggregate(steps, start, lambda have, s: F.concat(have, F.array(F.element_at(have, -1) + s)))


def polyline_projection(lat: Column, lng: Column, points: Column) -> Column:
    """``struct(distance_m, segment, t)`` of the nearest segment; the first one wins ties."""
    n = F.size(points) - 1
    each = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            segment_projection(lat, lng, F.get(points, i)["lat"], F.get(points, i)["lng"], F.get(points, i + 1)["lat"], F.get(points, i + 1)["lng"])["distance_m"].alias("distance_m"),
            i.alias("segment"),
            segment_projection(lat, lng, F.get(points, i)["lat"], F.get(points, i)["lng"], F.get(points, i + 1)["lat"], F.get(points, i + 1)["lng"])["t"].alias("t"),
        ),
    )
    return F.array_min(each)


def turn_angle(a_lat: Column, a_lng: Column, v_lat: Column, v_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """``struct(angle_deg, cross)`` of the turn a, v, b; left turns are positive."""
    scale = F.cos(F.radians(v_lat))
    ax, ay, bx, by = (v_lng - a_lng) * scale, v_lat - a_lat, (b_lng - v_lng) * scale, b_lat - v_lat
    cross = ax * by - ay * bx
    return F.struct(F.degrees(F.atan2(cross, ax * bx + ay * by)).alias("angle_deg"), cross.alias("cross"))


def turn_class(angle: Column, cross: Column) -> Column:
    """straight below 20 degrees, slight below 40, plain below 110, sharp below 155; beyond, a U-turn goes left only."""
    size = F.abs(angle)
    side = lambda kind: F.when(cross > 0, f"{kind}left").when(cross < 0, f"{kind}right").otherwise("straight")
    return F.when(size < 20, "straight").when(size < 40, side("slight_")).when(size < 110, side("")).when(size < 155, side("sharp_")).when(cross >= 0, "u_turn").otherwise("sharp_right")


def turn_class_wide(angle: Column) -> Column:
    """The diagnostic classes: straight up to 25 degrees, U-turn from 155."""
    return F.when(F.abs(angle) < 25, "straight").when(F.abs(angle) >= 155, "u_turn").when(angle > 0, "left").otherwise("right")


def roundabout_exit(angle: Column) -> Column:
    return F.when(F.abs(angle) < 30, "exit_straight").when(F.abs(angle) >= 135, "exit_u_turn").when(angle > 0, "exit_left").otherwise("exit_right")


def direction_matches(angle: Column, direction: Column) -> Column:
    """Whether a counter-clockwise angle in degrees fits a restriction's direction."""
    a = wrap_degrees(angle)
    return F.when(direction == "left_turn", a.between(45, 135)).when(direction == "right_turn", a.between(225, 315)).when(direction == "straight_on", (a <= 60) | (a >= 300)).when(direction == "u_turn", a.between(120, 240)).otherwise(False)


def grid_cell(x: Column, degrees: float) -> Column:
    return F.floor(x / F.lit(degrees))


def in_padded_box(lat: Column, lng: Column, box: dict[str, Column], padding_m: float = 1500.0) -> Column:
    """Inside a box that is widened on all sides; longitudes are scaled at the box's centre."""
    y = padding_m / DEGREE_M
    x = padding_m / (DEGREE_M * F.cos(F.radians((box["min_lat"] + box["max_lat"]) / 2)))
    return lat.between(box["min_lat"] - y, box["max_lat"] + y) & lng.between(box["min_lng"] - x, box["max_lng"] + x)


def partial_cost(full: Column, part_m: Column, total_m: Column) -> Column:
    """An edge's cost in proportion to the part that is driven, rounded; 1 mm counts as nothing."""
    share = F.round(full * _clamped(part_m / F.nullif(total_m, F.lit(0.0)), 0.0, 1.0)).cast("bigint")
    return F.when(part_m <= 1e-3, F.lit(0).cast("bigint")).when(total_m <= 1e-3, full).otherwise(share)


def drop_close_points(points: Column, meters: float = 1.0) -> Column:
    """Points that are ``meters`` or more from the last one kept."""
    near = lambda have, p: haversine_m(F.element_at(have, -1)["lat"], F.element_at(have, -1)["lng"], p["lat"], p["lng"]) < meters
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1), lambda have, p: F.when(near(have, p), have).otherwise(F.concat(have, F.array(p))))
