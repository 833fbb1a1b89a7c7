"""Speeds, occupancies and weights, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WEIGHT, CLOSED = 2147483646, 2147483647
#: How strongly each road class follows the time of day: fixed values.
CONGESTION = {"motorway": 1.0, "motorway_link": 1.0, "trunk": 0.8, "trunk_link": 0.8, "primary": 0.85, "primary_link": 0.85, "secondary": 0.55, "secondary_link": 0.55, "tertiary": 0.35, "tertiary_link": 0.35, "residential": 0.35, "living_street": 0.35, "service": 0.15}
MAJOR = ("motorway", "trunk", "primary", "secondary", "tertiary")


def wrap_hour(h: Column) -> Column:
    return F.pmod(h, F.lit(24.0)) + 0.0  # no negative zero


def hour_gap(a: Column, b: Column) -> Column:
    d = F.abs(wrap_hour(a) - wrap_hour(b))
    return F.least(d, 24 - d)


def gaussian(hour: Column, center: Column, sigma: float = 1.2) -> Column:
    x = hour_gap(hour, center) / sigma
    return F.exp(-0.5 * x * x)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def _waves(hour: Column, *parts: tuple[float, float, float]) -> Column:
    theta = wrap_hour(hour) / 24.0 * 2.0 * math.pi
    return sum((size * F.sin(theta * turns + shift) for size, turns, shift in parts[1:]), parts[0][0] * F.sin(theta * parts[0][1] + parts[0][2]))


def speed_jitter(hour: Column) -> Column:
    return _waves(hour, (0.012, 3.0, 0.4), (0.006, 7.0, -1.1))


def occupancy_jitter(hour: Column) -> Column:
    return _waves(hour, (0.012, 2.0, -0.8), (0.004, 5.0, 0.6))


def profile_speed(free_kmh: Column, free_occupancy: Column, peaks: Column, hour: Column) -> Column:
    """``struct(kmh, occupancy)``: peaks ``array<struct<hour, kmh, occupancy>>`` pull one after another, a jitter fades in between."""
    start = F.struct(free_kmh.alias("kmh"), free_occupancy.alias("occupancy"), F.lit(0.0).alias("top"))

    def pull(have, peak):
        w = gaussian(hour, peak["hour"])
        return F.struct(lerp(have["kmh"], peak["kmh"], w).alias("kmh"), lerp(have["occupancy"], peak["occupancy"], w).alias("occupancy"), F.greatest(have["top"], w).alias("top"))

    def finish(have):
        rest = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - have["top"]))
        occupancy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), have["occupancy"] + occupancy_jitter(hour) * rest))
        return F.struct((have["kmh"] * (1 + speed_jitter(hour) * rest)).alias("kmh"), occupancy.alias("occupancy"))

    return F.aggregate(peaks, start, pull, finish)


def occupancy_factor(occupancy: Column) -> Column:
    return 1.0 + 0.5 * (occupancy - 0.2)


def time_of_day_factor(hour: Column) -> Column:
    return 1.0 + 0.35 * gaussian(hour, F.lit(7.5), 1.2) + 0.45 * gaussian(hour, F.lit(17.5), 1.5) - 0.15 * gaussian(hour, F.lit(2.0), 2.0)


def congestion_scale(highway: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONGESTION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, highway), F.lit(0.3))


def clamp_weight(raw: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(MAX_WEIGHT).cast("bigint"), raw.cast("bigint")))


def safe_add(a: Column, b: Column) -> Column:
    return F.least(F.lit(MAX_WEIGHT).cast("bigint"), a + b)


def arc_travel_time(geo_m: Column, kmh: Column) -> Column:
    """Milliseconds, with both divisions truncated and 1 at least."""
    return F.greatest(F.floor(F.floor(geo_m * 18000 / kmh) / 5), F.lit(1).cast("bigint"))


def live_travel_time(geo_m: Column, kmh: Column) -> Column:
    return F.floor(geo_m * 100 * 36 / kmh)


def is_major(highway: Column) -> Column:
    return F.regexp_replace(highway, "_link$", "").isin(*MAJOR)


def traffic_class(base: Column, now: Column) -> Column:
    """red from infinity; green up to 1.15 times the base, or without one; yellow up to 1.60 times; else red."""
    ratio = now / F.nullif(base, F.lit(0))
    return F.when(now >= CLOSED, "red").when(base == 0, "green").when(ratio <= 1.15, "green").when(ratio <= 1.60, "yellow").otherwise("red")


def speed_kmh(meters: Column, millis: Column) -> Column:
    return F.when(millis > 0, meters * 3600.0 / millis)


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of an array by the rounded rank p (n - 1)."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.round(p * (F.size(ordered) - 1)).cast("int"))


def duration_text(micros: Column) -> Column:
    return F.when(micros >= 1_000_000, F.format_string("%.2f s", micros / 1e6)).when(micros >= 1000, F.format_string("%.2f ms", micros / 1e3)).otherwise(F.format_string("%d us", micros))


#: Metres a second of the speed categories 1 to 8: fixed values of the navigation tables.
CATEGORY_SPEEDS = (36.11, 31.94, 26.388, 22.22, 16.66, 11.11, 5.55, 1.38)


def category_speed(category: Column, limit_kmh: Column) -> Column:
    """A link's speed in metres a second: its category's, or the limit if that is lower. An unknown category has none."""
    own = F.get(F.array(*[F.lit(v) for v in CATEGORY_SPEEDS]), category - 1)
    return F.least(own, F.coalesce(limit_kmh, F.lit(999)) / 3.6)
