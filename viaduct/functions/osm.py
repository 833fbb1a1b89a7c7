"""Map tags to road properties, as column expressions over ``MAP<STRING, STRING>``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = 4294967295
#: Tag values of each profile and default speeds: fixed values of the profiles.
OPEN_ACCESS = ("yes", "permissive", "delivery", "designated", "destination", "agricultural", "forestry", "public")
MOTOR_ACCESS = ("yes", "permissive", "delivery", "designated", "destination")
CAR_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "motorway_junction", "living_street", "track", "ferry")
NO_CAR_ROADS = ("construction", "path", "footway", "cycleway", "bridleway", "pedestrian", "bus_guideway", "raceway", "escape", "steps", "proposed", "conveying")
FOOT_ROADS = ("secondary", "tertiary", "unclassified", "residential", "service", "secondary_link", "tertiary_link", "living_street", "track", "bicycle_road", "path", "footway", "cycleway", "bridleway", "pedestrian", "escape", "steps", "crossing", "escalator", "elevator", "platform", "ferry")
BIKE_ROADS = ("secondary", "tertiary", "unclassified", "residential", "service", "secondary_link", "tertiary_link", "living_street", "track", "bicycle_road", "primary", "primary_link", "path", "footway", "cycleway", "bridleway", "pedestrian", "crossing", "escape", "steps", "ferry")
CAR_SPEEDS = {"motorway": 100, "motorway_link": 40, "trunk": 70, "trunk_link": 35, "primary": 50, "primary_link": 30, "secondary": 40, "secondary_link": 25, "tertiary": 30, "tertiary_link": 20, "unclassified": 20, "residential": 20, "living_street": 10, "service": 4, "track": 4, "ferry": 5}
MOTORCYCLE_SPEEDS = {"motorway": 65, "motorway_link": 40, "trunk": 60, "trunk_link": 30, "primary": 55, "primary_link": 35, "secondary": 45, "secondary_link": 25, "tertiary": 40, "tertiary_link": 20, "unclassified": 30, "residential": 25, "living_street": 15, "service": 15, "track": 15, "path": 15, "ferry": 5}
NAMED_SPEEDS = {"none": 130, "unlimited": 130, "walk": 5, "foot": 5, "urban": 40, "living_street": 10, "de:rural": 100, "at:rural": 100, "ro:rural": 100, "ru:rural": 90, "ua:rural": 90, "ru:motorway": 110, "ch:motorway": 120, "at:motorway": 130, "ro:motorway": 130, "de:motorway": 130, "national": 100, "ro:trunk": 100, "dk:rural": 80, "ch:rural": 80, "fr:rural": 80, "it:rural": 90, "hu:rural": 90, "de:zone:30": 30, "de:zone30": 30, "at:zone30": 30}
BACK, AHEAD, BOTH = ("-1", "reverse", "backward"), ("yes", "true", "1"), ("no", "false", "0")


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def _has(tags: Column, key: str) -> Column:
    return tag(tags, key).isNotNull()


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _ferry(tags: Column, word: str) -> Column:
    return _is(tags, "route", "ferry") | _is(tags, "ferry", word)


def _closed_access(tags: Column, values: tuple[str, ...]) -> Column:
    return _has(tags, "access") & ~_is(tags, "access", *values)


def used_by_cars(tags: Column) -> Column:
    """A junction is open before any access is looked at."""
    road = tag(tags, "highway")
    no = _is(tags, "motorcar", "no") | _is(tags, "motor_vehicle", "no") | _closed_access(tags, MOTOR_ACCESS)
    return (
        F.when(_has(tags, "junction") | _ferry(tags, "yes"), True)
        .when(road.isNull() | no, False)
        .when(road.isin(*CAR_ROADS), True)
        .when(road == "bicycle_road", _is(tags, "motorcar", "yes"))
        .when(road.isin(*NO_CAR_ROADS) | _is(tags, "oneway", "reversible", "alternating"), False)
        .otherwise(_has(tags, "maxspeed"))
    )


def used_by_motorcycles(tags: Column) -> Column:
    """Access first, then junctions; an explicit permission overrides a closed access."""
    road = tag(tags, "highway")
    yes = _is(tags, "motorcycle", "yes") | _is(tags, "motor_vehicle", "yes")
    no = _is(tags, "motorcycle", "no") | _is(tags, "motor_vehicle", "no") | (_closed_access(tags, MOTOR_ACCESS) & ~yes)
    return (
        F.when(no, False)
        .when(_has(tags, "junction") | _ferry(tags, "yes"), True)
        .when(road.isNull(), False)
        .when(road.isin(*CAR_ROADS), True)
        .when(road.isin("bicycle_road", "path"), yes)
        .when(road.isin(*NO_CAR_ROADS) | _is(tags, "oneway", "reversible", "alternating"), False)
        .otherwise(_has(tags, "maxspeed"))
    )


def used_by_bicycles(tags: Column) -> Column:
    road = tag(tags, "highway")
    lane = _has(tags, "cycleway") | _has(tags, "cycleway:left") | _has(tags, "cycleway:right") | _has(tags, "cycleway:both")
    no = (road == "proposed") | _closed_access(tags, OPEN_ACCESS) | _is(tags, "bicycle", "no", "use_sidepath")
    return F.when(_has(tags, "junction") | _ferry(tags, "ferry"), True).when(road.isNull() | no, False).when(lane, True).otherwise(road.isin(*BIKE_ROADS))


def used_by_pedestrians(tags: Column) -> Column:
    road = tag(tags, "highway")
    stop = _is(tags, "public_transport", "stop_position", "platform", "stop_area", "station") | _is(tags, "railway", "halt", "platform", "subway_entrance", "station", "tram_stop")
    no = _closed_access(tags, OPEN_ACCESS) | _is(tags, "crossing", "no")
    return F.when(_has(tags, "junction") | _ferry(tags, "ferry") | stop, True).when(road.isNull() | no, False).otherwise(road.isin(*FOOT_ROADS))


def speed_value(value: Column) -> Column:
    """One lower-case maxspeed entry in km/h, null if it says nothing."""
    number = F.regexp_extract(value, r"^(\d+)", 1)
    unit = F.trim(F.regexp_extract(value, r"^\d+ *(.*)$", 1))
    n = F.when(number != "", number.cast("bigint"))
    named = F.when(value.rlike("^..:walk$"), 5).when(value.rlike("^..:urban$"), 40).when(value.rlike("^..:living_street$"), 10).otherwise(_lookup(NAMED_SPEEDS, value))
    return F.coalesce(named.cast("bigint"), F.when(unit == "mph", F.floor(n * 1609 / 1000)).when(unit == "knots", F.floor(n * 1852 / 1000)).otherwise(n))


def speed_tag(value: Column) -> Column:
    """The least entry of a ``;`` list; 0 becomes 1; null if unposted or unknown."""
    least = F.array_min(F.array_compact(F.transform(F.split(F.lower(value), " *; *"), speed_value)))
    return F.when((value != "unposted") & least.isNotNull(), F.greatest(least, F.lit(1).cast("bigint")))


def car_speed(tags: Column) -> Column:
    road = _lookup(CAR_SPEEDS, tag(tags, "highway"))
    rest = F.when(_has(tags, "junction"), 15).when(_is(tags, "route", "ferry") | _has(tags, "ferry"), 5).otherwise(50)
    return F.coalesce(speed_tag(tag(tags, "maxspeed")), road.cast("bigint"), rest.cast("bigint"))


def motorcycle_speed(tags: Column) -> Column:
    road = _lookup(MOTORCYCLE_SPEEDS, tag(tags, "highway"))
    rest = F.when(_has(tags, "junction"), 20).when(_is(tags, "route", "ferry") | _has(tags, "ferry"), 5).otherwise(50)
    return F.coalesce(speed_tag(tag(tags, "maxspeed:motorcycle")), speed_tag(tag(tags, "maxspeed")), road.cast("bigint"), rest.cast("bigint"))


def way_name(tags: Column) -> Column:
    return F.concat_ws(";", tag(tags, "name"), tag(tags, "ref"))


def car_direction(tags: Column) -> Column:
    one = tag(tags, "oneway")
    posted = F.when(one.isin(*BACK), "backward").when(one.isin(*AHEAD), "forward").when(one.isin("reversible", "alternating"), "closed").otherwise("both")
    plain = F.when(_is(tags, "junction", "roundabout") | _is(tags, "highway", "motorway", "motorway_link"), "forward").otherwise("both")
    return F.when(one.isNotNull(), posted).otherwise(plain)


def motorcycle_direction(tags: Column) -> Column:
    own = tag(tags, "oneway:motorcycle")
    posted = F.when(own.isin("-1", "opposite"), "backward").when(own.isin(*AHEAD), "forward").when(own.isin(*BOTH), "both").otherwise("closed")
    return F.when(own.isNotNull(), posted).otherwise(car_direction(tags))


def bicycle_direction(tags: Column) -> Column:
    own, one = tag(tags, "oneway:bicycle"), tag(tags, "oneway")
    posted = F.when(own.isin("-1", "opposite"), "backward").when(own.isin(*AHEAD), "forward").when(own.isin(*BOTH), "both").otherwise("closed")
    lanes = _is(tags, "cycleway", "opposite", "opposite_track", "opposite_lane", "opposite_share_busway") | _has(tags, "cycleway:both") | (_has(tags, "cycleway:left") & _has(tags, "cycleway:right"))
    plain = F.when(one.isNull() | one.isin(*BOTH) | lanes, "both").when(one.isin(*BACK), "backward").when(one.isin(*AHEAD), "forward").otherwise("closed")
    return F.when(own.isNotNull(), posted).otherwise(plain)


def bicycle_comfort(tags: Column) -> Column:
    """0 (worst) to 4."""
    lane = F.when(_is(tags, "cycleway", "track"), 3).otherwise(2)
    return F.when(_is(tags, "highway", "cycleway"), 4).when(_has(tags, "cycleway"), lane).when(_is(tags, "highway", "primary", "primary_link") | _is(tags, "bicycle", "dismount"), 0).otherwise(1)


def restriction(value: Column) -> Column:
    """``struct(kind, direction)`` of ``no_left_turn`` and its like; null for other values."""
    kind, way = F.regexp_extract(value, "^(no|only)_", 1), F.regexp_extract(value, "^(?:no|only)_(left_turn|right_turn|straight_on|u_turn)$", 1)
    named = F.when(kind == "no", "prohibitive").otherwise("mandatory")
    return F.when(way != "", F.struct(named.alias("kind"), way.alias("direction")))


def conditional(value: Column) -> Column:
    """``struct(value, condition)`` of ``no_left_turn @ (Mo-Fr 07:00-09:00)``."""
    parts = F.split(value, r"\s*@\s*", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(F.get(parts, F.lit(0))).alias("value"), F.regexp_replace(F.trim(F.get(parts, F.lit(1))), r"^\(|\)$", "").alias("condition")))


DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
_TIME = re.compile(r"^(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})$")


def parse_windows(condition: str) -> list[tuple[int, int, int]] | None:
    """Windows (day bits, Monday first; start and end minute) of an opening-hours text; None if it can't be read.

    Days: ``Mo``, ``Mo-Fr``, ``Sa,Su``; a range over the whole week is all days. Holidays are skipped. Without days: all.
    """
    out: list[tuple[int, int, int]] = []
    days = 127
    for block in condition.split(";"):
        days = 127
        for word in block.replace(", ", ",").split():
            if word[:2] in (*DAYS, "PH", "SH"):
                days = 0
                for part in word.split(","):
                    first, _, last = part.partition("-")
                    if first in ("PH", "SH"):
                        continue
                    if first not in DAYS or (last and last not in DAYS):
                        return None
                    a, b = DAYS.index(first), DAYS.index(last or first)
                    for d in range(a, b + 1 if b >= a else b + 8):
                        days |= 1 << d % 7
                continue
            for span in word.split(","):
                m = _TIME.match(span)
                if not m:
                    return None
                h, i, k, j = map(int, m.groups())
                if h > 24 or k > 24 or i > 59 or j > 59:
                    return None
                if days:
                    out.append((days, (h * 60 + i) % 1440, (k * 60 + j) % 1440))
    return out or None


WINDOWS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("day_mask", "start_min", "end_min")]))


@F.pandas_udf(WINDOWS)
def windows(conditions: pd.Series) -> pd.Series:
    """Time windows of each condition; null (never "always") if it can't be read."""
    return conditions.map(lambda c: None if c is None or (w := parse_windows(c)) is None else [{"day_mask": a, "start_min": b, "end_min": e} for a, b, e in w])


def window_active(list_: Column, day: Column, minute: Column) -> Column:
    """Whether a window holds on day 0 (Monday) to 6 at a minute: ends are open, midnight wraps on the asked day, start = end is all day."""

    def holds(w):
        inside = F.when(w["start_min"] == w["end_min"], True).when(w["start_min"] < w["end_min"], (minute >= w["start_min"]) & (minute < w["end_min"])).otherwise((minute >= w["start_min"]) | (minute < w["end_min"]))
        return (w["day_mask"].bitwiseAND(F.pow(F.lit(2), day).cast("int")) != 0) & inside

    return F.exists(list_, holds)
