"""Travel-time functions as a whole: from speeds, reduced, averaged, linked and merged."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.operators import timed

DAY_MS = timed.DAY_MS
POINTS = T.ArrayType(T.StructType([T.StructField("dt", T.LongType()), T.StructField("tt", T.LongType())]))


def no_zero(ttf: Column) -> Column:
    """Travel times of one millisecond at least."""
    return F.transform(ttf, lambda p: F.struct(p["dt"].alias("dt"), F.greatest(p["tt"], F.lit(1).cast("bigint")).alias("tt")))


def constant_lower(ttf: Column) -> Column:
    """The function's least value, for the whole day."""
    return F.array(F.struct(F.lit(0).cast("bigint").alias("dt"), timed.bounds(ttf)[0].alias("tt")))


def without_period_end(ttf: Column, period: int = DAY_MS) -> Column:
    """Without a last point at the period's end, which is its beginning."""
    last = F.element_at(ttf, -1)["dt"] == period
    return F.when(last, F.slice(ttf, 1, F.size(ttf) - 1)).otherwise(ttf)


def average(ttf: Column, start: int, end: int, period: int = DAY_MS) -> Column:
    """Mean over start .. end, truncated; a range with end < start goes over midnight."""
    at = lambda t: F.lit(t).cast("bigint")
    if start <= end:
        return timed.average(ttf, at(start), at(end))
    first, second = timed.area(ttf, at(start), at(period)), timed.area(ttf, at(0), at(end))
    return F.floor((first + second) / (2 * (period - start + end)))


def least_in(ttf: Column, start: int, end: int) -> Column:
    """The least value in a range of departures: a lower bound for every trip that begins in it."""
    return F.array_min(timed.points_in_range(ttf, F.lit(start).cast("bigint"), F.lit(end).cast("bigint")))


def day_profile(speeds: list[tuple[int, int]], length_m: int, period: int = DAY_MS) -> list[tuple[int, int]]:
    """Travel times of a link whose speed (km/h) changes at given times, as a function that keeps the order of departures.

    A vehicle drives with the speed of the moment, so the time it takes bends where the speed changes as it enters, or as it leaves. Both
    kinds of moments become points, in whole milliseconds; between them it is linear. ``speeds``: (time from 0, speed).
    """
    times, kmh = [t for t, _ in speeds], [v for _, v in speeds]

    def speed_at(t: float) -> tuple[int, float]:
        """The speed and how long it holds."""
        day, inside = divmod(t, period)
        i = bisect.bisect_right(times, inside) - 1
        end = times[i + 1] if i + 1 < len(times) else period
        return kmh[i], day * period + end

    def leaves(t: float) -> float:
        left = length_m * 3600.0  # in km/h times ms
        while True:
            v, end = speed_at(t)
            if v * (end - t) >= left:
                return t + left / v
            left -= v * (end - t)
            t = end

    def enters(t: float) -> float:
        """When a vehicle that leaves at t has entered."""
        left = length_m * 3600.0
        while True:
            day, inside = divmod(t, period)
            i = bisect.bisect_left(times, inside) - 1
            if i < 0:
                i, day = len(times) - 1, day - 1
            begin = day * period + times[i]
            if kmh[i] * (t - begin) >= left:
                return t - left / kmh[i]
            left -= kmh[i] * (t - begin)
            t = begin

    moments = {0.0, *map(float, times)} | {enters(float(t)) % period for t in times}
    points = sorted({round(t): leaves(t) - t for t in sorted(moments, reverse=True) if round(t) < period}.items())
    return [(t, max(1, round(x))) for t, x in points]


@F.pandas_udf(POINTS)
def speed_profile(speeds: pd.Series, lengths: pd.Series) -> pd.Series:
    """``ttf`` of ``array<struct<at, kmh>>`` and a length in metres."""
    one = lambda s, m: [{"dt": t, "tt": x} for t, x in day_profile([(int(p["at"]), int(p["kmh"])) for p in s], int(m))]
    return pd.Series([one(s, m) for s, m in zip(speeds, lengths, strict=True)])


#: A function of time as points (time, value) from 0 on, linear in between and over the period's end.
Line = list[tuple[float, float]]


def value(f: Line, t: float, period: float = DAY_MS) -> float:
    t %= period
    i = bisect.bisect_right(f, (t, float("inf"))) - 1
    (a, x), (b, y) = f[i], f[i + 1] if i + 1 < len(f) else (f[0][0] + period, f[0][1])
    return x if len(f) == 1 else x + (y - x) * (t - a) / (b - a)


def linked(f: Line, g: Line, period: float = DAY_MS) -> Line:
    """f, then g at the time of arrival. It bends where f does, and where f arrives at a bend of g."""
    moments = {t for t, _ in f} | {0.0}
    # f keeps the order of departures, so each bend of g is reached once a period
    ends = [(t + x, t) for t, x in f] + [(f[0][0] + period + f[0][1], f[0][0] + period)]
    for (a1, t1), (a2, t2) in zip(ends, ends[1:], strict=False):
        day = int(a1 // period)
        for shift in (day, day + 1):
            for bend, _ in g:
                arrival = bend + shift * period
                if a1 < arrival < a2:
                    moments.add((t1 + (t2 - t1) * (arrival - a1) / (a2 - a1)) % period)
    return _plain([(t, (x := value(f, t, period)) + value(g, t + x, period)) for t in sorted(moments)])


def merged(f: Line, g: Line, period: float = DAY_MS) -> tuple[Line, list[tuple[float, bool]]]:
    """The lesser of both, and from when on which one is better (True: f; ties go to f)."""
    moments = sorted({t for t, _ in f} | {t for t, _ in g} | {0.0})
    whole = list(moments)
    for a, b in zip(moments, [*moments[1:], period], strict=True):
        low, high = value(f, a, period) - value(g, a, period), value(f, b, period) - value(g, b, period)
        if low * high < 0:
            whole.append(a + (b - a) * low / (low - high))
    out, best = [], []
    whole.sort()
    for a, b in zip(whole, [*whole[1:], period], strict=True):
        out.append((a, min(value(f, a, period), value(g, a, period))))
        middle = (a + b) / 2
        is_f = value(f, middle, period) <= value(g, middle, period)
        if not best or best[-1][1] != is_f:
            best.append((a, is_f))
    return _plain(out), best


def approximated(f: Line, error: float, period: float = DAY_MS) -> Line:
    """Fewer points, everywhere within ``error`` of f: a point is left out as long as one straight line passes within the error of all that it skips."""
    closed = [*f, (f[0][0] + period, f[0][1])]
    out, at = [closed[0]], 0
    while at < len(closed) - 1:
        low, high, last = float("-inf"), float("inf"), at + 1
        for j in range(at + 1, len(closed)):
            (a, x), (b, y) = closed[at], closed[j]
            if low <= (y - x) / (b - a) <= high:
                last = j
            low, high = max(low, (y - error - x) / (b - a)), min(high, (y + error - x) / (b - a))
            if low > high:
                break
        out.append(closed[last])
        at = last
    return out[:-1] or [f[0]]


def _plain(f: Line) -> Line:
    """Without points on a straight line between their neighbours."""
    out: Line = []
    for p in f:
        while len(out) > 1 and abs((out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) - (p[1] - out[-2][1]) * (out[-1][0] - out[-2][0])) < 1e-6:
            out.pop()
        out.append(p)
    return out


def _lines(column: pd.Series) -> Iterator[Line]:
    return ([(float(p["dt"]), float(p["tt"])) for p in points] for points in column)


FLOATING = T.ArrayType(T.StructType([T.StructField("dt", T.DoubleType()), T.StructField("tt", T.DoubleType())]))


@F.pandas_udf(FLOATING)
def link(f: pd.Series, g: pd.Series) -> pd.Series:
    return pd.Series([[{"dt": t, "tt": x} for t, x in linked(a, b)] for a, b in zip(_lines(f), _lines(g), strict=True)])


@F.pandas_udf(FLOATING)
def merge(f: pd.Series, g: pd.Series) -> pd.Series:
    return pd.Series([[{"dt": t, "tt": x} for t, x in merged(a, b)[0]] for a, b in zip(_lines(f), _lines(g), strict=True)])


@F.pandas_udf(T.DoubleType())
def value_at(f: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([value(a, t) for a, t in zip(_lines(f), at, strict=True)])
