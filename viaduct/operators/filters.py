"""Filters and validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions import geo
from viaduct.functions.traffic import CLOSED


def rejection(lat: Column, lng: Column, box: dict[str, Column], padding_m: float = 1500.0) -> Column:
    """Why a coordinate is rejected, null if it is not: not finite, then out of range, then outside the padded box."""
    odd = F.isnan(lat) | F.isnan(lng) | lat.isNull() | lng.isNull() | (F.abs(lat) == float("inf")) | (F.abs(lng) == float("inf"))
    return F.when(odd, "non_finite").when((F.abs(lat) > 90) | (F.abs(lng) > 180), "invalid_range").when(~geo.in_padded_box(lat, lng, box, padding_m), "out_of_bounds")


def in_viewport(arcs: DataFrame, min_lat: float, max_lat: float, min_lng: float, max_lng: float) -> DataFrame:
    """Arcs whose bounding box meets the viewport."""
    if min_lat > max_lat or min_lng > max_lng:
        raise ValueError("a viewport's minima must not exceed its maxima")
    high, low = (lambda c: F.greatest(f"tail_{c}", f"head_{c}")), (lambda c: F.least(f"tail_{c}", f"head_{c}"))
    return arcs.where((high("lat") >= min_lat) & (low("lat") <= max_lat) & (high("lng") >= min_lng) & (low("lng") <= max_lng))


def metric_report(metric: DataFrame) -> DataFrame:
    """Weights above infinity: their first arc, and how many arcs are usable."""
    bad = F.col("weight") > CLOSED
    return metric.agg(F.count("*").alias("arcs"), F.min(F.when(bad, F.col("arc_id"))).alias("first_offender"), F.count_if(F.col("weight") < CLOSED).alias("usable"))
