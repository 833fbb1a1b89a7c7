"""Benchmark statistics, comparisons and name search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.functions.traffic import nearest_rank


def run_stats(samples: DataFrame) -> DataFrame:
    """``name, n, least, most, p50, p99`` of ``name, us``; percentiles are values by rounded rank."""
    rows = samples.groupBy("name").agg(F.count("*").alias("n"), F.min("us").alias("least"), F.max("us").alias("most"), F.collect_list("us").alias("all"))
    return rows.select("name", "n", "least", "most", nearest_rank(F.col("all"), 0.5).alias("p50"), nearest_rank(F.col("all"), 0.99).alias("p99"))


def compare_runs(before: DataFrame, now: DataFrame, percent: int = 10) -> DataFrame:
    """``before`` with the later run's median and whether it is more than ``percent`` slower."""
    rows = before.join(now.select("name", F.col("p50").alias("p50_now")), "name")
    return rows.withColumn("slower", F.col("p50_now") * 100 > F.col("p50") * (100 + percent))


def search_names(names: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """``name, n, first_id``: names that contain the needle, those that begin with it first, then by frequency."""
    low = F.lower("name")
    found = names.where(F.contains(low, F.lit(needle.lower()))).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return found.orderBy(F.desc(F.startswith(low, F.lit(needle.lower()))), F.desc("n"), "name").limit(limit)
