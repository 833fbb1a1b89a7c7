"""Joins that no single key can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with a thousandth of all rows or more, so there are at most a thousand hot keys at any scale.
HOT_SHARE = 1000


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, unique by ``keys`` and with each key's number of rows in ``n_col``.

    Hot keys, at most ``HOT_SHARE`` of them, are broadcast and their rows stay where they are; the others are shuffled.
    """
    is_hot = F.col(n_col) * HOT_SHARE >= max(total, 1)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    left = rows.join(F.broadcast(hot), keys)
    return left.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def salted_join(rows: DataFrame, groups: DataFrame, key: str, total: int, least: int = 256) -> DataFrame:
    """Inner join of ``rows``, ``total`` in number, with ``groups``, unique by ``key`` and too wide to be broadcast.

    A hot key's rows are dealt to salts, each of a thousandth of all rows or ``least`` rows, and its group goes to each of them. Only hot keys, at
    most ``HOT_SHARE``, and their numbers of salts are broadcast.
    """
    size = max(total / HOT_SHARE, least)
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * size).select(key, F.ceil(F.col("n") / size).cast("int").alias("salts"))
    parts = F.coalesce("salts", F.lit(1))
    left = rows.withColumn("salt_row", F.xxhash64(*rows.columns)).join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod("salt_row", parts).cast("int")).drop("salt_row", "salts")
    right = groups.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")
