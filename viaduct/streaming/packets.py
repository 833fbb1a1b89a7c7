"""Camera packets to live weights: the same functions serve streams and batches.

The reference describes these steps without fixing late data; here a watermark of one minute drops what comes later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, LATE = "30 seconds", "1 minute"
WINDOW_MS, STALE_MS, DEAD_MS = 30_000, 300_000, 1_800_000
#: Smoothing constants: level, trend, and the Huber limit in units of the expected value.
ALPHA, BETA, HUBER = 0.3, 0.1, 0.5


def valid(packets: DataFrame) -> DataFrame:
    """Packets ``edge, ts, kmh, occupancy, confidence`` that keep the invariants."""
    ok = F.col("edge").isNotNull() & F.col("ts").isNotNull() & (F.col("kmh") > 0) & F.col("occupancy").between(0, 1) & F.col("confidence").between(0, 1)
    return packets.where(ok)


def windowed(packets: DataFrame, unit: int = 1, order: str | None = None) -> DataFrame:
    """Tumbling windows of 30 seconds an edge: ``edge, start, n, kmh, occupancy, variance``, means weighted by confidence, in ``unit`` parts.

    Sums are scaled before the division, so that halves of a part stay halves. Sums of doubles depend on their order: with a column
    ``order`` the rows of a window are added one by one in its order, however the table is split (batches only).
    """
    rows = packets.withWatermark("ts", LATE) if packets.isStreaming else packets
    if order:
        rows = rows.withColumn("window", F.window("ts", WINDOW)).repartition("window", "edge").sortWithinPartitions("window", "edge", order)
    w = F.sum("confidence")
    mean = lambda c: unit * F.sum(F.col(c) * F.col("confidence")) / w
    out = rows.groupBy("window" if order else F.window("ts", WINDOW), "edge").agg(F.count("*").alias("n"), mean("kmh").alias("kmh"), mean("occupancy").alias("occupancy"), F.coalesce(F.var_samp("kmh"), F.lit(0.0)).alias("variance"))
    return out.select("edge", F.col("window.start").alias("start"), "n", "kmh", "occupancy", "variance")


STATE = "level double, trend double, at bigint, n bigint"
SMOOTHED = "edge bigint, at bigint, level double, trend double, n bigint"


def step(level: float, trend: float, n: int, value: float, alpha: float = ALPHA, beta: float = BETA, huber: float = HUBER) -> tuple[float, float, int]:
    """One double-exponential step; the surprise is cut to ``huber`` times the expected value."""
    if n == 0:
        return value, 0.0, 1
    expected = level + trend
    limit = huber * max(abs(expected), 1e-9)
    surprise = min(max(value - expected, -limit), limit)
    fresh = expected + alpha * surprise
    return fresh, (1 - beta) * trend + beta * (fresh - level), n + 1


def smooth_batch(windows: DataFrame, value: str = "kmh") -> DataFrame:
    """All smoothed states of every edge in order of time: ``edge, at (ms), level, trend, n``."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        level = trend = 0.0
        n, out = 0, []
        for at, v in rows.sort_values("at")[["at", "v"]].itertuples(index=False):
            level, trend, n = step(level, trend, n, float(v))
            out.append((key[0], at, level, trend, n))
        return pd.DataFrame(out, columns=["edge", "at", "level", "trend", "n"])

    return windows.select("edge", F.unix_millis("start").alias("at"), F.col(value).alias("v")).groupBy("edge").applyInPandas(run, SMOOTHED)


def smooth_stream(windows: DataFrame, value: str = "kmh") -> DataFrame:
    """The latest state of every edge with new windows; state that gets nothing for 30 minutes is dropped."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, trend, at, n = state.get if state.exists else (0.0, 0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        for t, v in rows[["at", "v"]].itertuples(index=False):
            level, trend, n = step(level, trend, n, float(v))
            at = max(at, int(t))
        state.update((level, trend, at, n))
        state.setTimeoutDuration(DEAD_MS)
        yield pd.DataFrame({"edge": [key[0]], "at": [at], "level": [level], "trend": [trend], "n": [n]})

    rows = windows.select("edge", F.unix_millis("start").alias("at"), F.col(value).alias("v"))
    return rows.groupBy("edge").applyInPandasWithState(run, SMOOTHED, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def freshness(age_ms: Column) -> Column:
    """1 up to five minutes, then linearly down to 0 at thirty."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (age_ms - STALE_MS) / (DEAD_MS - STALE_MS)))


def confidence(age_ms: Column, n: Column, alignment: Column) -> Column:
    """Freshness times the share of ten observations times the alignment of both lanes."""
    return freshness(age_ms) * F.least(F.lit(1.0), n / 10) * alignment


def align(speed: DataFrame, occupancy: DataFrame, free_kmh: DataFrame) -> DataFrame:
    """``edge, kmh, occupancy, tier, alignment`` from ``edge, at, kmh`` and ``edge, at, occupancy``.

    Tier 1: less than a window apart, both count. Tier 2: up to five minutes apart, alignment falls linearly. Tier 3, or one
    lane only: the older value goes and is estimated from the other one and the free speed.
    """
    both = speed.withColumnRenamed("at", "s_at").join(occupancy.withColumnRenamed("at", "o_at"), "edge", "full").join(free_kmh, "edge")
    gap = F.abs(F.col("s_at") - F.col("o_at"))
    tier = F.when(gap < WINDOW_MS, 1).when(gap < STALE_MS, 2).otherwise(3).cast("bigint")
    use_speed = (F.col("tier") < 3) | F.col("o_at").isNull() | (F.col("s_at") >= F.col("o_at"))
    use_occupancy = (F.col("tier") < 3) | F.col("s_at").isNull() | (F.col("o_at") > F.col("s_at"))
    by_occupancy, by_speed = F.col("free") * (1 - F.col("occupancy")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("kmh") / F.col("free")))
    alignment = F.when(F.col("tier") == 2, 1 - (gap - WINDOW_MS) / (STALE_MS - WINDOW_MS)).otherwise(1.0)
    rows = both.withColumn("tier", F.coalesce(tier, F.lit(3).cast("bigint")))
    return rows.select("edge", F.when(use_speed, F.col("kmh")).otherwise(by_occupancy).alias("k"), F.when(use_occupancy, F.col("occupancy")).otherwise(by_speed).alias("o"), "tier", alignment.alias("alignment")).withColumnsRenamed({"k": "kmh", "o": "occupancy"})


def propagate(known: DataFrame, neighbours: DataFrame, hops: int = 3, decay: float = 0.5) -> DataFrame:
    """``edge, ratio, hops``: unknown edges take the weighted mean ratio of the nearest known ones, weight decay ** hops.

    ``known``: ``edge, ratio``; ``neighbours``: ``edge, other``. One join a hop; ``hops`` is small and fixed.
    """
    done = known.select("edge", "ratio", F.lit(0).cast("bigint").alias("hops"))
    for h in range(1, hops + 1):
        front = neighbours.join(done, "edge").select(F.col("other").alias("edge"), "ratio", "hops").join(done.select("edge"), "edge", "left_anti")
        w = F.pow(F.lit(decay), F.col("hops") + 1)
        done = done.union(front.groupBy("edge").agg((F.sum(F.col("ratio") * w) / F.sum(w)).alias("ratio")).select("edge", "ratio", F.lit(h).cast("bigint")))
    return done


def latest(metric: DataFrame) -> DataFrame:
    """``arc_id, weight`` of the newest upload of each arc."""
    return metric.groupBy("arc_id").agg(F.max_by("weight", F.struct("at", "weight")).alias("weight"))


def swap_metric(stream: DataFrame, path: str, checkpoint: str):
    """Every micro-batch replaces the current metric at ``path`` by its newest values; resetting is writing the baseline there."""

    def write(batch: DataFrame, _: int) -> None:
        latest(batch).write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def simulated_hours(spark, start_hour: float, acceleration: float, every: str = "30 seconds") -> DataFrame:
    """A rate stream with ``hour``, the simulated hour of the day at each tick."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    elapsed = F.unix_millis("timestamp") / 1000.0
    return ticks.select("timestamp", F.pmod(F.lit(start_hour) + elapsed * acceleration / 3600.0, F.lit(24.0)).alias("hour"))
