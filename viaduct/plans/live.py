"""Queries over packets, windows, smoothing and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.plans.registry import query
from viaduct.sources import grid
from viaduct.streaming import packets

RAW = "p AS (SELECT user_id % 40 AS edge, ts, value AS kmh, CAST(json_extract_string(props, '$.k') AS BIGINT) % 100 / 100.0::DOUBLE AS occupancy, (event_id % 4 + 1) / 4.0::DOUBLE AS confidence FROM events), v AS (SELECT * FROM p WHERE kmh > 0 AND occupancy BETWEEN 0 AND 1 AND edge IS NOT NULL AND ts IS NOT NULL)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return grid.read(spark, sf_dir, "events").select("event_id", F.expr("user_id % 40").alias("edge"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("kmh"), (k % 100 / 100.0).alias("occupancy"), F.expr("(event_id % 4 + 1) / 4.0D").alias("confidence"))


@query("z01_packet_filter", f"WITH {RAW} SELECT edge, count(*) AS packets FROM v GROUP BY edge")
def packet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.valid(raw(spark, sf_dir)).groupBy("edge").agg(F.count("*").alias("packets"))


@query("z02_a30_windows", f"WITH {RAW} SELECT edge, epoch_us(ts) // 30000000 * 30000 AS start_ms, count(*) AS n, CAST(round(1000 * sum(kmh * confidence) / sum(confidence)) AS BIGINT) AS kmh, CAST(round(1000 * sum(occupancy * confidence) / sum(confidence)) AS BIGINT) AS occupancy FROM v GROUP BY 1, 2")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets.windowed(packets.valid(raw(spark, sf_dir)), unit=1000, order="event_id")
    return rows.select("edge", F.unix_millis("start").alias("start_ms"), "n", F.round("kmh").cast("bigint").alias("kmh"), F.round("occupancy").cast("bigint").alias("occupancy"))


@query("z03_smoothing")
def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.smooth_batch(packets.windowed(packets.valid(raw(spark, sf_dir))))


@query("z04_z05_confidence", f"WITH {RAW}, l AS (SELECT edge, max(epoch_ms(ts)) AS seen, count(*) AS n FROM v GROUP BY edge), m AS (SELECT max(seen) + 400000 AS t0 FROM l) SELECT edge, CAST(round(1000 * greatest(0.0, least(1.0, 1 - (t0 - seen - 300000) / 1500000.0::DOUBLE))) AS BIGINT) AS fresh, CAST(round(1000 * greatest(0.0, least(1.0, 1 - (t0 - seen - 300000) / 1500000.0::DOUBLE)) * least(1.0, n / 10) * 0.5) AS BIGINT) AS blended FROM l, m")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = packets.valid(raw(spark, sf_dir)).groupBy("edge").agg(F.max(F.unix_millis("ts")).alias("at"), F.count("*").alias("n"))
    now = last.agg((F.max("at") + 400_000).alias("now"))
    age = F.col("now") - F.col("at")
    micro = lambda x: F.round(1000 * x).cast("bigint")
    return last.join(F.broadcast(now)).select("edge", micro(packets.freshness(age)).alias("fresh"), micro(packets.confidence(age, F.col("n"), F.lit(0.5))).alias("blended"))  # now is one row


LANES = """s AS (SELECT edge, max(epoch_ms(ts)) AS s_at, arg_max(kmh, epoch_ms(ts) * 1000 + CAST(kmh AS BIGINT) % 1000) AS kmh FROM v WHERE edge % 5 <> 0 GROUP BY edge), o AS (SELECT edge, max(epoch_ms(ts)) - (edge % 7) * 60000 AS o_at, min(occupancy) AS occupancy FROM v WHERE edge % 6 <> 1 GROUP BY edge)"""


@query("z06_j32_alignment", f"WITH {RAW}, {LANES}, b AS (SELECT *, 50.0::DOUBLE + edge AS free, CASE WHEN abs(s_at - o_at) < 30000 THEN 1 WHEN abs(s_at - o_at) < 300000 THEN 2 ELSE 3 END AS tier FROM s FULL JOIN o USING (edge)) SELECT edge, CAST(tier AS BIGINT) AS tier, CAST(round(1000 * CASE WHEN tier < 3 OR o_at IS NULL OR s_at >= o_at THEN kmh ELSE free * (1 - occupancy) END) AS BIGINT) AS kmh, CAST(round(1000 * CASE WHEN tier < 3 OR s_at IS NULL OR o_at > s_at THEN occupancy ELSE greatest(0.0, least(1.0, 1 - kmh / free)) END) AS BIGINT) AS occupancy, CAST(round(1000 * CASE WHEN tier = 2 THEN 1 - (abs(s_at - o_at) - 30000) / 270000.0::DOUBLE ELSE 1 END) AS BIGINT) AS alignment FROM b")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets.valid(raw(spark, sf_dir)).withColumn("ms", F.unix_millis("ts"))
    speed = rows.where("edge % 5 <> 0").groupBy("edge").agg(F.max("ms").alias("at"), F.max_by("kmh", F.expr("ms * 1000 + CAST(kmh AS BIGINT) % 1000")).alias("kmh"))
    occupancy = rows.where("edge % 6 <> 1").groupBy("edge").agg((F.max("ms") - F.col("edge") % 7 * 60_000).alias("at"), F.min("occupancy").alias("occupancy"))
    free = rows.select("edge").distinct().withColumn("free", 50.0 + F.col("edge"))
    milli = lambda c: F.round(1000 * F.col(c)).cast("bigint").alias(c)
    return packets.align(speed, occupancy, free).select("edge", "tier", milli("kmh"), milli("occupancy"), milli("alignment"))


@query("z07_propagation", f"{grid.WITH}, k AS (SELECT node_id AS edge, 1 + (node_id % 5) / 4.0::DOUBLE AS ratio FROM nodes WHERE node_id % 23 = 0), h1 AS (SELECT a.head AS edge, avg(ratio) AS ratio FROM arcs a JOIN k ON k.edge = a.tail WHERE a.head NOT IN (SELECT edge FROM k) GROUP BY a.head), d1 AS (SELECT edge, ratio, 0 AS hops FROM k UNION ALL SELECT edge, ratio, 1 FROM h1), h2 AS (SELECT a.head AS edge, sum(ratio * pow(0.5, hops + 1)) / sum(pow(0.5, hops + 1)) AS ratio FROM arcs a JOIN d1 ON d1.edge = a.tail WHERE a.head NOT IN (SELECT edge FROM d1) GROUP BY a.head) SELECT edge, CAST(round(1000000 * ratio) AS BIGINT) AS ratio, CAST(hops AS BIGINT) AS hops FROM (SELECT * FROM d1 UNION ALL SELECT edge, ratio, 2 FROM h2)")
def propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = grid.nodes(spark, sf_dir).where("node_id % 23 = 0").select(F.col("node_id").alias("edge"), F.expr("1 + (node_id % 5) / 4.0D").alias("ratio"))
    around = grid.arcs(spark, sf_dir).select(F.col("tail").alias("edge"), F.col("head").alias("other"))
    return packets.propagate(known, around, hops=2).select("edge", F.round(1_000_000 * F.col("ratio")).cast("bigint").alias("ratio"), "hops")


@query("z08_z09_latest_metric", "SELECT l_partkey AS arc_id, arg_max(CAST(l_quantity AS BIGINT), epoch_ms(l_shipdate) * 1000 + CAST(l_quantity AS BIGINT)) AS weight FROM lineitem GROUP BY l_partkey")
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("arc_id"), F.col("l_quantity").cast("bigint").alias("weight"), F.col("l_shipdate").alias("at"))
    return packets.latest(rows)
