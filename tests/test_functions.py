from pyspark.sql import functions as F

from viaduct.functions import geo, osm, traffic
from viaduct.operators import timed, turns
from viaduct.streaming import packets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_turn_bands(spark):
    for angle, cross, want in ((10, 1, "straight"), (30, 1, "slight_left"), (-100, -1, "right"), (-120, -1, "sharp_right"), (160, 1, "u_turn"), (-160, -1, "sharp_right")):
        assert one(spark, geo.turn_class(F.lit(float(angle)), F.lit(float(cross)))) == want


def test_traffic_bands(spark):
    for base, now, want in ((100, 115, "green"), (100, 116, "yellow"), (100, 161, "red"), (0, 5, "green"), (100, 2147483647, "red")):
        assert one(spark, traffic.traffic_class(F.lit(base), F.lit(now))) == want


def test_windows_of_conditions():
    assert osm.parse_windows("Mo-Fr 07:00-09:00") == [(31, 420, 540)]
    assert osm.parse_windows("Sa,Su 10:00-14:00") == [(96, 600, 840)]
    assert osm.parse_windows("06:00-22:00") == [(127, 360, 1320)]
    assert osm.parse_windows("Mo-Fr 07:00-09:00,16:00-18:00") == [(31, 420, 540), (31, 960, 1080)]
    assert osm.parse_windows("Mo-Su 22:00-05:00") == [(127, 1320, 300)]
    assert osm.parse_windows("Fr-Mo 01:00-02:00") == [(113, 60, 120)]
    assert osm.parse_windows("sunset") is None


def test_window_ends_are_open_and_wrap(spark):
    w = F.array(F.struct(F.lit(1).alias("day_mask"), F.lit(1320).alias("start_min"), F.lit(300).alias("end_min")))
    for day, minute, want in ((0, 1320, True), (0, 299, True), (0, 300, False), (1, 1320, False)):
        assert one(spark, osm.window_active(w, F.lit(day), F.lit(minute))) is want


def test_speeds(spark):
    for text, want in (("50", 50), ("30 mph", 48), ("0", 1), ("signals", None), ("20;40", 20), ("RU:urban", 40), ("10 knots", 18), ("unposted", None)):
        assert one(spark, osm.speed_tag(F.lit(text))) == want


def test_live_time_falls_to_the_prediction(spark):
    at = lambda t: one(spark, timed.live_time(F.lit(100), F.lit(300), F.lit(1000), F.lit(t)))
    assert [at(999), at(1000), at(1100), at(1300)] == [300, 300, 200, 100]


def test_compound_turns_merge_greedily(spark):
    data = [(1, p, "right", -50.0, 20.0 * p, 3, False, 20.0) for p in range(3)] + [(2, 0, "left", 90.0, 0.0, 3, False, 30.0), (2, 1, "left", 80.0, 30.0, 3, False, 9.0)]
    rows = spark.createDataFrame(data, "route_id int, pos int, direction string, angle double, at_m double, degree int, roundabout boolean, to_next_m double")
    got = [(r.route_id, r.direction, r.angle) for r in turns.collapse_compounds(rows).orderBy("route_id", "pos").collect()]
    assert got == [(1, "right", -100.0), (1, "right", -50.0), (2, "u_turn", 170.0)]


def test_smoothing_cuts_outliers():
    level, trend, n = packets.step(50.0, 0.0, 5, 500.0)
    assert (level, n) == (50.0 + 0.3 * 25.0, 6)
    assert packets.step(0.0, 0.0, 0, 42.0) == (42.0, 0.0, 1)


def test_packet_stream(spark, tmp_path):
    import datetime

    base = datetime.datetime(2024, 1, 1)
    rows = [(i % 2, base + datetime.timedelta(seconds=10 * i), 30.0 + i, 0.2, 1.0) for i in range(20)]
    schema = "edge bigint, ts timestamp, kmh double, occupancy double, confidence double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = packets.windowed(packets.valid(stream)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = packets.windowed(packets.valid(spark.createDataFrame(rows, schema)))
    assert sorted(spark.table("w").collect()) == sorted(batch.collect())
