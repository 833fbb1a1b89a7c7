"""File formats and route operators against literal expectations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viaduct.operators import paths, quality, routes
from viaduct.sources import files

ARCS = [(0, 0, 2, 10), (1, 0, 1, 1), (2, 1, 3, 2), (3, 2, 1, 1), (4, 2, 3, 3), (5, 2, 4, 1), (6, 3, 0, 7), (7, 3, 4, 2)]


@pytest.fixture(scope="module")
def arcs(spark):
    return spark.createDataFrame(ARCS, "arc_id bigint, tail bigint, head bigint, weight bigint")


@pytest.mark.parametrize("cell", [2, 512])
def test_toy_graph(spark, arcs, cell):
    sources = spark.createDataFrame([(0,), (3,), (4,)], "source bigint")
    d = {(r.source, r.node): r.dist for r in paths.distances(arcs, sources, cell).collect()}
    assert (d[0, 1], d[0, 3], d[3, 0], d[0, 4], (4, 0) in d) == (1, 3, 7, 5, False)


def test_strong_components(spark, arcs):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node_id bigint")
    root = {r.node: r.root for r in paths.strong_components(arcs, nodes).collect()}
    assert root[0] == root[1] == root[2] == root[3] and len({root[0], root[4], root[5]}) == 3


def test_paths_and_alternatives(spark, arcs):
    dist = paths.distances(arcs, spark.createDataFrame([(0,)], "source bigint"))
    tree = paths.parents(dist, arcs)
    rows = paths.unpack(dist.where("node = 4"), tree).orderBy(F.desc("hops_to_target")).collect()
    assert [r.node for r in rows] == [0, 1, 3, 4]


LINKS = [(1, 0, 1, 10000.0, 80.0), (1, 1, 2, 30000.0, 80.0), (1, 2, 3, 10000.0, 80.0)]
LIMITS = [(1, 0, 1, 10000.0, 100.0), (1, 1, 2, 10000.0, 50.0), (1, 2, 3, 10000.0, 100.0)]


@pytest.mark.parametrize(
    ("links", "traces", "want"),
    [
        ([(1, 0, 1, 10000.0, 50.0)], [(100000, 1, 0.1), (101000, 1, 0.9)], [(1, 99875, 0.8 * 1.0, 28.8)]),
        (LINKS[:2], [(100000, 1, 0.5), (101000, 2, 0.5)], [(1, 99750, 0.125, 72), (2, 100250, 0.375, 72)]),
        (LINKS, [(100000, 1, 0.5), (102000, 3, 0.5)], [(1, 99750, 0.0625, 72), (2, 100250, 0.75, 72), (3, 101750, 0.0625, 72)]),
        (LINKS, [(100000, 1, 0.5), (100250, 1, 1.0), (102000, 3, 0.5)], [(1, 99750, 0.5, 72), (2, 100250, 30000 / 35000, 72), (3, 101750, 0.5 * 5000 / 35000, 72)]),
        (LIMITS, [(100000, 1, 0.0), (101000, 3, 1.0)], [(1, 100000, 1 / 3, 144), (2, 100250, 1 / 3, 72), (3, 100750, 1 / 3, 144)]),
        (LINKS, [], []),
    ],
)
def test_link_speeds(spark, links, traces, want):
    a = spark.createDataFrame(links, "trip int, seq int, link_id bigint, length double, limit double")
    b = spark.createDataFrame([(1, i, *t) for i, t in enumerate(traces)], "trip int, seq int, ts bigint, link_id bigint, fraction double")
    got = [(r.link_id, r.entered, pytest.approx(r.quality), pytest.approx(r.velocity)) for r in routes.link_speeds(a, b).orderBy("link_id").collect()]
    assert want == got


def test_bits_and_windows_round_trip():
    for n in (0, 1, 511, 512, 700):
        bits = np.random.default_rng(n).random(n) < 0.3
        assert files.decode_bits(files.encode_bits(bits)).tolist() == bits.tolist()
    windows = [{"day_mask": 31, "start_min": 420, "end_min": 540}, {"day_mask": 96, "start_min": 0, "end_min": 0}]
    packed = files.pack_windows(windows)
    assert len(packed) == 10 and files.unpack_windows(packed) == windows


def test_vectors_reject_odd_sizes(spark):
    rows = spark.createDataFrame([("a", bytearray(b"12345"))], "path string, content binary")
    with pytest.raises(Exception, match="no whole number"):
        files.decode_vectors(rows, "u32").collect()


def test_strings_and_arrow(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"ab\0\0c\0"),)], "content binary")
    assert rows.select(files.strings(F.col("content")).alias("s")).first().s == ["ab", "", "c"]
    table = pa.table({"arc_id": pa.array([0, 1], pa.int64()), "name": ["x", "y"], "bearing": pa.array([1.5, 2.5], pa.float32())})
    (tmp_path / "m.arrow").write_bytes(files.arrow_payload(table))
    assert [tuple(r) for r in files.read_arrow(spark, str(tmp_path / "m.arrow"), ["arc_id", "name"]).collect()] == [(0, "x"), (1, "y")]


def test_polyline(spark):
    rows = spark.createDataFrame([([38.5, 40.7, 43.252], [-120.2, -120.95, -126.453])], "a array<double>, b array<double>")
    assert rows.select(files.polyline("a", "b").alias("p")).first().p == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


YAML = """
profiles:
  city: {free_flow_kmh: 40, free_flow_occupancy: 0.1, peaks: [{hour: 8, speed_kmh: 15, occupancy: 0.6}]}
cameras:
  - {id: 1, label: a, profile: city, arc_id: 7}
  - {id: 2, label: b, profile: city, lat: 21.0, lon: 105.8, flow_bearing_deg: 90}
"""


def test_camera_yaml(spark):
    profiles, cameras = files.read_cameras(spark, YAML)
    again = files.read_cameras(spark, files.write_cameras(profiles, cameras))
    assert again[0].collect() == profiles.collect() and again[1].collect() == cameras.collect()
    with pytest.raises(ValueError, match="duplicate key"):
        files.read_cameras(spark, YAML + "cameras: []\n")
    bad = YAML + "  - {id: 3, profile: city, arc_id: 1, lat: 1, lon: 1, flow_bearing_deg: 1}\n"
    with pytest.raises(ValueError, match="camera 3"):
        files.read_cameras(spark, bad)
    assert files.read_cameras(spark, bad, strict=False)[1].count() == 2


def test_weights_are_posted_in_order(spark):
    metric = spark.createDataFrame([(2, 30), (0, 10), (1, 2147483647)], "arc_id bigint, weight bigint")
    seen = []
    assert files.post_weights(metric, "", lambda body: seen.append(body) or 200) == 12
    assert np.frombuffer(seen[0], "<u4").tolist() == [10, 2147483647, 30]
    with pytest.raises(OSError, match="answered 500"):
        files.post_weights(metric, "x", lambda body: 500)


def test_window_checks(spark):
    rows = spark.createDataFrame([(1, 2, [(31, 420, 540), (1, 500, 600)]), (1, 3, [(0, 0, 1500)])], "from_arc bigint, to_arc bigint, windows array<struct<day_mask:int,start_min:int,end_min:int>>")
    assert {r.check: r.offenders for r in quality.check_windows(rows).collect()} == {"day bits": 1, "minutes": 1, "no overlaps": 1}


def test_geojson_without_points(spark):
    row = spark.range(1).select(files.route_geojson(F.array().cast("array<struct<lat:double,lng:double>>"), F.lit(1), F.lit(2.0)).alias("g")).first()
    assert '"geometry":null' in row.g
