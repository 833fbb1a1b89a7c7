"""Travel-time functions, binary maps, restrictions, routes and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from viaduct.functions import ttf
from viaduct.operators import answers, hierarchy, paths, restrictions
from viaduct.sources import pbf

DAY = ttf.DAY_MS


def driven(speeds, length, t):
    """Milliseconds for a length, driven in steps of one speed each."""
    left, at = length * 3600.0, float(t)
    while left > 1e-9:
        inside = at % DAY
        v = max((s for s in speeds if s[0] <= inside), key=lambda s: s[0])[1]
        end = min([s[0] for s in speeds if s[0] > inside], default=DAY) - inside
        step = min(left / v, end)
        left -= v * step
        at += step
    return at - t


@pytest.mark.parametrize("seed", range(6))
def test_speed_profiles(seed):
    r = random.Random(seed)
    times = [0, *sorted(r.sample(range(1000, DAY, 1000), 9))]
    speeds, length = [(t, r.randrange(5, 120)) for t in times], r.choice([50, 900, 20_000, 150_000])
    points = ttf.day_profile(speeds, length)
    line = [(float(t), float(x)) for t, x in points]
    assert points[0][0] == 0 and all(a[0] < b[0] and b[0] + b[1] - a[0] - a[1] >= -2 for a, b in zip(points, points[1:], strict=False))
    for t in [r.randrange(DAY) for _ in range(200)]:
        assert abs(ttf.value(line, t) - driven(speeds, length, t)) < 2.5


@pytest.mark.parametrize("seed", range(8))
def test_link_merge_and_approximation(seed):
    r = random.Random(seed)

    def function():
        times = [0, *sorted(r.sample(range(1, DAY // 60_000), 6))]
        return [(t * 60_000.0, float(r.randrange(1000, 40_000))) for t in times]

    f, g = function(), function()
    both, (least, best), near = ttf.linked(f, g), ttf.merged(f, g), ttf.approximated(f, 3000.0)
    for t in [r.uniform(0, DAY) for _ in range(300)] + [0.0, DAY - 1.0]:
        x = ttf.value(f, t)
        assert abs(ttf.value(both, t) - x - ttf.value(g, t + x)) < 1e-3
        assert abs(ttf.value(least, t) - min(x, ttf.value(g, t))) < 1e-3
        is_f = [b for a, b in best if a <= t][-1]
        assert (x if is_f else ttf.value(g, t)) <= min(x, ttf.value(g, t)) + 1e-3
        assert abs(ttf.value(near, t) - x) <= 3000.0 + 1e-6
    assert len(near) <= len(f)


def test_map_blobs_round_trip():
    rows = [{"kind": "node", "id": 1 << 40, "lat": -12.3456789, "lng": 179.9999999, "tags": {"name": "Ünï", "k": "v"}}, {"kind": "node", "id": 5, "lat": 0.0, "lng": -0.5, "tags": {}}]
    rows += [{"kind": "way", "id": 7, "refs": [9, 3, 1 << 40], "tags": {"highway": "path"}}, {"kind": "way", "id": 8, "refs": [], "tags": {}}]
    rows += [{"kind": "relation", "id": 2, "members": [{"type": "way", "id": 7, "role": "from"}, {"type": "relation", "id": 2, "role": ""}], "tags": {"type": "x"}}]
    found = [x for kind, blob in pbf.blobs(pbf.encode(rows) + pbf.encode(rows[:1], header=False)) if kind == "OSMData" for x in pbf.objects(pbf.unpacked(blob))]
    assert len(found) == 6
    for row, (kind, i, lat, lng, refs, members, tags) in zip([*rows, rows[0]], found, strict=True):
        assert (kind, i, tags) == (row["kind"], row["id"], row["tags"])
        assert kind != "node" or (round(lat, 7), round(lng, 7)) == (row["lat"], row["lng"])
        assert refs == row.get("refs") and members == row.get("members")
    with pytest.raises(ValueError, match="compression"):
        pbf.unpacked(b"\x22\x01x")


def test_conditional_scan_rules(spark):
    m = lambda *x: [{"type": t, "id": i, "role": r} for t, i, r in x]
    way, via = m(("way", 1, "from"), ("way", 2, "to")), m(("node", 9, "via"))
    chain = m(("way", 5, "via"), ("way", 6, "via"))
    rows = [
        (1, {"type": "restriction", "restriction:conditional": "no_left_turn @ (Mo 07:00-09:00)"}, way + via),
        (2, {"type": "restriction", "restriction": "no_u_turn"}, way + via),  # plain, with a node: not here
        (3, {"type": "restriction", "restriction": "no_u_turn"}, way + chain),
        (4, {"type": "restriction", "restriction": "only_straight_on"}, way + m(("way", 3, "to")) + chain),  # mandatory with two exits
        (5, {"type": "restriction", "restriction": "no_u_turn"}, way + m(("way", 3, "to")) + chain),
        (6, {"type": "restriction", "restriction": "no_u_turn"}, way + via + chain),
        (7, {"type": "multipolygon", "restriction": "no_u_turn"}, way + chain),
        (8, {"type": "restriction", "restriction:conditional": "nonsense @ (x)", "restriction": "no_u_turn"}, way + chain),
        (9, {"type": "restriction", "restriction": "no_u_turn"}, way + m(("relation", 4, "via"))),
        (10, {"type": "restriction", "restriction:motorcycle": "no_left_turn", "restriction": "no_u_turn"}, way + chain),
    ]
    rel = spark.createDataFrame(rows, "id bigint, tags map<string,string>, members array<struct<type:string,id:bigint,role:string>>")
    car = {(r.relation_id, r.to_way, r.direction, r.condition, r.via_node, tuple(r.via_ways)) for r in restrictions.scan(rel).collect()}
    assert car == {(1, 2, "left_turn", "Mo 07:00-09:00", 9, ()), (3, 2, "u_turn", "", None, (5, 6)), (5, 2, "u_turn", "", None, (5, 6)), (5, 3, "u_turn", "", None, (5, 6)), (10, 2, "u_turn", "", None, (5, 6))}
    assert {r.direction for r in restrictions.scan(rel, restrictions.MOTORCYCLE_TAGS).where("relation_id = 10").collect()} == {"left_turn"}


ARCS = [(0, 0, 2, 10), (1, 0, 1, 1), (2, 1, 3, 2), (3, 2, 1, 1), (4, 2, 3, 3), (5, 2, 4, 1), (6, 3, 0, 7), (7, 3, 4, 2)]


def test_penalty_routes(spark):
    arcs = spark.createDataFrame(ARCS, "arc_id bigint, tail bigint, head bigint, weight bigint")
    queries = spark.createDataFrame([(1, 0, 4), (2, 2, 4)], "query_id bigint, source bigint, target bigint")
    found = {}
    for r in answers.penalty_routes(arcs, queries, 3, 200).collect():
        found.setdefault((r.query_id, r.round), set()).add(r.arc_id)
    assert found[1, 0] == {1, 2, 7} and found[1, 1] == {0, 5} and found[2, 0] == {5} and found[2, 1] == {5}


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_against_reach(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(60)}
    reach = {v: {v} for v in range(40)}
    for _ in range(40):
        for a, b in pairs:
            reach[a] |= reach[b]
    nodes = spark.range(40).select(F.col("id").alias("node_id"))
    root = {x.node: x.root for x in paths.strong_components(spark.createDataFrame(sorted(pairs), "tail bigint, head bigint"), nodes).collect()}
    assert all((root[a] == root[b]) == (b in reach[a] and a in reach[b]) for a in range(40) for b in range(40))


@pytest.mark.parametrize("dense", [0, 2000])
def test_sweeps_against_rounds_of_cells(spark, monkeypatch, dense):
    # a long strip beside a round line, whose nodes were a border of every piece; arcs that cross lines, and one without a way back
    monkeypatch.setattr(hierarchy, "DENSE", dense)
    monkeypatch.setattr(hierarchy, "TOGETHER", 2)
    r = random.Random(1)
    at = {n: (n // 5, 1022 + n % 5) for n in range(200)}
    nodes = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in at.items()], "node_id long, lat double, lng double")
    pairs = {(a, a + s) for a in at for s in (-5, -1, 1, 5) if a + s in at and r.random() < 0.8} | {(3, 150), (40, 11), (199, 0)}
    arcs = spark.createDataFrame([(a, b, r.randrange(1, 50)) for a, b in sorted(pairs)], "tail long, head long, weight long")
    ranks = hierarchy.order(nodes, 1.0)
    assert ranks.agg(F.max(F.when(F.col("x") % 8 != 0, F.col("level")))).first()[0] <= 2
    found, sources = hierarchy.rounds(arcs, ranks, 3), spark.createDataFrame([(n,) for n in (0, 7, 100, 199, 500)], "source long")
    wanted = {(x.source, x.node): x.dist for x in paths.distances(arcs, sources).collect()}
    assert {(x.source, x.node): x.dist for x in hierarchy.sweep(found, sources).collect()} == wanted
    flipped = {(x.source, x.node): x.dist for x in paths.distances(arcs.select(F.col("head").alias("tail"), F.col("tail").alias("head"), "weight"), sources).collect()}
    targets = spark.createDataFrame([(3,), (50,), (198,), (500,)], "node long")
    swept = {(x.source, x.node): x.dist for x in hierarchy.sweep(found, sources, targets, back=True).collect()}
    assert swept == {k: v for k, v in flipped.items() if k[1] in (3, 50, 198, 500)}


@pytest.mark.parametrize("limit, borders", [(0, 0), (0, 4096), (20, 4096), (10_000, 4096)])
def test_strong_components_of_cells(spark, monkeypatch, limit, borders):
    # cycles through many cells, on a strip and by a few long arcs; forward and backward reach, levels of cells, or one task
    monkeypatch.setattr(paths, "SETTLED", limit)
    monkeypatch.setattr(paths, "BORDERS", borders)
    reached = []
    plain = paths.distances
    monkeypatch.setattr(paths, "distances", lambda *x: reached.append(1) or plain(*x))
    r = random.Random(limit)
    pairs = {(v, v + 1) for v in range(399) if v % 90} | {(v, v - 1) for v in range(1, 400) if r.random() < 0.6} | {(350, 290), (170, 100), (399, 380), (20, 390)}
    arcs = spark.createDataFrame(sorted(pairs), "tail long, head long")
    root = {x.node: x.root for x in paths.strong_components(arcs, spark.range(401).select(F.col("id").alias("node_id")), 10).collect()}
    after = {v: [h for t, h in pairs if t == v] for v in range(401)}
    ahead = {}
    for v in range(401):
        ahead[v], todo = {v}, [v]
        while todo:
            todo += [h for h in after[todo.pop()] if h not in ahead[v] and not ahead[v].add(h)]
    assert len(root) == 401 and bool(reached) == (borders == 0)
    assert all((root[a] == root[b]) == (b in ahead[a] and a in ahead[b]) for a in range(401) for b in range(401))
