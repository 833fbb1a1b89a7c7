from viaduct.operators.splits import split_chains

EDGES = [(0, 1, 10), (5, 1, 11), (1, 2, 12), (1, 3, 13), (2, 4, 14), (2, 6, 15)]


def run(spark, chains):
    edges = spark.createDataFrame(EDGES, "from_node bigint, to_node bigint, weight bigint")
    rows = spark.createDataFrame(chains, "chain_id int, arcs array<bigint>, mandatory boolean")
    found, nodes = split_chains(edges, rows, 100)
    return sorted(map(tuple, found.collect())), sorted(map(tuple, nodes.collect()))


def test_prohibitive_chain(spark):
    edges, nodes = run(spark, [(0, [0, 1, 2, 4], False)])
    assert nodes == [(100, 1), (101, 2)]
    assert edges == sorted([(0, 100, 10), (5, 1, 11), (1, 2, 12), (1, 3, 13), (2, 4, 14), (2, 6, 15), (100, 101, 12), (100, 3, 13), (101, 6, 15)])


def test_mandatory_and_skipped_chains(spark):
    edges, nodes = run(spark, [(0, [5, 1, 3], True), (1, [0, 1], False), (2, [5, 1, 2], False)])
    assert nodes == [(100, 1)]  # the last chain's way is gone after the first
    assert (5, 100, 11) in edges and (100, 3, 13) in edges and not any(a == 100 and b == 2 for a, b, _ in edges)


def test_groups_of_chains_stay_on_the_executors(spark, monkeypatch):
    # 500 networks with two chains each, of which the second sees the first; their numbers alternate
    edges = spark.range(500).selectExpr("id * 10 AS o").selectExpr(*[f"array({', '.join(f'struct(o + {a} AS a, o + {b} AS b, {w} AS w)' for a, b, w in EDGES)}) AS e"]).selectExpr("inline(e)").selectExpr("a AS from_node", "b AS to_node", "bigint(w) AS weight")
    chains = spark.range(1000).selectExpr("id AS chain_id", "transform(if(id < 500, array(0, 1, 2, 4), array(5, 1, 2, 6)), x -> x + id % 500 * 10) AS arcs", "id >= 500 AS mandatory")
    monkeypatch.setattr(type(chains), "toLocalIterator", None)
    found, nodes = split_chains(edges, chains, 100_000)
    assert sorted(map(tuple, nodes.collect())) == [(100_000 + 2 * n + k, n % 500 * 10 + 1 + k) for n in range(1000) for k in (0, 1)]
    rows = set(map(tuple, found.collect()))
    assert len(rows) == found.count() == 500 * (6 + 3 + 3)
    for n in range(500):
        o, a, b = 10 * n, 100_000 + 2 * n, 101_000 + 2 * n
        assert {(o, a, 10), (o + 5, b, 11), (a, a + 1, 12), (a, o + 3, 13), (a + 1, o + 6, 15), (b, b + 1, 12), (b, o + 3, 13), (b + 1, o + 6, 15), (o + 1, o + 2, 12), (o + 1, o + 3, 13), (o + 2, o + 4, 14), (o + 2, o + 6, 15)} == {r for r in rows if r[0] in (*range(o, o + 10), a, a + 1, b, b + 1)}
