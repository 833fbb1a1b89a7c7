"""Shortest paths, components and what is built on them, in rounds over cells of the network."""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.session import Tables, materialize, small_batches

#: Ids of a cell, and into how many blocks the sources are dealt at most.
CELL_NODES, BLOCKS = 1 << 16, 16
#: From so many cells on, a round reads the whole table of cells.
MOST_LISTED = 1000
FAR = 1 << 62


def _rounds(cells: DataFrame, seeds: DataFrame, cell_nodes: int, after, name: str) -> DataFrame:
    """``source, node, value``: the least values from ``seeds``, in rounds over cells of ids.

    ``cells`` has a row a cell: ``cell, tails, heads`` and what else ``after(row)`` needs to return, for each tail, its heads and how
    a value changes on the way. The table is written once; a round reads the rows of those cells only that got better
    values from outside, settles them by Dijkstra's algorithm for one block of sources a task, and keeps only what leaves them. The
    rounds follow the cells on a path, not its arcs, and their tables hold the places where paths enter cells; the nodes
    inside are written once, at the end, when every cell is settled from all its entries. Tables of earlier rounds are dropped.
    Only the numbers of the cells that a round reads come to the driver. No join may broadcast: a cell takes far more memory than its file.
    """
    kept, tables = Tables(seeds.sparkSession), Tables(seeds.sparkSession)
    cells = kept.write(cells, f"{name}-cells")

    def settle(inside: bool):
        def run(frames):
            for frame in frames:
                for row in frame.itertuples(index=False):
                    steps = after(row) if row.tails is not None else {}
                    begin = defaultdict(list)
                    for source, node, value in zip(row.sources.tolist(), row.nodes.tolist(), row.values.tolist(), strict=True):
                        begin[source].append((value, node))
                    parts = []
                    for source, heap in begin.items():
                        best: dict[int, int] = {}
                        out: dict[int, int] = {}
                        heapq.heapify(heap)
                        while heap:
                            d, v = heapq.heappop(heap)
                            if d >= best.get(v, FAR):
                                continue
                            best[v] = d
                            for h, change in steps.get(v, ()):
                                e = change(d) if callable(change) else d + change
                                if h // cell_nodes != row.cell:
                                    if e < out.get(h, FAR):
                                        out[h] = e
                                elif e < best.get(h, FAR):
                                    heapq.heappush(heap, (e, h))
                        found = best if inside else out
                        parts.append((np.full(len(found), source), np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
                    yield pd.DataFrame(dict(zip(("source", "node", "value"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

        return run

    few = seeds.select("source").distinct().limit(BLOCKS).count()
    cell, block = F.expr(f"node div {cell_nodes}").alias("cell"), F.pmod(F.xxhash64("source"), F.lit(few)).alias("block")
    part = lambda c: F.transform("s", lambda x: x[c])

    def settled(entries: DataFrame, listed: list[int] | None, inside: bool) -> DataFrame:
        work = entries.groupBy(cell, block).agg(F.collect_list(F.struct("source", "node", "value")).alias("s"))
        work = work.select("cell", "block", part("source").alias("sources"), part("node").alias("nodes"), part("value").alias("values"))
        rows = cells if listed is None else cells.where(F.col("cell").isin(listed))
        copies = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(few - 1).cast("bigint"))).alias("block"))
        return work.hint("merge").join(copies, ["cell", "block"], "left").mapInPandas(settle(inside), "source bigint, node bigint, value bigint")

    entries = fresh = seeds.groupBy("source", "node").agg(F.min("value").alias("value"))
    first = True
    while few:
        if first:
            entries = fresh = tables.write(entries, name)
        active = [r.cell for r in fresh.select(cell).distinct().limit(MOST_LISTED + 1).collect()]
        if not active:
            break
        better = settled(fresh, active if len(active) <= MOST_LISTED else None, False)
        both = entries.select("source", "node", F.col("value").alias("old"), F.lit(None).cast("bigint").alias("new")).union(better.select("source", "node", F.lit(None).cast("bigint"), "value"))
        merged = both.groupBy("source", "node").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        merged = tables.write(merged.select("source", "node", F.least("old", "new").alias("value"), F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull()).alias("better")), name)
        tables.drop(keep=1)
        entries, fresh, first = merged.select("source", "node", "value"), merged.where("better").select("source", "node", "value"), False
    found = materialize(settled(entries, None, True), name) if few else entries
    kept.drop()
    tables.drop()
    return found.hint("merge")


def distances(arcs: DataFrame, sources: DataFrame, cell_nodes: int = CELL_NODES, limit: int | None = None) -> DataFrame:
    """``source, node, dist`` of every node that each source reaches, by least ``weight`` of ``tail, head, weight``; ``limit`` caps distances."""
    lists = F.collect_list(F.struct("tail", "head", F.col("weight").cast("bigint").alias("weight"))).alias("a")
    part = lambda c: F.transform("a", lambda x: x[c])
    cells = arcs.groupBy(F.expr(f"tail div {cell_nodes}").alias("cell")).agg(lists)
    cells = cells.select("cell", part("tail").alias("tails"), part("head").alias("heads"), part("weight").alias("weights"))

    def after(row) -> dict[int, list]:
        steps = defaultdict(list)
        for t, h, w in zip(row.tails.tolist(), row.heads.tolist(), row.weights.tolist(), strict=True):
            steps[t].append((h, w))
        return steps

    seeds = sources.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("value"))
    found = _rounds(cells, seeds, cell_nodes, after, "distances").withColumnRenamed("value", "dist")
    return found if limit is None else found.where(F.col("dist") <= limit)


def arrivals(arcs: DataFrame, sources: DataFrame, depart: int, period: int = 86_400_000, cell_nodes: int = CELL_NODES) -> DataFrame:
    """``source, node, arrival``: earliest arrivals over ``tail, head, ttf ARRAY<STRUCT<dt, tt>>`` when leaving at ``depart``.

    The same rounds over cells as ``distances``; a label is a time and an arc adds its travel time at that time, by integer
    interpolation. Functions must keep the order of departures.
    """
    lists = F.collect_list(F.struct("tail", "head", F.transform("ttf", lambda p: p["dt"]).alias("dts"), F.transform("ttf", lambda p: p["tt"]).alias("tts"))).alias("a")
    part = lambda c: F.transform("a", lambda x: x[c])
    cells = arcs.groupBy(F.expr(f"tail div {cell_nodes}").alias("cell")).agg(lists)
    cells = cells.select("cell", *[part(c).alias(f"{c}s" if c in ("tail", "head") else c) for c in ("tail", "head", "dts", "tts")])

    def later(dts: list[int], tts: list[int]):
        def arrive(d: int) -> int:
            t = d % period
            i = bisect.bisect_right(dts, t) - 1
            j = (i + 1) % len(dts)
            end = dts[j] if j else period
            return d + int(tts[i] + (tts[j] - tts[i]) * (t - dts[i]) // (end - dts[i]))

        return arrive

    def after(row) -> dict[int, list]:
        steps = defaultdict(list)
        for t, h, dts, tts in zip(row.tails.tolist(), row.heads.tolist(), row.dts, row.tts, strict=True):
            steps[t].append((h, later(list(map(int, dts)), list(map(int, tts)))))
        return steps

    seeds = sources.select("source", F.col("source").alias("node"), F.lit(depart).cast("bigint").alias("value"))
    return _rounds(cells, seeds, cell_nodes, after, "arrivals").withColumnRenamed("value", "arrival")


def nearest_targets(dist: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``source, node, dist, rank``: the k nearest targets of every source; ties by id."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("dist", "node")).cast("bigint")
    return dist.join(targets, "node", "left_semi").withColumn("rank", rank).where(F.col("rank") <= k)


def rank_nodes(dist: DataFrame) -> DataFrame:
    """Nodes whose settle rank (from 1) is a power of two."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("dist", "node")).cast("bigint")
    return dist.withColumn("rank", rank).where("bit_count(rank) = 1")


def first_beyond(dist: DataFrame, least: int) -> DataFrame:
    """The nearest node that is ``least`` or more away."""
    return dist.where(F.col("dist") >= least).groupBy("source").agg(F.min_by("node", F.struct("dist", "node")).alias("node"), F.min("dist").alias("dist"))


def parents(dist: DataFrame, arcs: DataFrame) -> DataFrame:
    """``source, node, parent, arc_id`` on a shortest path; of several the least arc."""
    tail = dist.select("source", F.col("node").alias("tail"), F.col("dist").alias("tail_dist"))
    tight = tail.join(arcs, "tail").join(dist.select("source", F.col("node").alias("head"), "dist"), ["source", "head"]).where("tail_dist + weight = dist AND weight > 0")
    return tight.groupBy("source", F.col("head").alias("node")).agg(F.min(F.struct("arc_id", "tail")).alias("b")).select("source", "node", F.col("b.tail").alias("parent"), F.col("b.arc_id").alias("arc_id"))


WALK = "source bigint, target bigint, node bigint, hops_to_target bigint"
#: Targets of a block, and rows of a batch that leaves Python.
WALKED, BATCH = 32_768, 500_000


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    """Of one cell of a tree: for each node the first node beyond the cell on the way up, or null, and the steps to it."""
    nodes = part["node"].to_numpy(np.int64)
    order = np.argsort(nodes)
    nodes, ups = nodes[order], part["up"].to_numpy(np.int64)[order]
    at = np.minimum(np.searchsorted(nodes, ups), len(nodes) - 1)
    end = nodes[at] != ups
    at, steps = np.where(end, np.arange(len(nodes)), at), np.where(end, 0, 1)
    while (steps[at] > 0).any():
        steps, at = steps + steps[at], at[at]
    return pd.DataFrame({"source": part["source"].iloc[0], "node": nodes, "up": ups[at], "steps": steps + 1})


def _walk(batches):
    """All nodes of the cell on the way up from each entry, for all entries of a row at once."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes, ups = np.array(row["nodes"] or [], np.int64), np.array(row["ups"] or [], np.int64)
            order = np.argsort(nodes)
            nodes, ups = nodes[order], ups[order]
            find = lambda v: np.where(nodes[np.minimum(np.searchsorted(nodes, v), len(nodes) - 1)] == v, np.searchsorted(nodes, v), -1) if len(nodes) else np.full(len(v), -1)  # noqa: E731, B023
            next_at = find(ups)
            target, node, hops = (np.array(row[c], np.int64) for c in ("targets", "entries", "offsets"))
            at, parts, n = find(node), [], 0
            while len(target):
                parts.append((target, node, hops))
                n += len(target)
                on = at >= 0
                target, at, hops = target[on], at[on], hops[on] + 1
                node, at = ups[at], next_at[at]
                # what lies beyond the cell belongs to the next entry, but for a root that has no row anywhere
                inside = (at >= 0) | (node // row["width"] == row["cell"])
                target, node, at, hops = target[inside], node[inside], at[inside], hops[inside]
                if n >= BATCH or not len(target):
                    found = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["source"], np.int64)), *map(pa.array, found)], names=["source", "target", "node", "hops_to_target"])
                    parts, n = [], 0


def unpack(targets: DataFrame, tree: DataFrame, cell_nodes: int = CELL_NODES) -> DataFrame:
    """``source, target, node, hops_to_target`` of all nodes on the tree paths.

    Their number may be the square of the tree's, so they are written nowhere: what is kept is where each path enters cells of ids. These
    places come from the first node beyond a node's cell, by pointer doubling over such nodes only; the nodes inside are walked when the result is read.
    """
    spark = tree.sparkSession
    small_batches(spark)
    cell = lambda c: F.expr(f"{c} div {cell_nodes}").alias("cell")
    tree = materialize(tree.select("source", "node", F.col("parent").alias("up")), "tree")
    cells = tree.groupBy("source", cell("node")).agg(F.collect_list(F.struct("node", "up")).alias("t"))
    exits = materialize(tree.groupBy("source", cell("node")).applyInPandas(_exits, "source bigint, node bigint, up bigint, steps bigint").where(cell("node") != cell("up")), "exits")
    begin = materialize(exits.select("source", F.col("up").alias("node")).distinct(), "entries")
    up = materialize(exits.hint("merge").join(begin.hint("merge"), ["source", "node"], "left_semi"), "exits")
    chain = materialize(begin.select("source", F.col("node").alias("first"), "node", F.lit(0).cast("bigint").alias("hops")), "entries")
    while True:
        moved = chain.hint("merge").join(up.hint("merge"), ["source", "node"]).select("source", "first", F.col("up").alias("node"), (F.col("hops") + F.col("steps")).alias("hops"))
        if moved.isEmpty():
            break
        chain = materialize(chain.unionByName(moved), "entries")
        twice = up.alias("a").join(up.alias("b").hint("merge"), (F.col("a.source") == F.col("b.source")) & (F.col("a.up") == F.col("b.node")))
        up = materialize(twice.select("a.source", "a.node", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps")), "exits")
    own = materialize(targets.select("source", F.col("node").alias("target")), "targets")
    left = own.hint("merge").join(exits.select("source", F.col("node").alias("target"), F.col("up").alias("first"), "steps").hint("merge"), ["source", "target"])
    passed = left.hint("merge").join(chain.hint("merge"), ["source", "first"]).select("source", "target", "node", (F.col("hops") + F.col("steps")).alias("hops"))
    places = passed.union(own.select("source", "target", F.col("target").alias("node"), F.lit(0).cast("bigint")))
    blocks = max(1, -(-own.count() // WALKED))
    work = places.groupBy("source", cell("node"), F.pmod(F.xxhash64("target"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("target", "node", "hops")).alias("p"))
    part = lambda rows, c: F.transform(rows, lambda x: x[c])
    rows = work.hint("merge").join(cells.hint("merge"), ["source", "cell"], "left")
    rows = rows.select("source", "cell", F.lit(cell_nodes).alias("width"), part("t", "node").alias("nodes"), part("t", "up").alias("ups"), part("p", "target").alias("targets"), part("p", "node").alias("entries"), part("p", "hops").alias("offsets"))
    return rows.repartition("source", "cell", F.hash("targets")).mapInArrow(_walk, WALK)


def with_ancestors(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """``source, node``: the nodes and all nodes on their tree paths, each once, by pointer doubling.

    No row is ever a pair of a node and one of its ancestors, so tables stay as small as the tree; it ends as soon as a step adds nothing.
    """
    up = materialize(tree.select("source", "node", F.col("parent").alias("up")), "tree").hint("merge")
    marked = materialize(nodes.select("source", "node").distinct(), "marked")
    while True:
        moved = marked.join(up, ["source", "node"]).select("source", F.col("up").alias("node")).distinct()
        added = materialize(moved.join(marked.hint("merge"), ["source", "node"], "left_anti"), "marked")
        if added.isEmpty():
            return marked
        marked = materialize(marked.union(added), "marked")
        two = up.alias("a").join(up.alias("b"), (F.col("a.source") == F.col("b.source")) & (F.col("a.up") == F.col("b.node"))).select("a.source", "a.node", "b.up")
        up = materialize(two, "tree").hint("merge")


def weak_components(arcs: DataFrame) -> DataFrame:
    """``node, root`` with the least node of each weak component as root; alternates large and small star steps."""
    edges = materialize(arcs.where("tail <> head").select(F.least("tail", "head").alias("lo"), F.greatest("tail", "head").alias("hi")).distinct(), "stars")
    last = None
    while True:
        both = edges.union(edges.select("hi", "lo")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        floor = big.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = big.join(floor, "hi")
        edges = materialize(joined.select(F.col("m").alias("lo"), "hi").union(joined.where("lo > m").select("m", "lo")).distinct(), "stars")
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    inner = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return inner.union(edges.select("lo", "lo").distinct())


def reach(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node``: forward reachability, by distances of unit arcs."""
    return distances(arcs.select("tail", "head", F.lit(1).alias("weight")), sources).select("source", "node")


def _strong(n: int, tails: list[int], heads: list[int]) -> tuple[list[int], list[list[int]]]:
    """The component of each of ``n`` nodes, by Tarjan's algorithm, and the heads of each; a component's number is above those it reaches."""
    after: list[list[int]] = [[] for _ in range(n)]
    for t, h in zip(tails, heads, strict=True):
        after[t].append(h)
    seen, low, component, stack, clock, number = [0] * n, [0] * n, [-1] * n, [], 0, 0
    for first in range(n):
        if seen[first]:
            continue
        clock += 1
        seen[first] = low[first] = clock
        stack.append(first)
        work = [(first, iter(after[first]))]
        while work:
            v, rest = work[-1]
            for h in rest:
                if not seen[h]:
                    clock += 1
                    seen[h] = low[h] = clock
                    stack.append(h)
                    work.append((h, iter(after[h])))
                    break
                if component[h] < 0 and seen[h] < low[v]:
                    low[v] = seen[h]
            else:
                work.pop()
                if work and low[v] < low[work[-1][0]]:
                    low[work[-1][0]] = low[v]
                if low[v] == seen[v]:
                    while True:
                        u = stack.pop()
                        component[u] = number
                        if u == v:
                            break
                    number += 1
    return component, after


#: So many arcs are settled in one task; cells with more border nodes go on with their own arcs.
SETTLED, BORDERS = 1_000_000, 4096


def _between_borders(arcs: pd.DataFrame, border: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of one cell: arcs between border nodes that reach the same as its arcs do, or its arcs where those are no more."""
    ids, ends = np.unique(arcs[["tail", "head"]].to_numpy(np.int64)), np.unique(border["node"].to_numpy(np.int64))
    if not len(ids) or len(ends) > most:
        return arcs[["tail", "head"]]
    component, after = _strong(len(ids), np.searchsorted(ids, arcs["tail"]).tolist(), np.searchsorted(ids, arcs["head"]).tolist())
    members: dict[int, list[int]] = defaultdict(list)
    inside = ends[np.isin(ends, ids)]
    for node, v in zip(inside.tolist(), np.searchsorted(ids, inside).tolist(), strict=True):
        members[component[v]].append(node)
    bit = {c: 1 << i for i, c in enumerate(members)}
    owner = list(members)
    reached = [0] * (max(component) + 1)  # the next components with border nodes on the way
    by_component: list[list[int]] = [[] for _ in reached]
    for v, c in enumerate(component):
        by_component[c].append(v)
    rows = []
    for c, inner in enumerate(by_component):
        for v in inner:
            for h in after[v]:
                if component[h] != c:
                    reached[c] |= bit.get(component[h]) or reached[component[h]]
        if c in members:
            own = members[c]
            rows += list(zip(own, own[1:] + own[:1], strict=True)) if len(own) > 1 else []
            left = reached[c]
            while left:
                last = left & -left
                rows.append((own[0], members[owner[last.bit_length() - 1]][0]))
                left ^= last
            if len(rows) >= len(arcs):
                return arcs[["tail", "head"]]
    return pd.DataFrame(rows, columns=["tail", "head"], dtype="int64")


def _with_roots(arcs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Of one cell: the roots of its nodes; nodes of a known root lie on one cycle, wherever that runs."""
    ids = np.unique(np.concatenate([arcs["tail"], arcs["head"], known["node"]]).astype(np.int64))
    at = np.searchsorted(ids, known["node"]).tolist()
    tails, heads = np.searchsorted(ids, arcs["tail"]).tolist(), np.searchsorted(ids, arcs["head"]).tolist()
    first: dict[int, int] = {}
    for v, root in zip(at, known["root"].tolist(), strict=True):
        u = first.setdefault(root, v)
        if u != v:
            tails += [u, v]
            heads += [v, u]
    component, _ = _strong(len(ids), tails, heads)
    roots: dict[int, int] = {component[v]: root for v, root in zip(at, known["root"].tolist(), strict=True)}
    return pd.DataFrame({"node": ids, "root": np.array([roots.setdefault(c, i) for i, c in zip(ids.tolist(), component, strict=True)], np.int64)})


def strong_components(arcs: DataFrame, nodes: DataFrame, cell_nodes: int = CELL_NODES) -> DataFrame:
    """``node, root``: cells of ids become arcs between their border nodes, in wider and wider cells, until one task can settle the rest.

    Then the roots go down again: whatever of a cycle lies outside a cell joins border nodes of the cell that have one root, so the cell
    with these joined has its whole components. No cell gets more arcs by it; a network that does not shrink by half is settled by ``strong_by_reach``.
    """
    live = arcs.where("tail <> head").select("tail", "head").distinct()
    for end in ("tail", "head"):
        live = live.join(nodes.select(F.col("node_id").alias(end)).distinct().hint("merge"), end, "left_semi")
    live, levels, width = materialize(live.select("tail", "head"), "strong-arcs"), [], cell_nodes
    pair, rooted = "tail bigint, head bigint", "node bigint, root bigint"
    cell = lambda c, w: F.expr(f"{c} div {w}").alias("cell")
    most = BORDERS
    while (n := live.count()) > SETTLED:
        inner, crossing = live.where(cell("tail", width) == cell("head", width)), live.where(cell("tail", width) != cell("head", width))
        border = materialize(crossing.select(F.explode(F.array("tail", "head")).alias("node")).distinct(), "strong-border")
        less = inner.groupBy(cell("tail", width)).cogroup(border.groupBy(cell("node", width))).applyInPandas(lambda a, b: _between_borders(a, b, most), pair)
        less = materialize(less.union(crossing), "strong-arcs")
        if 2 * less.count() > n:
            break
        levels.append((inner, width))
        live, width = less, width * 8
    if n > SETTLED:
        ends = live.select(F.explode(F.array("tail", "head")).alias("node_id")).distinct()
        roots = strong_by_reach(live, ends)
    else:
        none = live.select(F.col("tail").alias("node"), F.col("tail").alias("root")).limit(0)
        roots = live.groupBy(F.lit(0).alias("cell")).cogroup(none.groupBy(F.lit(0).alias("cell"))).applyInPandas(_with_roots, rooted)
    for inner, width in reversed(levels):
        roots = materialize(roots, "strong")
        roots = inner.groupBy(cell("tail", width)).cogroup(roots.groupBy(cell("node", width))).applyInPandas(_with_roots, rooted)
    found = nodes.select(F.col("node_id").alias("node")).join(materialize(roots, "strong").hint("merge"), "node", "left")
    return found.select("node", F.coalesce("root", "node").alias("root"))


def strong_by_reach(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root``: forward and backward reach from one node of every piece, until none is left.

    The nodes in both are a strong component; those ahead only, behind only and neither go on as three pieces. The
    start is random by a hash, so pieces shrink by a constant share on average. Nodes without arcs on a side go first.
    """
    left = nodes.select(F.col("node_id").alias("node"), F.lit(0).cast("bigint").alias("piece"))
    done = None
    live = arcs.select("tail", "head")
    while True:
        left = materialize(left, "strong")
        if left.isEmpty():
            return done
        tagged = live.join(left.select(F.col("node").alias("tail"), F.col("piece").alias("p")), "tail").join(left.select(F.col("node").alias("head"), F.col("piece").alias("q")), "head").where("p = q")
        live = materialize(tagged.select("tail", "head"), "strong-arcs")
        busy = live.select(F.col("tail").alias("node")).intersect(live.select(F.col("head").alias("node")))
        alone = left.join(busy, "node", "left_anti").select("node", F.col("node").alias("root"))
        done = alone if done is None else done.union(alone)
        left = materialize(left.join(busy, "node", "left_semi"), "strong")
        if left.isEmpty():
            return done
        pivots = left.groupBy("piece").agg(F.min_by("node", F.xxhash64("node")).alias("source"))
        ahead = reach(live, pivots).select("node", F.col("source").alias("f"))
        back = reach(live.select(F.col("head").alias("tail"), F.col("tail").alias("head")), pivots).select("node", F.col("source").alias("b"))
        marked = materialize(left.join(ahead, "node", "left").join(back, "node", "left"), "strong")
        found = marked.where("f = b").select("node", F.col("f").alias("root"))
        # ahead only, back only and neither are three pieces
        left = marked.where("f is null or b is null").select("node", F.xxhash64("piece", F.col("f").isNotNull(), F.col("b").isNotNull()).alias("piece"))
        done = done.union(found)
