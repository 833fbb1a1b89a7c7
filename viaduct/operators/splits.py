"""Turn restrictions over several ways: nodes of the turn graph are split along each chain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators import paths
from viaduct.session import materialize

#: Numbers of chains in a block of the prefix sums.
BLOCK = 4096
#: In place of a chain's number: a node that was there before, and a row that tells a copy's original.
OLD, ORIGINAL = -1, -2
SPLIT = "from_chain bigint, from_at bigint, to_chain bigint, to_at bigint, weight bigint"


def _split(chains: list[tuple[int, list[int], bool]], ahead: dict[tuple[int, int], dict[tuple[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows of ``SPLIT`` for one group of chains, applied one by one. A node is (OLD, its id) or (number of the chain, place of the copy)."""
    orig: dict[tuple[int, int], int] = {}
    arc_of = lambda n: orig.get(n, n[1])
    for number, arcs, mandatory in sorted(chains, key=lambda c: c[0]):
        if len(arcs) < 3:
            continue
        # copies of earlier chains stand for their arcs
        at, whole = (OLD, arcs[0]), True
        walk = [at]
        for arc in arcs[1:]:
            step = next((n for n in sorted(ahead.get(at, {})) if arc_of(n) == arc), None)
            if step is None:
                whole = False
                break
            walk.append(step)
            at = step
        if not whole:
            continue
        copies = [(number, k) for k in range(len(walk) - 2)]
        for copy, node in zip(copies, walk[1:-1], strict=True):
            orig[copy] = arc_of(node)
            ahead[copy] = dict(ahead[node])
        ahead[walk[0]][copies[0]] = ahead[walk[0]].pop(walk[1])
        for copy, follower, node in zip(copies, copies[1:], walk[2:-1], strict=False):
            ahead[copy][follower] = ahead[copy].pop(node)
        last = ahead[copies[-1]]
        ahead[copies[-1]] = {walk[-1]: last[walk[-1]]} if mandatory else {n: w for n, w in last.items() if n != walk[-1]}
    return [(*a, *b, w) for a, out in ahead.items() for b, w in out.items()] + [(*copy, ORIGINAL, arc, 0) for copy, arc in orig.items()]


def _before(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``key, before``: the sum of ``n`` over lesser keys, inside blocks, then over the blocks."""
    rows = counts.withColumn("block", F.expr(f"{key} div {BLOCK}"))
    inner = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # one row a block
    base = rows.groupBy("block").agg(F.sum(n).alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = rows.select(key, "block", F.coalesce(F.sum(n).over(inner), F.lit(0)).alias("own"))
    return own.join(base, "block").select(key, (F.col("own") + F.col("base")).alias("before"))


def split_chains(edges: DataFrame, chains: DataFrame, first_new: int) -> tuple[DataFrame, DataFrame]:
    """New edges ``from_node, to_node, weight`` and ``node, orig`` of the split nodes.

    ``chains``: ``chain_id, arcs ARRAY<BIGINT>, mandatory``. The inner arcs of a chain get copies that only the chain's entry leads to: its
    first transition is redirected, copies follow the chain, and the last copy loses the chain's last transition, or, if the chain
    is mandatory, all others. Chains of fewer than three arcs, or with a transition that is gone, are skipped; a chain sees the
    splits before it, so they are applied one by one. Only chains that share arcs, directly or through others, see each other: each
    such group is one row of a task, and nothing comes to the driver. Copies are numbered from ``first_new`` on in the order of chains.
    """
    # numbers of chains: blocks are ranges of ids
    ranged = materialize(chains.select("chain_id", "arcs", "mandatory").repartitionByRange("chain_id").withColumn("range", F.spark_partition_id()), "chains")
    first = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # one row a task
    place = F.row_number().over(Window.partitionBy("range").orderBy("chain_id", "arcs", "mandatory")) - 1
    numbered = ranged.withColumn("place", place).join(first, "range").select((F.col("first") + F.col("place")).alias("chain"), "arcs", "mandatory")
    # groups of chains
    entry = F.get("arcs", F.lit(0))
    roots = materialize(paths.weak_components(ranged.select(entry.alias("tail"), F.explode("arcs").alias("head"))), "groups").hint("merge")
    touched = materialize(ranged.select(F.explode("arcs").alias("node")).distinct().join(roots, "node", "left").select(F.col("node").alias("from_node"), F.coalesce("root", "node").alias("root")), "touched").hint("merge")
    near = edges.select("from_node", "to_node", F.col("weight").cast("bigint").alias("weight")).join(touched, "from_node")
    part = lambda c, field: F.transform(c, lambda x: x[field]).alias(f"{field}s")
    near = near.groupBy("root").agg(F.collect_list(F.struct("from_node", "to_node", "weight")).alias("e")).select("root", *[part("e", c) for c in ("from_node", "to_node", "weight")])
    work = numbered.where(F.size("arcs") > 0).join(touched, F.col("from_node") == entry).groupBy("root").agg(F.collect_list(F.struct("chain", "arcs", "mandatory")).alias("c"))
    work = work.select("root", *[part("c", c) for c in ("chain", "arcs", "mandatory")]).join(near.hint("merge"), "root")

    def settle(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                ahead: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
                for a, b, w in zip(r.from_nodes.tolist(), r.to_nodes.tolist(), r.weights.tolist(), strict=True):
                    ahead.setdefault((OLD, a), {})[OLD, b] = w
                rows += _split([(n, a.tolist(), m) for n, a, m in zip(r.chains.tolist(), r.arcss, r.mandatorys.tolist(), strict=True)], ahead)
            yield pd.DataFrame(rows, columns=["from_chain", "from_at", "to_chain", "to_at", "weight"])

    found = materialize(work.mapInPandas(settle, SPLIT), "splits")
    copies = found.where(F.col("to_chain") == ORIGINAL).select(F.col("from_chain").alias("chain"), "from_at", F.col("to_at").alias("orig"))
    begin = materialize(_before(copies.groupBy("chain").agg(F.count("*").alias("n")), "chain", "n"), "copies").hint("merge")
    nodes = copies.join(begin, "chain").select((F.lit(first_new) + F.col("before") + F.col("from_at")).cast("bigint").alias("node"), "orig")
    side = lambda c: begin.select(F.col("chain").alias(f"{c}_chain"), (F.lit(first_new) + F.col("before")).cast("bigint").alias(f"{c}_first"))
    node = lambda c: (F.coalesce(f"{c}_first", F.lit(0).cast("bigint")) + F.col(f"{c}_at")).alias(f"{c}_node")
    changed = found.where(F.col("to_chain") != ORIGINAL).join(side("from"), "from_chain", "left").join(side("to"), "to_chain", "left").select(node("from"), node("to"), "weight")
    kept = edges.join(touched, "from_node", "left_anti").select("from_node", "to_node", "weight")
    return kept.unionByName(changed), materialize(nodes, "split-nodes").hint("merge")
