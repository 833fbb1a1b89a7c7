"""Connected components of links, on the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.skew import split_join
from viaduct.session import Tables


#: Up to so many links make one task's work, of some 50 MB; rounds on the cluster would cost more in starting tasks than in work.
FEW = 500_000


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a, b that aren't their component's least one, and that one. Roots are hung under lesser neighbours, so each round halves them at least."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, (x, y) = np.arange(len(nodes)), place.reshape(2, -1)
    while True:
        lo, hi = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        apart = lo != hi
        if not apart.any():
            moved = np.flatnonzero(parent != np.arange(len(nodes)))
            return nodes[moved], nodes[parent[moved]]
        x, y = x[apart], y[apart]
        np.minimum.at(parent, hi[apart], lo[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _at_once(links: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def join(batches):
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(*(np.concatenate(x) for x in zip(*pairs, strict=True)))], schema=schema)

    return links.select("a", "b").coalesce(1).mapInArrow(join, "node bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``a, b``; the root is the component's least node.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones,
    to the least of its neighbourhood. The number of rounds is logarithmic in the longest chain. Every round is
    written to the shared folder, and the one before is dropped. Minima are pre-aggregated, and a hub's edges meet its minimum in a join that spreads
    hot nodes, so no hub gathers in one task. Up to ``FEW`` links are settled at once, in one task.
    """
    tables = Tables(links.sparkSession)
    if links.count() <= FEW:
        return tables.write(_at_once(links), "components")
    edges = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = tables.write(edges, "components")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        both = edges.union(edges.select("hi", "lo")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = split_join(both.where("v > u"), least, ["u"], "n", 2 * now[0]).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        large = tables.write(large, "components")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = split_join(large, low, ["hi"], "n", large.count())
        small = small.select("m", "hi").union(small.where("lo <> m").select("m", F.col("lo").alias("hi"))).toDF("lo", "hi").distinct()
        edges = tables.write(small, "components")
        tables.drop(keep=1)
