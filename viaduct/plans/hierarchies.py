"""Queries over contraction hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import hierarchy
from viaduct.plans.registry import query
from viaduct.plans.spatial_graph import FEW, few, relaxation, weighted
from viaduct.sources import grid


@query("g07_g09_hierarchy_distances", f"{grid.WITH}, {relaxation(FEW)} SELECT source, node AS target, d AS dist FROM dist WHERE node IN (SELECT node_id FROM nodes)")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, contraction, customization and the query by sweeps (g06 to g11, g17, g18, j27): labels of all nodes would repeat what they share above."""
    found = hierarchy.rounds(weighted(spark, sf_dir).select("tail", "head", "weight"), hierarchy.order(grid.nodes(spark, sf_dir), 0.001), 3)
    targets = grid.nodes(spark, sf_dir).select(F.col("node_id").alias("target"))
    reached = hierarchy.sweep(found, few(spark, sf_dir)).withColumnRenamed("node", "target")
    return reached.join(targets, "target", "left_semi").select("source", "target", "dist")
