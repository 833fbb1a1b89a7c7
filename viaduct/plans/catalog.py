"""The registered queries of the engine's own operators, with the SQL that states each result."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import viaduct.plans as plans
from viaduct.plans.registry import ORACLE_SQL, QUERIES

for module in pkgutil.iter_modules(plans.__path__):
    if module.name not in ("catalog", "registry"):
        importlib.import_module(f"viaduct.plans.{module.name}")

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g01_shortest_distances" if "g01_shortest_distances" in QUERIES else "f26_f29_weights"](spark, sf_dir)
