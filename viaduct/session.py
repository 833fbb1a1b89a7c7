"""Session settings shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor and the driver see, from ``spark.checkpoint.dir``.

    The setting is read from the session. Only a session without one, as in tests on one
    machine, gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("VIADUCT_SHARED_DIR")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/viaduct-shared"
    return folder.rstrip("/")


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    This cuts lineage and fixes row order inside each file; a lost executor costs a re-read only.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Tables:
    """Tables of one computation in the shared folder. Those that nothing reads any more are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep`` ones."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        last = len(self.paths) - keep
        for path in self.paths[:last]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = self.paths[last:]


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Hand texts to Python in Arrow batches of at most ``limit`` bytes, or one row, unless the session has a lower limit.

    Spark's own limit of 64 MB costs a multiple of it, on both sides, for every running task.
    """
    have = spark.conf.get(ARROW_BYTES, "67108864b").lower().removesuffix("b")
    if not have.isdigit() or int(have) > limit:
        spark.conf.set(ARROW_BYTES, limit)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
