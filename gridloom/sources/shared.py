"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def use_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed (tests, notebooks)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a session on one machine may lack it and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """`df` written to the shared folder (or a folder there) and read back: lineage ends there.

    Spark's commit protocol makes the table whole or absent, so lost executors
    only repeat tasks; later stages start from the table.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
