"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """A result of one row, or of a row per column, computed now and not again at each use."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _shared(spark) -> str:
    """spark.checkpoint.dir; where none is set and all runs on this machine (tests) a folder of our own: other machines
    would not see it."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut, by a Parquet table of its own in the shared folder, for loops of many rounds. With checkpoints alone the rounds
    of agglomerate did not end within minutes, with tables they do; likely, not profiled, a checkpoint carries the estimated
    sizes of its joins on and their digits multiply, while a table's size is that of its files."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
