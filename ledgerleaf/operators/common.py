"""Helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, ``spark.checkpoint.dir``; unset, a temporary one on one machine, and an error on
    a cluster, where no local folder can stand in."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.match(r"local(\[.*\])?$", sc.master):
            folder = tempfile.mkdtemp(prefix="ledgerleaf-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and go on from there; loops would else grow their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a table of the shared folder with columns of its own, which can be joined to where they come from."""
    path = new_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def upto_here(partition: list[str], order: list[str | Column]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ratio(part: Column, whole: Column) -> Column:
    """Null over nothing."""
    return F.when(whole != 0, part / whole)


def top_rows(df: DataFrame, partition: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each partition; Catalyst drops most rows before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= k)
