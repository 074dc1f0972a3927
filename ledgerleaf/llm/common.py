"""What several corpus operators share: the folder all executors see, cutting of lineage, slices, and joins on hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than this part of a join's rows are hot; so there are fewer than its inverse of them.
HOT = 0.001


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
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes in one string column; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def hot_join(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """The inner join on ``key``, which is unique in ``table`` and non-null; ``size`` counts the rows of each key.

    Hot keys, fewer than 1 / HOT by their definition, are broadcast, so their rows stay where they are; the others
    are shuffled. Both frames should be cut before, since each is read twice.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    least = max(total * HOT, 1)
    hot, cold = table.where(F.col(size) > least), table.where(F.col(size) <= least)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)
