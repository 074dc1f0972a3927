"""Reading and writing of tables: Parquet, JSON documents, JSON lines, byte inventories; upserts and checked loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def select(df: DataFrame, columns: list[str], **filters: object) -> DataFrame:
    """A scan with equality filters; a null filter value matches nulls."""
    for name, value in filters.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df.select(*columns)


def read_json_documents(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """One row for each JSON file below a folder, with its path; unknown fields are kept apart, never dropped unseen."""
    return spark.read.schema(schema).json(folder, multiLine=True, recursiveFileLookup=True, mode="FAILFAST").withColumn("path", F.input_file_name())


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256, extension) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new``, which replace those of equal keys."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def conflicts(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both have with different content, nulls being equal to nulls; a load requires none."""
    rest = [c for c in current.columns if c not in keys]
    a, b = current.alias("a"), new.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rest]
    differ = ~F.expr("true")
    for s in same:
        differ = differ | ~s
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).where(differ).select(*(F.col(f"a.{k}").alias(k) for k in keys)).distinct()


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing (only left), added (only right) or changed, of two key-to-value tables."""
    a, b = left.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(1).alias("in_a")), right.select(F.col(key).alias("k"), F.col(value).alias("y"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "added").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return a.join(b, "k", "full").select(F.col("k").alias(key), state.alias("state")).where("state IS NOT NULL")


def load_checked(new: DataFrame, violations: DataFrame, path: str) -> int:
    """Write ``new`` as one Parquet folder if the violations are none; Spark's commit makes the folder whole or absent.

    Returns the number of rows. Raises ValueError, naming up to five violations, and writes nothing otherwise.
    """
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"not loaded: {[r.asDict() for r in found]}")
    new.write.mode("errorifexists").parquet(path)
    return new.sparkSession.read.parquet(path).count()


def projected(rows: DataFrame, required: dict[str, str], optional: dict[str, str]) -> DataFrame:
    """The named columns in their types; a required one that is absent is an error, an optional one is null."""
    lacking = sorted(set(required) - set(rows.columns))
    if lacking:
        raise ValueError(f"columns {lacking} are missing")
    return rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (required | optional).items()))


def swap_checked(folder: str, new: DataFrame, violations: DataFrame) -> str:
    """Load ``new`` as a version of its own below ``folder`` and then commit it to the folder's log; returns its path.

    Readers take the highest entry of the log, so they see the old version or the new one, never a mixture.
    """
    path, spark = f"{folder}/{uuid.uuid4().hex}", new.sparkSession
    load_checked(new, violations, path)
    commits.commit(spark, folder, lambda log: {"action": "swap", "path": path})
    return path


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    """The table that the last swap put in place."""
    return spark.read.parquet(commits.entries(spark, folder).where("action = 'swap'").agg(F.max_by("path", "version")).first()[0])
