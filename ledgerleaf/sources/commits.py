"""Releases as writes: a log of numbered entries, each put only where there is none, and a pointer that readers follow.

A writer reads the log, checks what it is about to do against it, and puts its entry under the next number. Of two writers
one finds its number taken, reads again and checks again. Readers take the highest whole entry, so they see the state
before a commit or after it, never a mixture; clocks decide nothing. Data is written before its entry, and what no entry
names was never released.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names of entries sort as their numbers do.
DIGITS = 12
ENTRY = "version long, action string, release string, path string, actor string, members map<string,long>"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit was based on."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file, whole or not at all, unless there is one; false if there is.

    Stores whose create without overwriting is atomic (HDFS, and object stores with conditional puts) need no more; on a
    plain file system a finished file is linked under its name, which fails where that exists.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    local = fs.getUri().getScheme() == "file"
    first = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}") if local else target
    try:
        out = fs.create(first, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    if not local:
        return True
    files, to = jvm.java.nio.file.Files, lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
    try:
        files.createLink(to(target), to(first))
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(first, False)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The whole entries of a log, without order; none where nothing was committed yet. What isn't whole isn't an entry."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_log")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(str(path)).where("version IS NOT NULL AND action IS NOT NULL")


def _taken(spark: SparkSession, folder: str) -> int:
    """The highest number that has a file, whole or not; -1 without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_log")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n[:DIGITS]) for n in names if n.endswith(".json")), default=-1)


def commit(spark: SparkSession, folder: str, make: Callable[[DataFrame], dict], based_on: int | None = None) -> int:
    """Commits what ``make`` returns for the log's entries, and returns its number; ``make`` raises to refuse.

    On a conflict the log is read and ``make`` asked again; with ``based_on`` a commit since that version is a Conflict.
    """
    while True:
        last = _taken(spark, folder)
        if based_on is not None and last != based_on:
            raise Conflict(f"version {last} was committed after {based_on}")
        entry = make(entries(spark, folder).where(F.col("version") <= last))
        text = json.dumps({"version": last + 1, **entry}, sort_keys=True) + "\n"
        if put_if_absent(spark, f"{folder}/_log/{last + 1:0{DIGITS}d}.json", text):
            return last + 1


def create_release(spark: SparkSession, folder: str, release: str, parts: dict[str, DataFrame], required: list[str], actor: str = "system") -> int:
    """Writes the membership (column id) of each part and commits the draft; the ids must be unique and not null, required
    parts must have some, and the release must be new. Returns the entry's number."""
    counts = []
    for name, ids in parts.items():
        counts.append(ids.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(F.col("id").isNull()).alias("nulls")))
    found = {r["part"]: r for r in reduce(DataFrame.unionByName, counts).collect()}
    faults = [n for n, r in found.items() if r["nulls"] or r["n"] != r["distinct"] or (n in required and not r["n"])]
    if faults or set(required) - set(parts):
        raise ValueError(f"membership of {sorted(faults) or sorted(set(required) - set(parts))} must be nonempty where required, unique and not null")
    path = f"{folder}/{uuid.uuid4().hex}"
    for name, ids in parts.items():
        ids.select("id").write.parquet(f"{path}/{name}")

    def make(log: DataFrame) -> dict:
        if not log.where((F.col("action") == "draft") & (F.col("release") == release)).isEmpty():
            raise ValueError(f"{release} exists")
        return {"action": "draft", "release": release, "path": path, "actor": actor, "members": {n: r["n"] for n, r in found.items()}}

    return commit(spark, folder, make)


def activate(spark: SparkSession, folder: str, release: str, violations: DataFrame, actor: str = "system", based_on: int | None = None) -> int:
    """Moves the pointer to a release that exists and has no violations; the one before is superseded."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"not activated: {[r.asDict() for r in found]}")

    def make(log: DataFrame) -> dict:
        if log.where((F.col("action") == "draft") & (F.col("release") == release)).isEmpty():
            raise ValueError(f"{release} doesn't exist")
        return {"action": "activate", "release": release, "actor": actor}

    return commit(spark, folder, make, based_on)


def rollback(spark: SparkSession, folder: str, release: str, violations: DataFrame, actor: str = "system", based_on: int | None = None) -> int:
    """Moves the pointer back to a release that was active before; it must still have no violations."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"not rolled back: {[r.asDict() for r in found]}")

    def make(log: DataFrame) -> dict:
        if log.where((F.col("action") == "activate") & (F.col("release") == release)).isEmpty():
            raise ValueError(f"{release} was never active")
        return {"action": "rollback", "release": release, "actor": actor}

    return commit(spark, folder, make, based_on)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(version, action, release, active, superseded, members): the log replayed. A log is small; it is ordered in one task."""
    order = Window.orderBy("version")
    moves = F.when(F.col("action").isin("activate", "rollback"), F.col("release"))
    rows = entries(spark, folder).withColumn("active", F.last(moves, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.lag("active").over(order)
    superseded = F.when(moves.isNotNull() & (before != F.col("release")), before)
    return rows.select("version", "action", "release", "active", superseded.alias("superseded"), "members")


def active_part(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """The ids of one part of the active release."""
    log = entries(spark, folder)
    release = log.where(F.col("action").isin("activate", "rollback")).agg(F.max_by("release", "version")).first()[0]
    if release is None:
        raise ValueError("no release is active")
    path = log.where((F.col("action") == "draft") & (F.col("release") == release)).first()["path"]
    return spark.read.parquet(f"{path}/{part}")
