"""Joins, aggregates and checks that Spark has no single function for, as compositions of DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_parents(own: DataFrame, new: DataFrame) -> DataFrame:
    """Parents whose ordered set of children differs; both tables have parent and child."""
    gather = lambda df, name: df.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias(name))
    return gather(own, "a").join(gather(new, "b"), "parent", "full").where("NOT (a <=> b)").select("parent")


def set_digest(rows: DataFrame, digits: int = 3) -> DataFrame:
    """(set_name, n, digest): SHA-256 over each set's member hashes (set_name, hash as hex), whatever their order was.

    Members are sorted and digested within buckets of their first ``digits`` hex digits, and the buckets' digests again,
    so that no task holds all of a large set.
    """
    over = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    buckets = rows.groupBy("set_name", F.substring("hash", 1, digits).alias("bucket")).agg(F.count("*").alias("n"), over("hash").alias("digest"))
    entry = F.concat_ws(":", "bucket", "digest")
    return buckets.groupBy("set_name").agg(F.sum("n").alias("n"), over(entry).alias("digest"))


def pair_occurrences(left: DataFrame, right: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The k-th occurrence of a key on one side meets the k-th on the other; what is left over stays alone."""
    number = lambda df, by: df.withColumn("k_th", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    return number(left, x).join(number(right, y), [key, "k_th"], "full").drop("k_th")


def interval_join(intervals: DataFrame, points: DataFrame, width_s: int) -> DataFrame:
    """Points (key, at) inside half-open intervals (key, low, high) of at most ``width_s`` seconds.

    Time is cut into buckets of that width, so an interval lies in two at most: an equi-join on key and bucket, with the
    range test after it, in place of a nested loop over each key.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / width_s)
    wide = intervals.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    return wide.join(points.withColumn("bucket", bucket(F.col("at"))), ["key", "bucket"]).where("at >= low AND at < high").drop("bucket")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(scope, alias, n, match, state): an alias resolves in a scope only if it names one id there."""
    found = aliases.groupBy("scope", "alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return found.select("scope", "alias", "n", F.when(F.col("n") == 1, F.col("id")).alias("match"), F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("state"))


def consistency(rows: DataFrame, family: str, signature: list[str]) -> DataFrame:
    """(family, n, n_signatures, consistent): whether all members of a family have one signature."""
    found = rows.groupBy(family).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*signature)).alias("n_signatures"))
    return found.withColumn("consistent", F.col("n_signatures") == 1)


def common_entries(rows: DataFrame, group: str, entries: str) -> DataFrame:
    """(group, entry_key, entry_value): entries of a map column that all rows of a group share."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("members"))
    exploded = rows.select(group, F.explode(entries).alias("entry_key", "entry_value"))
    found = exploded.groupBy(group, "entry_key").agg(F.count("*").alias("n"), F.count_distinct("entry_value").alias("values"), F.min("entry_value").alias("entry_value"))
    return found.join(sizes, group).where("n = members AND values = 1").select(group, "entry_key", "entry_value")


def ranking_checks(rows: DataFrame) -> DataFrame:
    """(list_id, contiguous, non_increasing) of ranked lists (list_id, rank, score)."""
    w = Window.partitionBy("list_id").orderBy("rank", F.desc("score"))
    marked = rows.withColumn("rn", F.row_number().over(w)).withColumn("before", F.lag("score").over(w))
    return marked.groupBy("list_id").agg(F.bool_and(F.col("rank") == F.col("rn")).alias("contiguous"), F.bool_and(F.col("before").isNull() | (F.col("before") >= F.col("score"))).alias("non_increasing"))


def misaccounted(every: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(key, n): keys that aren't in exactly one part; keys outside ``every`` count as -1."""
    counts = reduce(DataFrame.unionAll, parts).groupBy(F.col(key).alias("p")).agg(F.count("*").alias("m"))
    rows = every.distinct().join(counts, F.col(key) == F.col("p"), "full")
    return rows.select(F.coalesce(key, "p").alias(key), F.when(F.col(key).isNull(), -1).otherwise(F.coalesce("m", F.lit(0))).cast("long").alias("n")).where("n <> 1")
