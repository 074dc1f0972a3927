"""Review tables, Markdown twins and rule facts as text files, written by Spark's own commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_review_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """The fixed columns of a review view with a header; lists are joined by "; ", quotes doubled."""
    shown = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.select(*columns).dtypes]
    rows.select(*shown).write.option("header", "true").option("escape", '"').csv(path)


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a Markdown table row, pipes and line breaks escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), "[\r\n]+", "<br>")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("line"))


def atom(value: Column) -> Column:
    """A quoted atom of a rule language: quotes and backslashes doubled."""
    return F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\\", r"\\\\"), "'", "''"), F.lit("'"))


def fact_lines(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(line): each row as a fact, ``name('a', 'b').``"""
    return rows.select(F.concat(F.lit(f"{name}("), F.concat_ws(", ", *(atom(F.col(c)) for c in columns)), F.lit(").")).alias("line"))


def publish(parts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each table below ``folder``, then a manifest of all files' digests as the last; returns the manifest.

    Without the manifest a folder isn't published: a run that ends early leaves none.
    """
    for name, rows in parts.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark = next(iter(parts.values())).sparkSession
    _digests(spark, folder, list(parts)).write.mode("errorifexists").parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def _digests(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{folder}/{n}" for n in names])
    return files.select(F.element_at(F.split("path", "/"), -2).alias("part"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def altered(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(part, file, fault): files that a published folder's manifest lacks, has with another digest, or has alone."""
    had = spark.read.parquet(f"{folder}/_manifest").select("part", "file", F.col("sha256").alias("was"))
    now = _digests(spark, folder, names).select("part", "file", F.col("sha256").alias("is"))
    fault = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "missing").when(F.col("was") != F.col("is"), "altered")
    return had.join(now, ["part", "file"], "full").select("part", "file", fault.alias("fault")).where("fault IS NOT NULL")
