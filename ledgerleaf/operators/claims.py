"""Claims against evidence: source limits, reviews, required neighbours, selection traces and final statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim_report(claims: DataFrame, limits: DataFrame, reviews: DataFrame, emitted: DataFrame) -> DataFrame:
    """(claim, status) of claims (claim, subject, required array): limits win, then reviews, then what is in context.

    ``limits`` names claims that a source leaves unresolved, ``reviews`` has claim and stated, ``emitted`` the chunk ids
    in context. Without a review a claim is unassessed.
    """
    limited = limits.select("claim").distinct().withColumn("limited", F.lit(True))
    judged = reviews.groupBy("claim").agg(F.bool_and("stated").alias("stated"))
    need = claims.select("claim", F.explode("required").alias("chunk"))
    missing = need.join(emitted.select(F.col("chunk").alias("chunk")).distinct(), "chunk", "left_anti").select("claim").distinct().withColumn("lacking", F.lit(True))
    rows = claims.join(limited, "claim", "left").join(judged, "claim", "left").join(missing, "claim", "left")
    status = (
        F.when(F.col("limited"), "insufficient_evidence")
        .when(F.col("stated").isNull(), "unassessed")
        .when(~F.col("stated"), "not_established")
        .when(F.col("lacking"), "reviewed_fields_not_in_context")
        .otherwise("reviewed_fields_available")
    )
    return rows.select("claim", "subject", status.alias("status"))


def subject_status(report: DataFrame) -> DataFrame:
    """(subject, status): the worst of a subject's claims in the order of severity."""
    order = ["insufficient_evidence", "not_established", "reviewed_fields_not_in_context", "unassessed", "reviewed_fields_available"]
    names = ["insufficient_evidence", "insufficient_evidence", "insufficient_context", "unassessed", "available"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    worst = report.groupBy("subject").agg(F.min(rank).alias("worst"))
    return worst.select("subject", F.element_at(F.array(*map(F.lit, names)), F.col("worst").cast("int")).alias("status"))


def selection_trace(required: Column, present: Column, emitted: Column) -> dict[str, Column]:
    """What a row requires that isn't known at all, and what is known but wasn't emitted, each sorted."""
    absent = F.array_sort(F.array_except(required, present))
    return {"absent": absent, "unemitted": F.array_sort(F.array_except(F.array_intersect(required, present), emitted))}


def bound(rows: DataFrame, prepared: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, bound): whether each row's content has the digest (key, digest) that was prepared for it."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    both = rows.select(key, digest.alias("own")).join(prepared.select(F.col(key).alias("p"), "digest"), F.col(key) == F.col("p"), "left")
    return both.select(key, F.coalesce(F.col("own") == F.col("digest"), F.lit(False)).alias("bound"))


def integrate(evidence: DataFrame) -> DataFrame:
    """(request, status, evidence_ids): the worst status of a request's parts, and all ids once, sorted.

    Parts of several releases, or one id with several contents, make the request inconsistent.
    """
    order = F.array(*map(F.lit, ["error", "unsupported", "unknown", "insufficient", "ok"]))
    sums = evidence.groupBy("request").agg(
        F.min_by("status", F.array_position(order, F.col("status"))).alias("worst"),
        F.count_distinct("release").alias("releases"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("id", "digest").alias("contents"),
        F.array_sort(F.collect_set("id")).alias("evidence_ids"),
    )
    status = F.when(F.col("releases") > 1, "release_changed").when(F.col("contents") > F.col("ids"), "conflicting_sources").otherwise(F.col("worst"))
    return sums.select("request", status.alias("status"), "evidence_ids")
