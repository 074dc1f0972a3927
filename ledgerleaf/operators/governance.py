"""Releases, ledgers and source states: violations as rows, compare-and-set as joins, never a change in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import top_rows


def visible(rows: DataFrame, members: DataFrame, key: str, state: Column) -> DataFrame:
    """Rows of the active release whose state allows them to be seen."""
    return rows.join(members.select(key).distinct(), key, "left_semi").where(state)


def violations(checks: dict[str, DataFrame], subject: str) -> DataFrame:
    """(check, subject): one row for each finding; a valid release has none."""
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("check"), F.col(subject).cast("string").alias("subject")) for name, df in checks.items()])


def latest_by_field(entries: DataFrame) -> DataFrame:
    """The last entry of each (locator, field) by (seq); an entry on the whole row counts for the three fields it covers."""
    fields = F.when(F.col("field") == "row", F.array(*(F.lit(x) for x in ("code", "title", "units")))).otherwise(F.array("field"))
    each = entries.withColumn("field", F.explode(fields))
    return top_rows(each, ["locator", "field"], [F.desc("seq")]).drop("_rank")


def classify_entries(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Adds class to ledger entries: other_document, orphan, stale or applied, against (locator, field, value, document)."""
    now = current.select("locator", "field", F.col("value").alias("now"), F.col("document").alias("own"))
    where = current.select("locator").distinct().withColumn("known", F.lit(True))
    docs = current.select("document").distinct().withColumn("ours", F.lit(True))
    rows = entries.join(now, ["locator", "field"], "left").join(where, "locator", "left").join(docs, "document", "left")
    kind = F.when(F.col("ours").isNull(), "other_document").when(F.col("known").isNull() | F.col("own").isNull(), "orphan").when(~F.col("now").eqNullSafe(F.col("old_value")), "stale").otherwise("applied")
    return rows.withColumn("class", kind).drop("now", "own", "known", "ours")


def transitions(asked: DataFrame, current: DataFrame, allowed: DataFrame) -> DataFrame:
    """(key, result): applied, replayed or a conflict, for each wish (key, expected, proposed) against (key, state).

    ``allowed`` has the from_state and to_state of legal steps. What is stored already is a success that changes nothing.
    """
    steps = allowed.select(F.col("from_state").alias("expected"), F.col("to_state").alias("proposed")).distinct().withColumn("legal", F.lit(True))
    rows = asked.join(current, "key", "left").join(steps, ["expected", "proposed"], "left")
    result = F.when(F.col("state").isNull(), "conflict_missing").when(F.col("state") == F.col("proposed"), "replayed").when(F.col("state") != F.col("expected"), "conflict_changed").when(F.col("legal").isNull(), "conflict_illegal").otherwise("applied")
    return rows.select("key", result.alias("result"))


def evidence_state(events: DataFrame, steps: dict[str, str], start: str) -> DataFrame:
    """(key, state): the state that a key's evidence reaches, event kinds taken in order of (at, seq).

    ``steps`` maps "from:kind" to the next state; evidence that isn't legal where it stands changes nothing.
    """
    table = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "kind"))), lambda e: e.kind)
    step = lambda s, k: F.coalesce(F.element_at(table, F.concat_ws(":", s, k)), s)
    return events.groupBy("key").agg(kinds.alias("kinds")).select("key", F.aggregate("kinds", F.lit(start), step).alias("state"))


def supersession_faults(register: DataFrame) -> DataFrame:
    """(code, subject) of (id, category, supersedes, superseded_by): links that aren't mutual, cross categories or fork."""
    other = register.select(F.col("id").alias("o_id"), F.col("category").alias("o_category"), F.col("superseded_by").alias("o_by"))
    linked = register.where("supersedes IS NOT NULL").join(other, F.col("supersedes") == F.col("o_id"), "left")
    forks = linked.withColumn("n", F.count("*").over(Window.partitionBy("supersedes"))).where("n > 1")
    checks = {
        "unknown_target": linked.where("o_id IS NULL"),
        "not_mutual": linked.where("o_id IS NOT NULL AND NOT (o_by <=> id)"),
        "other_category": linked.where("o_category <> category"),
        "several_successors": forks,
    }
    return violations(checks, "id").withColumnRenamed("check", "code")
