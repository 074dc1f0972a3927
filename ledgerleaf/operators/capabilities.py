"""Named operations with fixed arguments, facts as rules see them, margins, clauses, boxes, ledgers put into effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_states(calls: DataFrame, signatures: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds state to calls (operation, arguments: a map of strings): unsupported, missing_argument, unknown_argument or ok.

    An operation takes its arguments by name, all of them and no others; an empty or null value is a missing one.
    """
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in signatures.items() for x in kv))
    rows = calls.withColumn("takes", F.element_at(known, F.col("operation")))
    given = F.map_keys(F.map_filter("arguments", lambda k, v: v.isNotNull() & (v != "")))
    state = F.when(F.col("takes").isNull(), "unsupported").when(F.size(F.array_except("takes", given)) > 0, "missing_argument").when(F.size(F.array_except(F.map_keys("arguments"), "takes")) > 0, "unknown_argument").otherwise("ok")
    return rows.withColumn("state", state).drop("takes")


#: What a stated state of a course is for a rule; what isn't here (such as taken without a result) says nothing.
RULE_STATES = {"passed": "passed", "failed": "failed", "not_passed": "failed", "not_taken": "failed", "enrolled": "enrolled", "not_enrolled": "not_enrolled"}


def rule_facts(stated: DataFrame) -> DataFrame:
    """(subject, passed, failed, enrolled, not_enrolled): sorted distinct courses of each, from (subject, course, state)."""
    state = F.element_at(F.create_map(*(F.lit(x) for kv in RULE_STATES.items() for x in kv)), F.col("state"))
    rows = stated.select("subject", "course", state.alias("rule_state"))
    return rows.groupBy("subject").agg(*(F.array_sort(F.collect_set(F.when(F.col("rule_state") == s, F.col("course")))).alias(s) for s in ("passed", "failed", "enrolled", "not_enrolled")))


def repeated_margins(lines: DataFrame, share: float = 0.1, least_pages: int = 3) -> DataFrame:
    """(doc, line, n_pages): lines that stand in the outer part of so many pages of a document: headers and footers.

    Lines have doc, page, place (from 0) and of (how many the page has); case, digits and white space don't count.
    """
    flat = F.regexp_replace(F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))), r"\d+", "#")
    outer = (F.col("place") < F.col("of") * share) | (F.col("place") >= F.col("of") * (1 - share))
    rows = lines.where(outer).select("doc", "page", flat.alias("line")).where("line <> ''")
    return rows.groupBy("doc", "line").agg(F.count_distinct("page").alias("n_pages")).where(F.col("n_pages") >= least_pages)


def clause_targets(clauses: DataFrame, partition: list[str], order: list[str], key: str, text: str) -> DataFrame:
    """Adds target: for a clause that begins with except, unless, provided or however, the last one before that doesn't."""
    opens = F.col(text).rlike(r"(?i)^\s*(except|unless|provided|however)\b")
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return clauses.withColumn("target", F.when(opens, F.last(F.when(~F.coalesce(opens, F.lit(False)), F.col(key)), ignorenulls=True).over(w)))


def enclosing_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One box around those of each group; with the origin at the bottom ("BOTTOMLEFT") a top is the larger number.

    Boxes of two origins in one group have no common box: its sides are null.
    """
    bottom = F.col("origin") == "BOTTOMLEFT"
    sums = boxes.groupBy(*keys).agg(F.min("left").alias("left"), F.max("right").alias("right"), F.max(F.when(bottom, F.col("top"))).alias("bt"), F.min(F.when(bottom, F.col("bottom"))).alias("bb"), F.min(F.when(~bottom, F.col("top"))).alias("tt"), F.max(F.when(~bottom, F.col("bottom"))).alias("tb"), F.count_distinct("origin").alias("n"))
    one = F.col("n") == 1
    side = lambda c: F.when(one, c)
    return sums.select(*keys, side(F.col("left")).alias("left"), side(F.col("right")).alias("right"), side(F.coalesce("bt", "tt")).alias("top"), side(F.coalesce("bb", "tb")).alias("bottom"))


def put_into_effect(rows: DataFrame, latest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the latest ledger decision (locator, field, new_value) of each field in place of what was printed."""
    pivot = latest.where(F.col("field").isin(fields)).groupBy("locator").agg(*(F.max(F.when(F.col("field") == f, F.col("new_value"))).alias(f"_{f}") for f in fields))
    joined = rows.join(pivot, F.col(key) == F.col("locator"), "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns), reduce(Column.__or__, (F.col(f"_{f}").isNotNull() for f in fields)).alias("decided"))


def request_status(requests: DataFrame, releases: DataFrame, fields: list[str]) -> DataFrame:
    """(request, status): release_changed unless just one release has the name asked for, configuration_mismatch where it
    differs in a field, else ok. Nulls are equal."""
    of = releases.groupBy("release").agg(F.count("*").alias("n"), *(F.first(f).alias(f"_{f}") for f in fields))
    rows = requests.join(of, "release", "left")
    same = reduce(Column.__and__, (F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields))
    return rows.select("request", F.when(F.coalesce("n", F.lit(0)) != 1, "release_changed").when(~same, "configuration_mismatch").otherwise("ok").alias("status"))


def release_curricula(members: DataFrame, ledgers: DataFrame, release: str, schema: str) -> DataFrame:
    """The ledgers (id, body as JSON) that a release has, with their bodies read; one that doesn't read is an error."""
    own = ledgers.join(members.where(F.col("release") == release).select("id"), "id", "left_semi")
    return own.select("id", F.from_json("body", schema, {"mode": "FAILFAST"}).alias("c")).select("id", "c.*")
