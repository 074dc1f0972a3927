"""Evaluation metrics: classification, rubric scores, exam grading, recognition scores, case-set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.text import hash_split, tokens

from .common import ratio

DECIDED = {"eligible": "approve", "ineligible": "deny"}


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per expected class (label, support, precision, recall, f1), from rows of expected and predicted.

    Classes that are only predicted have no row; a denominator of nothing gives null. One aggregation over a row's two
    labels, no self-join.
    """
    hit = F.col("expected") == F.col("predicted")
    both = pairs.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p"), hit.cast("int").alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("e").alias("support"), F.sum("p").alias("said"), F.sum("t").alias("right")).where("support > 0")
    f1 = ratio(2 * F.col("right"), F.col("support") + F.col("said"))
    return sums.select("label", "support", ratio(F.col("right"), F.col("said")).alias("precision"), ratio(F.col("right"), F.col("support")).alias("recall"), f1.alias("f1"))


def macro(metrics: DataFrame) -> DataFrame:
    """(n_classes, accuracy, macro_f1): a class without an F1 counts as 0."""
    return metrics.agg(F.count("*").alias("n_classes"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))


def retrieval_case(found: Column, relevant: Column, searches: Column) -> dict[str, Column]:
    """Precision over three slots a search, precision over what came back, recall, F1 and whether anything was right."""
    hits = F.size(F.array_intersect(found, relevant))
    precision, recall = hits / (3 * F.greatest(searches, F.lit(1))), ratio(hits, F.size(relevant))
    returned = ratio(hits, F.size(found))
    f1 = F.when((returned + recall) > 0, 2 * returned * recall / (returned + recall)).otherwise(0.0)
    return {"precision": precision, "returned_precision": returned, "recall": recall, "f1": f1, "hit": hits > 0}


def rubric(rows: DataFrame) -> DataFrame:
    """Adds flags (sorted) and critical to rows of gold and output.

    Expects gold_route, route, gold_outcome, outcome, gold_spans, spans, gold_language, language, allowed and claims
    (arrays) and error (boolean). Unknown outcomes are neither an approval nor a denial.
    """
    stand = lambda c: F.when(c == "eligible", "approve").when(c == "ineligible", "deny")
    gold, said = stand(F.col("gold_outcome")), stand(F.col("outcome"))
    false_yes, false_no = (said == "approve") & ~gold.eqNullSafe("approve"), (said == "deny") & ~gold.eqNullSafe("deny")
    abstained = gold.isNotNull() & said.isNull()
    wrong = [F.coalesce(x, F.lit(False)) for x in (false_yes, false_no, abstained)]
    named = {
        "route_mismatch": F.col("gold_route") != F.col("route"),
        "silent_fallback": (F.col("gold_route") != "documents") & (F.col("route") == "documents"),
        "missing_gold_span": F.size(F.array_except("gold_spans", "spans")) > 0,
        "extra_span": F.size(F.array_except("spans", "gold_spans")) > 0,
        "false_approval": wrong[0],
        "false_denial": wrong[1],
        "false_abstention": wrong[2],
        "error_as_policy": said.isNotNull() & F.col("error"),
        "unexpected_outcome": F.col("gold_outcome").isNull() & F.col("outcome").isNotNull(),
        "outcome_mismatch": ~F.col("gold_outcome").eqNullSafe(F.col("outcome")) & F.col("gold_outcome").isNotNull() & ~(wrong[0] | wrong[1] | wrong[2]),
        "language_mismatch": F.col("gold_language") != F.col("language"),
        "unsupported_claim": F.size(F.array_except("claims", "allowed")) > 0,
    }
    flags = F.array_sort(F.array_compact(F.array(*(F.when(c, k) for k, c in named.items()))))
    critical = F.arrays_overlap("flags", F.array(*(F.lit(x) for x in ("false_approval", "false_denial", "error_as_policy", "unsupported_claim"))))
    return rows.withColumn("flags", flags).withColumn("critical", critical)


#: What each axis of a rubric is lost by.
AXES = {
    "routing": ("route_mismatch", "silent_fallback"),
    "evidence": ("missing_gold_span", "extra_span"),
    "decision": ("false_approval", "false_denial", "false_abstention", "error_as_policy", "unexpected_outcome", "outcome_mismatch"),
    "claims": ("unsupported_claim",),
    "wording": ("language_mismatch",),
}


def rubric_totals(rows: DataFrame) -> DataFrame:
    """Adds the five axes and total to the rows of ``rubric``: an axis is 1 without any of its flags, else 0.

    The decision axis is null where neither side has an outcome. The total is the mean of the axes that aren't null, and
    0 with a critical flag.
    """
    hit = lambda names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    rows = rows.withColumns({a: F.when(hit(names), 0.0).otherwise(1.0) for a, names in AXES.items()})
    rows = rows.withColumn("decision", F.when(F.col("gold_outcome").isNotNull() | F.col("outcome").isNotNull(), F.col("decision")))
    axes = F.array_compact(F.array(*AXES))
    mean = F.aggregate(axes, F.lit(0.0), lambda a, x: a + x) / F.size(axes)
    return rows.withColumn("total", F.when(F.col("critical"), 0.0).otherwise(mean))


def exam_grade(required: Column, supplied: Column, allowed: Column, answer_right: Column, control_right: Column) -> dict[str, Column]:
    """An item is right if answer, control and sources are: all required ones are supplied, and only allowed ones."""
    source = (F.size(F.array_except(required, supplied)) == 0) & (F.size(F.array_except(supplied, allowed)) == 0)
    return {"source_right": source, "item_right": answer_right & control_right & source}


def recognition(pairs: DataFrame, document: str) -> DataFrame:
    """Per document: exact rate, character error rate, silent errors and verdict, from rows of reference, candidate and flagged.

    A pair that lacks one side counts all its characters as errors.
    """
    ref, got = F.coalesce("reference", F.lit("")), F.coalesce("candidate", F.lit(""))
    wrong = ref != got
    sums = pairs.groupBy(document).agg(F.count("*").alias("n"), F.sum((~wrong).cast("long")).alias("exact"), F.sum(F.levenshtein(ref, got)).alias("edits"), F.sum(F.length(ref)).alias("chars"), F.sum((wrong & ~F.col("flagged")).cast("long")).alias("silent"))
    verdict = F.when(F.col("silent") > 0, "unsafe").when(F.col("exact") == F.col("n"), "exact").otherwise("flagged")
    return sums.select(document, "n", ratio(F.col("exact"), F.col("n")).alias("exact_rate"), ratio(F.col("edits"), F.col("chars")).alias("cer"), "silent", verdict.alias("verdict"))


def case_set_findings(cases: DataFrame, salt: str, percent: int) -> DataFrame:
    """(code, subject): cases whose split isn't the one their group's hash gives, groups in both splits or in several
    categories, and case ids used twice. Cases have case_id, split (final or dev), family and category."""
    derived = F.when(hash_split(salt, F.col("family"), percent), "final").otherwise("dev")
    by_family = cases.groupBy("family").agg(F.count_distinct("split").alias("splits"), F.count_distinct("category").alias("categories"))
    found = [
        cases.where(~derived.eqNullSafe(F.col("split"))).select(F.lit("split_not_derived").alias("code"), F.col("case_id").cast("string").alias("subject")),
        by_family.where("splits > 1").select(F.lit("family_in_both_splits").alias("code"), F.col("family").alias("subject")),
        by_family.where("categories > 1").select(F.lit("family_mixes_categories").alias("code"), F.col("family").alias("subject")),
        cases.groupBy("case_id").count().where("count > 1").select(F.lit("case_id_twice").alias("code"), F.col("case_id").cast("string").alias("subject")),
    ]
    return reduce(DataFrame.unionAll, found)


def leaks(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): items whose tokens, as a run at token boundaries, occur in a text.

    An item's rarest token finds the texts that could hold it (an equi-join), then the run is tested. Empty items leak
    nowhere. Frequencies count over all texts.
    """
    own = items.select("item_id", tokens(F.col("text")).alias("t")).where("size(t) > 0")
    tok = texts.select("doc_id", F.sha2("text", 256).alias("copy"), tokens(F.col("text")).alias("t"))
    distinct = tok.select("copy", "t").dropDuplicates(["copy"])
    wanted = own.select(F.explode("t").alias("token")).distinct()
    seen = distinct.select("copy", F.explode(F.array_distinct("t")).alias("token")).join(wanted, "token", "left_semi")
    often = seen.groupBy("token").agg(F.count("*").alias("n"))
    rare = own.select("item_id", F.explode(F.array_distinct("t")).alias("token")).join(often, "token", "left").na.fill(0, ["n"])
    rare = rare.groupBy("item_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    near = rare.join(seen, "token").select("item_id", "copy")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    held = near.join(own.select("item_id", padded(F.col("t")).alias("run")), "item_id").join(distinct.select("copy", padded(F.col("t")).alias("all")), "copy").where(F.expr("contains(all, run)"))
    return held.select("item_id", "copy").join(tok.select("copy", "doc_id"), "copy").select("item_id", "doc_id")
