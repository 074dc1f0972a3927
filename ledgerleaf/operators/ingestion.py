"""Reading printed requirements and tables: fragments, states, classes, fill-down, order and accounting of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.text import clean_text, compact_key, lab_free_key

#: Phrases that say there is no requirement, words of alternatives, and words of standing.
NONE_PHRASES = ["none", "n/a", "na", "no prerequisite", "nil"]
ALTERNATIVE = r"\b(or|either|any of|except(ion|ing)?|unless|equivalent|provided|if)\b"
STANDING = r"\b(standing|permission|consent|graduating)\b"


def fragments(cells: DataFrame) -> DataFrame:
    """(owner, pos, fragment): printed requirement cells (owner, cell) cut at commas, semicolons, ampersands, "and" and lines."""
    parts = F.split("cell", r"(?i)\s*(?:[,;&\n]|\band\b)\s*")
    return cells.select("owner", F.posexplode(parts).alias("pos", "fragment")).withColumn("fragment", clean_text(F.col("fragment"))).where("fragment <> ''")


def resolve(found: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds code to fragments: an exact code, else the only one of the same relaxed key, else none. Codes have code."""
    exact = codes.select(F.col("code").alias("e_code"), compact_key(F.col("code")).alias("e_key")).distinct()
    loose = codes.select("code", lab_free_key(F.col("code")).alias("l_key")).distinct().groupBy("l_key").agg(F.count("*").alias("n"), F.min("code").alias("l_code")).where("n = 1")
    one = exact.groupBy("e_key").agg(F.min("e_code").alias("e_code"))
    rows = found.withColumn("key", compact_key(F.col("fragment"))).withColumn("loose_key", lab_free_key(F.col("fragment")))
    rows = rows.join(one, F.col("key") == F.col("e_key"), "left").join(loose, F.col("loose_key") == F.col("l_key"), "left")
    return rows.select("owner", "pos", "fragment", F.coalesce("e_code", "l_code").alias("code"))


def requirement_states(cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """(owner, state, codes): the first that applies of blank_unreviewed, stated_none, alternative_or_exception,
    unresolved_reference, standing_condition, resolved and unreadable."""
    standing, open_ = F.col("fragment").rlike(f"(?i){STANDING}"), F.col("code").isNull()
    sums = resolved.groupBy("owner").agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.max(open_ & ~standing & ~F.lower("fragment").isin(NONE_PHRASES)).alias("open"),
        F.max(open_ & standing).alias("standing"),
    )
    rows = cells.join(sums, "owner", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    shown = F.lower(clean_text(F.coalesce("cell", F.lit(""))))
    state = (
        F.when(shown == "", "blank_unreviewed")
        .when(shown.isin(NONE_PHRASES) & (F.size("codes") == 0), "stated_none")
        .when(shown.rlike(ALTERNATIVE), "alternative_or_exception")
        .when(F.col("open"), "unresolved_reference")
        .when(F.col("standing"), "standing_condition")
        .when(F.size("codes") > 0, "resolved")
        .otherwise("unreadable")
    )
    return rows.select("owner", state.alias("state"), "codes")


def course_class(title: Column, code: Column) -> Column:
    """elective, practicum, thesis, laboratory or lecture, by the first that applies."""
    low, up = F.lower(title), F.upper(code)
    return F.when(low.contains("elective") | up.rlike(r"\bELECT(IVE)?\b"), "elective").when(low.rlike("practicum|internship"), "practicum").when(low.contains("thesis"), "thesis").when(low.contains("laboratory") | up.rlike("[0-9]L$"), "laboratory").otherwise("lecture")


def fill_down(rows: DataFrame, partition: list[str], order: list[str], value: str, stop: Column) -> DataFrame:
    """Carries a banner's value to the rows below it, within sections that begin where ``stop`` holds."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sections = rows.withColumn("section", F.sum(stop.cast("int")).over(w))
    inner = Window.partitionBy(*partition, "section").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sections.withColumn(value, F.last(value, ignorenulls=True).over(inner)).drop("section")


def unclaimed(printed: DataFrame, claimed: DataFrame) -> DataFrame:
    """Codes that a document prints (document, code) and no extracted row claims."""
    key = lambda df: df.select("document", compact_key(F.col("code")).alias("key")).distinct()
    return key(printed).join(key(claimed), ["document", "key"], "left_anti")


def reading_order(nodes: DataFrame) -> DataFrame:
    """(document, node, position): a document tree (document, node, parent, ordinal) from the root, children in order.

    Each node gets the path of its ancestors' ordinals, a level per join, and the paths are ranked within the document.
    A node that is already on the path is left out, so that cycles end.
    """
    from .common import cut

    nodes = cut(nodes.select("document", "node", "parent", "ordinal"))  # each level joins it, and a derived parent would be inferred anew
    path = F.array(F.struct("ordinal", "node"))
    level = cut(nodes.where("parent IS NULL").select("document", "node", path.alias("path")))
    every = level
    while True:
        kids = nodes.alias("n").join(level.alias("p"), (F.col("n.document") == F.col("p.document")) & (F.col("n.parent") == F.col("p.node")))
        kids = kids.where(~F.array_contains(F.col("p.path.node"), F.col("n.node")))
        level = cut(kids.select("n.document", "n.node", F.concat("p.path", F.array(F.struct("n.ordinal", "n.node"))).alias("path")))
        if level.isEmpty():
            break
        every = every.union(level)
    rank = F.row_number().over(Window.partitionBy("document").orderBy("path"))
    return every.select("document", "node", (rank - 1).alias("position"))


def aliases(entities: DataFrame) -> DataFrame:
    """(scope, alias, id): printed code, code without blanks, title and initials of entities, where unique in scope."""
    words = F.filter(F.split("title", " "), lambda w: w != "")
    forms = F.array(F.lower("code"), F.lower(F.regexp_replace("code", r"\s", "")), F.lower("title"), F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))
    each = entities.select("scope", "id", F.explode(F.array_distinct(forms)).alias("alias")).where("alias <> ''")
    found = each.groupBy("scope", "alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return found.where("n = 1").select("scope", "alias", "id")


def anchored(text: Column, quote: Column, start: Column) -> Column:
    """Where a quote lies in a text (from 0): at the offset given if it is there, else at its only occurrence, else null."""
    there = F.substring(text, start + 1, F.length(quote)) == quote
    first = F.locate(quote, text) if isinstance(quote, str) else F.call_function("locate", quote, text)
    second = F.call_function("locate", quote, text, first + 1)
    return F.when(F.length(quote) == 0, F.lit(None)).when(F.coalesce(there, F.lit(False)), start).when((first > 0) & (second == 0), first - 1)


#: Whole cells that state there is no requirement, as they read without dashes, marks and a final stop.
NO_REQUIREMENT = [
    "none", "nil", "na", "none required", "no prerequisite", "no prerequisites", "no pre requisite", "no pre requisites",
    "no prerequisite required", "no prerequisites required", "no pre requisite required", "no pre requisites required", "no prereq", "no prereqs",
]


def states_none(cell: Column) -> Column:
    """Whether a whole cell says that there is no requirement, in any spelling, or has dashes alone."""
    dashes = r"[\-‐-―−]"
    low = F.regexp_replace(F.replace(F.lower(clean_text(F.coalesce(cell, F.lit("")))), F.lit("(s)"), F.lit("s")), r"n\s*[/.]\s*a\b", "na")
    bare = F.regexp_replace(F.regexp_replace(low, rf"^({dashes}|\s)+|({dashes}|\s)+$", ""), rf"\.?({dashes}|\s)*$", "")
    words = F.regexp_replace(F.regexp_replace(bare, r"([a-z])-([a-z])", "$1 $2"), r"\s+", " ")
    return low.rlike(rf"^{dashes}({dashes}|\s)*\.?$") | words.isin(NO_REQUIREMENT)


def unit_parts(printed: Column) -> dict[str, Column]:
    """lecture, lab and total of a printed cell such as "3", "2/1", "(3 units)" or "23 3", where the first is a footnote mark."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(printed, F.lit("")), r"(?i)[()]|\bunits?\b", " "), r"\s+", " "))
    own = F.regexp_replace(flat, r"^\d{1,2} (?=\d{1,2}( ?/ ?\d{1,2})?$)", "")
    split, one = r"(\d{1,2}) ?/ ?(\d{1,2})", r"(\d{1,2})"
    pair = own.rlike(split)
    first = F.when(pair, F.regexp_extract(own, split, 1)).when(own.rlike(one), F.regexp_extract(own, one, 1)).cast("int")
    second = F.when(pair, F.regexp_extract(own, split, 2).cast("int")).when(first.isNotNull(), 0)
    return {"lecture": first, "lab": second, "total": first + second}


def units_in_title(title: Column, printed: Column) -> dict[str, Column]:
    """title and units where an empty cell's units stand at the title's end: a fraction, or the second of two numbers up to 6.

    One number alone belongs to the title; of two the first stays with it.
    """
    name, empty = clean_text(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(printed, F.lit(""))) == ""
    fraction, two = r"^(.*?)\s+(\d{1,2}\s*/\s*\d{1,2})$", r"^(.*?\s+\d{1,2})\s+([0-6])$"
    case = lambda a, b, rest: F.when(empty & name.rlike(fraction), a).when(empty & name.rlike(two), b).otherwise(rest)
    units = case(F.replace(F.regexp_extract(name, fraction, 2), F.lit(" "), F.lit("")), F.regexp_extract(name, two, 2), F.trim(F.coalesce(printed, F.lit(""))))
    return {"title": case(F.trim(F.regexp_extract(name, fraction, 1)), F.regexp_extract(name, two, 1), name), "units": units}


def course_category(code: Column, title: Column) -> Column:
    """The category of a course by its code and title; the four names are fixed values."""
    c, t = F.upper(clean_text(F.coalesce(code, F.lit("")))), F.upper(clean_text(F.coalesce(title, F.lit(""))))
    last = F.contains(c, F.lit("THESIS")) | F.contains(c, F.lit("PRACTICUM")) | F.contains(t, F.lit("THESIS"))
    return F.when(c.startswith("GE"), "General Education").when(c.rlike("^(NSTP|PATH|CWTS|ROTC)"), "NSTP / PATHFit").when(last, "Capstone / Practicum").otherwise("Core / Major")
