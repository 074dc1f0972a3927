"""What a student's own words say of a course: clauses of a claim read one by one, then put together around the course.

English, Filipino and both mixed. All of it is expressions over arrays of clauses, for any number of claims at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a clause begins, and the words that carry a result.
BOUNDARY = r",|;|\.|\b(?:but|pero|tapos|kaso|however|though|although|while|and|at|saka)\b"
UNSURE = [r"(?:do not|don't|dont) know", "not sure", r"(?:hindi|di) ko (?:pa )?(?:alam|sure)", "ewan"]
FAIL = ["failed", "fail", "failing", "flunked", "flunk", "bagsak", "bumagsak", "binagsak", "ibinagsak", "nabagsak", r"(?:did not|didn't|didnt) pass", r"(?:hindi|di) (?:ako )?(?:pumasa|nakapasa)"]
PASS = ["pass(?:ed)?", "pasado", "pumasa", "nakapasa", "napasa", "naipasa", "napapasa", "naipapasa", "nakakapasa", "complet(?:ed|e)", "finish(?:ed)?", "natapos", "tapos na"]
ENROLL = ["enroll(?:ed|ing)?", "naka-?enroll", "currently taking", "taking", "kinukuha", "nag-?ta-?take", "tinitake"]
TAKE = ["take[n]?", "took", "natake", "natatake", "nakuha", "nakukuha", "kinuha", "kumuha", "nag-?take", "i-?take"]
NEGATION = ["not", r"\w+n't", "never", "no", "hindi", "di", "wala", "hnd", "nope"]
YET = ["yet", "pa"]
OTHER_PERSON = ["friend", "friends", "classmate", "blockmate", "he", "she", "they", "kaibigan", "kaklase", "siya", "sila", "kuya", "ate", "tropa"]
PREMISE = ["if", "what if", "kung", "kapag", "pag", "assuming", "suppose", "supposing", "halimbawa"]
NEXT_TERM = [r"(?:next|susunod na|upcoming) (?:sem|semester|term|trimester)"]
#: States that settle a result.
KNOWN = ["passed", "failed", "not_passed", "not_taken", "enrolled", "not_enrolled"]


def _says(text: Column, words: list[str]) -> Column:
    return text.rlike(rf"(?U)(?<![\w-])(?:{'|'.join(words)})(?![\w-])")


def _lower(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("’"), F.lit("'")))


def clause_reading(clause: Column) -> Column:
    """One clause's result, other_person, unsure, or null; what comes first here outranks what follows."""
    t = _lower(clause)
    says = lambda words: _says(t, words)
    negated = says(NEGATION)
    either = lambda no, yes: F.when(negated, no).otherwise(yes)
    return (
        F.when(says(OTHER_PERSON), "other_person")
        .when(says(UNSURE), F.when(says(TAKE) | says(PASS), "taken_unknown").otherwise("unsure"))
        .when(says(PASS) & negated & says(YET), "not_passed")
        .when(says(FAIL), "failed")
        .when(says(PASS), either("not_passed", "passed"))
        .when(says(ENROLL), either("not_enrolled", "enrolled"))
        .when(says(TAKE), either("not_taken", "taken_unknown"))
    )


def inside_if_clause(text: Column, course_start: Column) -> Column:
    """Whether a course stands after an if of its own sentence: a premise, not a report."""
    before = F.regexp_extract(F.substring(text, F.lit(1), course_start), r"[^.?!]*\z", 0)
    return _says(_lower(before), PREMISE)


def enrollment_period(text: Column) -> Column:
    return F.when(_says(_lower(text), NEXT_TERM), "next").otherwise("current")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stated_results(claims: DataFrame) -> DataFrame:
    """Adds ``stated`` to claims: the state that the words from ``first`` to ``last`` give the course at ``course``, or null.

    Claims have text, first and last (a half-open span of code points), course, and others (starts of other courses). The
    course's own clause counts, and those after it up to one that names a course; a clause that only names the course
    takes the result of the one that governs it. Doubt and other persons give no result, or taken_unknown.
    """
    span = F.substring(F.col("text"), F.col("first") + 1, F.col("last") - F.col("first"))
    parts = F.filter(F.split(span, f"(?={BOUNDARY})"), lambda p: p != "")
    kind = "array<struct<begin:int,stop:int,reading:string>>"
    placed = F.aggregate(parts, F.array().cast(kind), lambda done, p: _let(F.when(F.size(done) > 0, F.element_at(done, -1).stop).otherwise(F.col("first").cast("int")), lambda at: F.concat(done, F.array(F.struct(at.alias("begin"), (at + F.length(p)).alias("stop"), clause_reading(p).alias("reading"))).cast(kind))))
    rows = claims.withColumn("_clauses", placed)
    cs, course, last = F.col("_clauses"), F.col("course"), F.col("last")
    at = F.array_min(F.filter(F.transform(cs, lambda c, i: F.when(((c.begin <= course) & (course < c.stop)) | (c.stop == last), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("_at", at)
    at = F.col("_at")
    names = lambda c: F.exists("others", lambda s: (c.begin <= s) & (s < c.stop)) | ((c.begin <= course) & (course < c.stop))
    stop = F.coalesce(F.array_min(F.filter(F.transform(cs, lambda c, i: F.when((i > at) & names(c), i)), lambda i: i.isNotNull())), F.size(cs))
    rows = rows.withColumns({"_own": F.get(cs, at).reading, "_found": F.filter(F.transform(F.slice(cs, at + 1, stop - at), lambda c: c.reading), lambda r: r.isNotNull())})
    found, own = F.col("_found"), F.col("_own")
    decisive = F.filter(found, lambda r: r.isin(KNOWN))
    doubt = lambda r: r.isin("other_person", "unsure")
    governs = F.try_element_at(F.filter(F.transform(F.slice(cs, 1, at), lambda c: c.reading), lambda r: r.isNotNull()), F.lit(-1))
    stated = (
        F.when(F.exists(found, doubt), F.when(F.array_contains(found, "taken_unknown"), "taken_unknown"))
        .when(F.size(decisive) > 0, F.when(own.isNull() | (own == "taken_unknown"), F.try_element_at(decisive, F.lit(-1))).when(own.isin(KNOWN), own).otherwise(F.get(decisive, F.lit(0))))
        .when(F.size(found) > 0, F.get(found, F.lit(0)))
        .otherwise(F.when(~doubt(governs), governs))
    )
    return rows.withColumn("stated", F.when(F.size(cs) > 0, stated)).drop("_clauses", "_at", "_own", "_found")
