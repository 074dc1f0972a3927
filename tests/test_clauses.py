import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import clauses

KNOWN = set(clauses.KNOWN)


def says(text, words):
    return re.search(r"(?<![\w-])(?:" + "|".join(words) + r")(?![\w-])", text.replace("’", "'").lower())


def read(c):
    no = bool(says(c, clauses.NEGATION))
    if says(c, clauses.OTHER_PERSON):
        return "other_person"
    if says(c, clauses.UNSURE):
        return "taken_unknown" if says(c, clauses.TAKE + clauses.PASS) else "unsure"
    for words, yes, denied in ((clauses.FAIL, "failed", "failed"), (clauses.PASS, "passed", "not_passed"), (clauses.ENROLL, "enrolled", "not_enrolled"), (clauses.TAKE, "taken_unknown", "not_taken")):
        if words is clauses.FAIL and says(c, clauses.PASS) and no and says(c, clauses.YET):
            return "not_passed"
        if says(c, words):
            return denied if no else yes
    return None


def stated(text, first, last, course, others):
    starts = sorted({first} | {m.start() + first for m in re.finditer(clauses.BOUNDARY, text[first:last])})
    spans = list(zip(starts, [*starts[1:], last]))
    spans = [s for s in spans if s[0] < s[1]]
    own = [i for i, (a, b) in enumerate(spans) if a <= course < b or b == last][0]
    seen = [read(text[slice(*spans[own])])]
    for a, b in spans[own + 1 :]:
        if any(a <= s < b for s in [*others, course]):
            break
        seen.append(read(text[a:b]))
    told = [r for r in seen if r]
    if {"other_person", "unsure"} & set(told):
        return "taken_unknown" if "taken_unknown" in told else None
    sure = [r for r in told if r in KNOWN]
    if sure:
        return seen[0] if seen[0] in KNOWN else sure[-1]
    if told:
        return told[0]
    before = [r for r in (read(text[slice(*s)]) for s in spans[:own]) if r]
    return before[-1] if before and before[-1] not in ("other_person", "unsure") else None


PIECES = ["I ", "passed ", "failed ", "did not pass ", "ZZ 1", "ZZ 2", "ZZ 3", " and ", ", ", " but ", ". ", "took ", "not ", "yet ", "hindi pa ", "enrolled in ", "my friend ", "not sure ", "pumasa ", "didn’t take ", "tapos na ", "at ", "DROPPED ", "currently taking ", "å ", "😀 "]


def _claims(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, first int, last int, course int, others array<int>")


@pytest.mark.parametrize("seed", range(2))
def test_results_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    while len(rows) < 600:
        text = "".join(rng.choices(PIECES, k=rng.randint(2, 12)))
        courses = [m.start() for m in re.finditer(r"ZZ \d", text)]
        if courses:
            i, course = len(rows), rng.choice(courses)
            first, last = rng.choice([0, 0, min(2, course)]), len(text)
            rows.append((i, text, first, last, course, [c for c in courses if c != course]))
            want[i] = stated(*rows[-1][1:])
    got = {r.id: r.stated for r in clauses.stated_results(_claims(spark, rows)).collect()}
    assert got == want and {"passed", "failed", "not_passed", "not_taken", "enrolled", "taken_unknown", None} <= set(want.values())


def test_cases(spark):
    cases = [("I took ZZ 1 and passed", "passed"), ("I failed ZZ 2 and ZZ 1", "failed"), ("my friend passed ZZ 1", None), ("hindi ko pa napapasa ang ZZ 1", "not_passed"), ("I am not sure if I took ZZ 1", "taken_unknown"), ("ZZ 1 3.0", None), ("I passed ZZ 2 but failed ZZ 1", "failed"), ("", None)]
    rows = [(i, t, 0, len(t), max(t.find("ZZ 1"), 0), [t.find("ZZ 2")] if "ZZ 2" in t else []) for i, (t, _) in enumerate(cases)]
    assert {r.id: r.stated for r in clauses.stated_results(_claims(spark, rows)).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_premises_and_periods(spark):
    cases = [("What if I fail ZZ 1?", True), ("Kung bumagsak ako sa ZZ 1", True), ("If so, why. I failed ZZ 1", False), ("I failed ZZ 1. If so, what next?", False), ("Iffy ZZ 1", False)]
    rows = spark.createDataFrame([(i, t, t.index("ZZ 1")) for i, (t, _) in enumerate(cases)], "id long, text string, at int")
    assert {r.id: r.x for r in rows.select("id", clauses.inside_if_clause(F.col("text"), F.col("at")).alias("x")).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    periods = spark.createDataFrame([("enrolled next sem",), ("enrolled",), ("sa susunod na semester",)], "t string")
    assert [r[0] for r in periods.select(clauses.enrollment_period(F.col("t"))).collect()] == ["next", "current", "next"]
