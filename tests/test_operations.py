import pytest

from ledgerleaf.functions import operations

DATA = {
    "courses": [("c", 1, 0, 3.0, 0), ("c", 2, 1, None, 1), ("d", 1, 4, 2.0, 0)],
    "requirements": [("c", 2, 1, "course"), ("c", 2, 1, "course")],
    "affected": [("c", 1, 2)],
    "outcomes": [(7, 2, "unknown", ["not_completed:3"], ["completion_unknown:1"])],
    "assessments": [(7, "c", 1, 2, False, "needs_info")],
    "earliest": [(7, 2, "found", 4)],
    "verdicts": [(5, 1, "works", "within"), (5, 2, "blocked", "over"), (6, 1, "works", "within")],
}
CALLS = {
    "course_facts('c', 2)": [(2, 1, None)],
    "course_facts('x', 2)": [],
    "list_term_courses('c', 0)": [(1, 3.0, 0)],
    "list_course_prerequisites('c', 2)": [(1, "course")],
    "list_affected_courses('c', 1)": [(2,)],
    "check_prerequisite_eligibility(7, 2)": [("unknown", ["not_completed:3"], ["completion_unknown:1"])],
    "list_missing_prerequisites(7, 2)": [("completion_unknown:1",), ("not_completed:3",)],
    "assess_term_prerequisites(7, 'c', 1)": [(2, False, "needs_info")],
    "earliest_course_term(7, 2)": [("found", 4)],
    "check_study_plan(5)": [(1, "works", "within"), (2, "blocked", "over")],
}


def _tables(spark):
    return {n: spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in operations.TABLES[n].items())) for n, rows in DATA.items()}


def test_every_operation_by_sql(spark):
    assert operations.register(spark, _tables(spark)) == [*operations.OPERATIONS]
    assert {c.split("(")[0] for c in CALLS} == set(operations.OPERATIONS)
    for call, want in CALLS.items():
        assert sorted(map(tuple, spark.sql(f"SELECT * FROM {call}").collect())) == want
    rows = spark.sql("SELECT c.curriculum, c.course, p.needs FROM operations_courses c, LATERAL list_course_prerequisites(c.curriculum, c.course) p").collect()
    assert list(map(tuple, rows)) == [("c", 2, 1)]


def test_only_what_the_tables_allow(spark):
    some = _tables(spark)
    assert operations.register(spark, {"verdicts": some["verdicts"]}, "x_") == ["x_check_study_plan"]
    with pytest.raises(ValueError, match="lacks"):
        operations.register(spark, {"verdicts": some["verdicts"].drop("load")})
    with pytest.raises(ValueError, match="no operation"):
        operations.register(spark, {"other": some["verdicts"]})
