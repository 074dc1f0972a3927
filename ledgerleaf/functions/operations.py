"""The named operations as SQL table functions: Catalyst inlines them, so a lateral call for many rows is a join.

``register`` makes a temporary view of each table given and a function of each operation whose tables are there. Students
are those of facts; a curriculum's courses, rules and results are tables that the operators make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Views, and the columns that operations read.
TABLES = {
    "courses": {"curriculum": "string", "course": "long", "due": "int", "units": "double", "ord": "long"},
    "requirements": {"curriculum": "string", "course": "long", "needs": "long", "kind": "string"},
    "affected": {"curriculum": "string", "course": "long", "dependant": "long"},
    "outcomes": {"student": "long", "course": "long", "outcome": "string", "violated": "array<string>", "unknown": "array<string>"},
    "assessments": {"student": "long", "curriculum": "string", "due": "int", "course": "long", "retake": "boolean", "state": "string"},
    "earliest": {"student": "long", "course": "long", "state": "string", "slot": "long"},
    "verdicts": {"plan": "long", "term": "long", "outcome": "string", "load": "string"},
}
#: Operation: arguments, columns, the view it reads, and its rows.
OPERATIONS = {
    "course_facts": ("of_curriculum STRING, of_course BIGINT", "course BIGINT, due INT, units DOUBLE", "courses", "SELECT course, due, units FROM {t} WHERE curriculum = of_curriculum AND course = of_course"),
    "list_term_courses": ("of_curriculum STRING, in_term INT", "course BIGINT, units DOUBLE, ord BIGINT", "courses", "SELECT course, units, ord FROM {t} WHERE curriculum = of_curriculum AND due = in_term"),
    "list_course_prerequisites": ("of_curriculum STRING, of_course BIGINT", "needs BIGINT, kind STRING", "requirements", "SELECT DISTINCT needs, kind FROM {t} WHERE curriculum = of_curriculum AND course = of_course"),
    "list_affected_courses": ("of_curriculum STRING, of_course BIGINT", "dependant BIGINT", "affected", "SELECT dependant FROM {t} WHERE curriculum = of_curriculum AND course = of_course"),
    "check_prerequisite_eligibility": ("of_student BIGINT, of_course BIGINT", "outcome STRING, violated ARRAY<STRING>, unknown ARRAY<STRING>", "outcomes", "SELECT outcome, violated, unknown FROM {t} WHERE student = of_student AND course = of_course"),
    "list_missing_prerequisites": ("of_student BIGINT, of_course BIGINT", "condition STRING", "outcomes", "SELECT explode(array_union(violated, unknown)) FROM {t} WHERE student = of_student AND course = of_course"),
    "assess_term_prerequisites": ("of_student BIGINT, of_curriculum STRING, in_term INT", "course BIGINT, retake BOOLEAN, state STRING", "assessments", "SELECT course, retake, state FROM {t} WHERE student = of_student AND curriculum = of_curriculum AND due = in_term"),
    "earliest_course_term": ("of_student BIGINT, of_course BIGINT", "state STRING, slot BIGINT", "earliest", "SELECT state, slot FROM {t} WHERE student = of_student AND course = of_course"),
    "check_study_plan": ("of_plan BIGINT", "term BIGINT, outcome STRING, load STRING", "verdicts", "SELECT term, outcome, load FROM {t} WHERE plan = of_plan"),
}


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Registers the operations that ``tables`` allow, and returns their names, each with ``prefix`` before it."""
    unknown = sorted(set(tables) - set(TABLES))
    if unknown:
        raise ValueError(f"no operation reads {unknown}")
    for name, df in tables.items():
        lacking = sorted(set(TABLES[name]) - set(df.columns))
        if lacking:
            raise ValueError(f"{name} lacks {lacking}")
        df.select(*(F.col(c).cast(t).alias(c) for c, t in TABLES[name].items())).createOrReplaceTempView(f"{prefix}operations_{name}")
    made = []
    for name, (arguments, columns, view, rows) in OPERATIONS.items():
        if view in tables:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({columns}) RETURN {rows.format(t=f'{prefix}operations_{view}')}")
            made.append(prefix + name)
    return made
