import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import sections


def read(symbols):
    """The roles of one table's rows, one after the other."""
    state, out = "none", []
    for x in symbols:
        was = state
        if x == "Y":
            state, role = "year", "year"
        elif x == "S":
            state, role = "open", "section"
        elif x in "CT" and was not in ("open", "course"):
            role = {"C": "stray_course", "T": "stray_total"}[x]
        elif x in "CT":
            state, role = {"C": ("course", "course"), "T": ("closed", "total")}[x]
        elif x == "X":
            role = "continuation" if was == "course" else "text"
        else:
            state, role = "open" if was == "course" else was, {"B": "blank", "H": "header"}[x]
        out.append(role)
    return out


@pytest.mark.parametrize("block", [2, 3, 64])
def test_blocks_equal_reading_in_order(spark, block):
    """Tables of every length from 1 to 40, so that blocks of all levels end at every place, and rows with gaps."""
    rng = random.Random(block)
    tables = {n: rng.choices("YSHCTXB", weights=[1, 2, 1, 6, 2, 4, 1], k=n) for n in range(1, 41)}
    rows = [(t, r + (7 if t % 5 == 0 and r > 3 else 0), x) for t, xs in tables.items() for r, x in enumerate(xs)]
    rng.shuffle(rows)
    got = {}
    for r in sections.row_roles(spark.createDataFrame(rows, "table_id long, row int, symbol string"), block).collect():
        got.setdefault(r.table_id, []).append((r.row, r.role))
    assert {t: [x for _, x in sorted(g)] for t, g in got.items()} == {t: read(xs) for t, xs in tables.items()}


def test_no_rows(spark):
    assert sections.row_roles(spark.createDataFrame([], "table_id long, row int, symbol string")).count() == 0


def test_kinds_of_cells(spark):
    cases = [("FIRST YEAR", "year_marker"), ("Year II", "year_marker"), ("2nd Semester", "semester_marker"), ("Summer", "semester_marker"), ("Course Code", "header"), ("Descriptive Title", "header"), ("Pre-requisite(s)", "header"), ("GRAND TOTAL 180", "program_total"), ("Total 21", "term_total"), ("IT 101", "course_code_candidate"), ("3/2", "unit_candidate"), ("Rizal's life", "unknown"), ("", None), (None, None)]
    rows = spark.createDataFrame([(1, i, 0, t) for i, (t, _) in enumerate(cases)], "table_id long, row int, col int, text string")
    assert [r.k for r in rows.orderBy("row").select(sections.cell_kind(F.col("text")).alias("k")).collect()] == [k for _, k in cases]
    assert "".join(r.symbol for r in sections.row_symbols(rows).orderBy("row").collect()) == "YYSSHHHTTCXXBB"
