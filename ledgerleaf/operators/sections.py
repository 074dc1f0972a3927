"""Rows of long tables read by a finite-state transducer, as a segmented scan: no table needs a single task.

What a row is depends on those above it (a text below a course goes on with it, a total closes a section). Each block of
rows gives a map from the state before it to the state after it; maps of blocks are composed in a tree of blocks; then
each block's own start is known, and its rows are run through once more, all blocks at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.text import clean_text

from .common import stored
from .grids import code_like, unit_like

#: Rows of a block, and blocks of a block of the next level.
BLOCK = 64
START = "none"
STATES = ["none", "year", "open", "course", "closed"]
#: (state, symbol) -> (state after it, what the row is). Symbols: Y year, S semester, H header, C code, T total, X other
#: text, B blank. Where a state isn't named, the row changes nothing and is what DEFAULT says.
MOVES = {
    **{(s, "Y"): ("year", "year") for s in STATES},
    **{(s, "S"): ("open", "section") for s in STATES},
    **{(s, "C"): ("course", "course") for s in ("open", "course")},
    **{(s, "T"): ("closed", "total") for s in ("open", "course")},
    ("course", "X"): ("course", "continuation"),
    ("course", "B"): ("open", "blank"),
    ("course", "H"): ("open", "header"),
}
DEFAULT = {"H": "header", "C": "stray_course", "T": "stray_total", "X": "text", "B": "blank"}
#: What a cell says.
YEAR = r"(?i)^(?:(?:first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th)\s+year|year\s+(?:[1-5]|i{1,3}|iv|v))\b"
SEMESTER = r"(?i)^(?:(?:first|second|1st|2nd)\s+(?:semester|sem|trimester|term)|summer|mid-?year)\b"
GRAND_TOTAL = r"(?i)\b(?:grand\s+total|total\s+(?:number\s+of\s+)?units\s+for\s+the\s+(?:program|course))\b"
TOTAL = r"(?i)^\s*(?:sub)?total\b"


def header_kind(text: Column) -> Column:
    """What a cell names as a column's head: code, grade, title, units, prereq, or null."""
    t = F.regexp_replace(F.lower(clean_text(text)), "[^a-z]", "")
    has = lambda *words: F.lit(False) if not words else t.rlike("|".join(words))
    return F.when(has("code") | t.isin("course", "courses"), "code").when(has("grade"), "grade").when(has("title", "descriptive", "subject"), "title").when(has("unit", "credit"), "units").when(has("prereq", "^pre.*req"), "prereq")


def cell_kind(text: Column) -> Column:
    """year_marker, semester_marker, header, program_total, term_total, course_code_candidate, unit_candidate, unknown; null for a blank."""
    t = clean_text(text)
    return (
        F.when(t.isNull() | (t == ""), None)
        .when(t.rlike(YEAR), "year_marker")
        .when(t.rlike(SEMESTER), "semester_marker")
        .when(t.rlike(GRAND_TOTAL), "program_total")
        .when(t.rlike(TOTAL), "term_total")
        .when(code_like(text), "course_code_candidate")
        .when(header_kind(text).isNotNull(), "header")
        .when(unit_like(text), "unit_candidate")
        .otherwise("unknown")
    )


def row_symbols(cells: DataFrame) -> DataFrame:
    """(table_id, row, symbol) of cells (table_id, row, col, text): the strongest thing that a cell of the row says."""
    kind = cell_kind(F.col("text"))
    order = {"year_marker": "0Y", "semester_marker": "1S", "program_total": "2T", "term_total": "2T", "course_code_candidate": "3C", "header": "4H", "unknown": "5X", "unit_candidate": "5X"}
    symbol = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[kind]
    return cells.groupBy("table_id", "row").agg(F.substring(F.coalesce(F.min(symbol), F.lit("9B")), 2, 1).alias("symbol"))


def _literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _after(state: Column, symbol: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal({f"{s}|{x}": to for (s, x), (to, _) in MOVES.items()}), F.concat_ws("|", state, symbol)), state)


def _role(state: Column, symbol: Column) -> Column:
    own = F.try_element_at(_literal({f"{s}|{x}": role for (s, x), (_, role) in MOVES.items()}), F.concat_ws("|", state, symbol))
    return F.coalesce(own, F.try_element_at(_literal(DEFAULT), symbol))


def row_roles(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(table_id, row, symbol, role): what each row is in its table, given the rows before it.

    Rows are (table_id, row, symbol), row numbers unique in a table and not negative; gaps between them are fine. The result
    is that of reading each table from its first row on; blocks only say where the work is done.
    """
    kind = "array<struct<row:bigint,symbol:string>>"
    leaf = rows.select("table_id", F.col("row").cast("long").alias("row"), "symbol", F.floor(F.col("row") / block).cast("long").alias("block"))
    leaf = stored(leaf.groupBy("table_id", "block").agg(F.array_sort(F.collect_list(F.struct("row", "symbol"))).cast(kind).alias("rows")))
    states = F.array(*map(F.lit, STATES))
    at = lambda state: F.array_position(states, state).cast("int") - 1
    ends = F.transform(states, lambda s: F.aggregate("rows", s, lambda st, r: _after(st, r.symbol)))
    levels = [stored(leaf.select("table_id", "block", ends.alias("ends")))]
    while True:  # as many levels as the logarithm of the longest table
        top = levels[-1].agg(F.max("block")).first()[0]
        if not top:
            break
        up = levels[-1].groupBy("table_id", F.floor(F.col("block") / block).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("below"))
        ends = F.transform(states, lambda s: F.aggregate("below", s, lambda st, b: F.get(b.ends, at(st))))
        levels.append(stored(up.select("table_id", F.col("up").alias("block"), ends.alias("ends"), "below")))
    starts = levels[-1].select("table_id", "block", F.lit(START).alias("start"))
    for level in reversed(levels[1:]):
        inner = level.join(starts, ["table_id", "block"])
        seen = "struct<state:string,out:array<struct<block:bigint,start:string>>>"
        first = F.struct(F.col("start").alias("state"), F.array().cast("array<struct<block:bigint,start:string>>").alias("out")).cast(seen)
        run = F.aggregate("below", first, lambda a, b: F.struct(F.get(b.ends, at(a.state)).alias("state"), F.concat(a.out, F.array(F.struct(b.block.alias("block"), a.state.alias("start")))).alias("out")).cast(seen))
        starts = stored(inner.select("table_id", F.inline(run.out)).select("table_id", "block", "start"))
    seen = "struct<state:string,out:array<struct<row:bigint,symbol:string,role:string>>>"
    first = F.struct(F.col("start").alias("state"), F.array().cast("array<struct<row:bigint,symbol:string,role:string>>").alias("out")).cast(seen)
    step = lambda a, r: F.struct(_after(a.state, r.symbol).alias("state"), F.concat(a.out, F.array(F.struct(r.row.alias("row"), r.symbol.alias("symbol"), _role(a.state, r.symbol).alias("role")))).alias("out")).cast(seen)
    return leaf.join(starts, ["table_id", "block"]).select("table_id", F.inline(F.aggregate("rows", first, step).out))
