"""Tables of cells: which columns belong together, for every table at once.

Scores of columns are sums over cells. All cuts of a table into one or two groups are then compared as arrays of
candidates, whose size is that of the table's columns, whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.text import clean_text

#: What a course code looks like, words that no code has, and what a number of units looks like.
CODE = r"(?i)^(?:[A-Za-z]{1,8}[\s\-]*(?:Fit\s*)?\d{1,4}[A-Za-z]?|[A-Za-z]{1,4}\s*\d{3,4}|GE[\s\-]+[A-Za-z]{2,6})$"
NO_CODE = r"(?i)\b(TOTAL|SUBTOTAL|YEAR|SEMESTER|DOC\.?|REF\.?|REVISION|EFFECTIVE|NOTE|ITALICS|SPECIALIZATION|UNITS?|GRADE|HOURS|PAGE|CAMPUS|CHED|CMO|RESOLUTION|BOR|STUDIES\s*\d+\s*TOTAL)\b"
UNITS = r"^\d{1,2}(?:\s*/\s*\d{1,2})?$"
LONGEST_CODE = 25
#: Two groups lie side by side if their columns are so far apart; a table of so few rows needs one code in a column, not two.
APART, FEW_ROWS, WIDE = 3, 8, 6
GROUP = "array<struct<code_idx:int,title_idx:int,unit_idx:int,prereq_idx:int>>"


def code_like(text: Column) -> Column:
    t = clean_text(text)
    return F.coalesce((F.length(t) <= LONGEST_CODE) & ~t.rlike(NO_CODE) & t.rlike(CODE), F.lit(False))


def unit_like(text: Column) -> Column:
    return F.coalesce(clean_text(text).rlike(UNITS), F.lit(False))


def column_scores(cells: DataFrame) -> DataFrame:
    """(table_id, n_rows, codes, units): how many cells of each column look like a code, and like a number of units.

    Cells have table_id, row, col (both from 0) and text. A hot table is summed where its rows lie, before it is dealt.
    """
    one = cells.groupBy("table_id", "col").agg(F.count_if(code_like(F.col("text"))).alias("codes"), F.count_if(unit_like(F.col("text"))).alias("units"), (F.max("row") + 1).alias("n"))
    each = one.groupBy("table_id").agg(F.max("n").alias("n_rows"), (F.max("col") + 1).cast("int").alias("n_cols"), F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int").alias("key"), F.struct("codes", "units").alias("value")))).alias("by"))
    row = lambda name: F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.try_element_at("by", c)[name], F.lit(0)))
    return each.select("table_id", "n_rows", row("codes").alias("codes"), row("units").alias("units"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _best(scores: Column, low: Column, high: Column, otherwise: Column, *more: Callable[[Column], Column]) -> Column:
    """The first column of the highest score above nothing in [low, high), by what else is given among equal ones."""
    keyed = F.transform(F.filter(F.sequence(F.lit(0), F.size(scores) - 1), lambda c: (c >= low) & (c < high) & (F.get(scores, c) > 0)), lambda c: F.struct(F.get(scores, c).alias("s"), *(m(c).alias(f"m{i}") for i, m in enumerate(more)), (-c).alias("c")))
    return F.coalesce(-F.array_max(keyed)["c"], otherwise)


def _pair(scores: Column, open_at: Callable[[Column], Column]) -> Column:
    """The two columns, APART or farther, whose scores have the largest sum, the first of equal ones; null without any."""
    columns = F.filter(F.sequence(F.lit(0), F.size(scores) - 1), open_at)
    pairs = F.flatten(F.transform(columns, lambda a: F.transform(F.filter(columns, lambda b: b - a >= APART), lambda b: F.struct((F.get(scores, a) + F.get(scores, b)).alias("s"), (-a).alias("a"), (-b).alias("b")))))
    return F.array_max(pairs)


def _group(code: Column, title: Column, unit: Column, prereq: Column) -> Column:
    return F.struct(code.cast("int").alias("code_idx"), title.cast("int").alias("title_idx"), unit.cast("int").alias("unit_idx"), prereq.cast("int").alias("prereq_idx"))


def column_groups(scores: DataFrame) -> DataFrame:
    """(table_id, group, code_idx, title_idx, unit_idx, prereq_idx): each table's one or two groups of columns.

    Two columns of units far enough apart make two groups, each with the best code column on its left (of equal ones in the
    second, that which lies as in the first); without them two such code columns do; else there is one group, or in a wide
    table a second that only units tell. Tables of fewer than two rows, and those without code or units, have none.
    """
    k, u, n = F.col("codes"), F.col("units"), F.size("codes")

    def by_units(p: Column) -> Column:
        u1, u2 = -p["a"], -p["b"]
        c1 = _best(k, F.lit(0), u1, F.lit(0))
        both = lambda c1: _let(_best(k, u1 + 1, u2, u1 + F.floor((u2 - u1) / 2).cast("int"), lambda c: -F.abs((u2 - c) - (u1 - c1))), lambda c2: F.array(
            _group(c1, c1 + 1, u1, F.when(c2 > u1 + 1, u1 + 1).otherwise(u1)),
            _group(c2, F.when(u2 > c2 + 1, c2 + 1).otherwise(c2), u2, F.when(n > u2 + 1, u2 + 1).otherwise(u2))))
        return _let(c1, both)

    def by_codes(p: Column) -> Column:
        c1, c2 = -p["a"], -p["b"]
        u1, u2 = _best(u, c1 + 1, c2, c1 + 2), _best(u, c2 + 1, n, F.least(c2 + 2, n - 1))
        return F.array(_group(c1, c1 + 1, u1, F.when(u1 + 1 < c2, u1 + 1).otherwise(u1)), _group(c2, c2 + 1, u2, F.when(u2 + 1 < n, u2 + 1).otherwise(u2)))

    def single(c1: Column) -> Column:
        def of(u1: Column) -> Column:
            u2 = _best(u, u1 + 1, n, F.lit(None).cast("int"))
            c2 = F.when(u2 > u1 + 1, u2 - 1).otherwise(u1 + 1)
            two = F.array(_group(c1, c1 + 1, u1, F.when(u2 - u1 >= APART, u1 + 1).otherwise(u1)), _group(c2, c2, u2, u2))
            return F.when((n >= WIDE) & u2.isNotNull(), two).otherwise(F.array(_group(c1, c1 + 1, u1, F.least(u1 + 1, n - 1))))

        return _let(_best(u, c1 + 1, n, F.least(c1 + 2, n - 1)), of)

    coded = lambda c: (F.get(k, c) >= 2) | ((F.get(k, c) >= 1) & (F.col("n_rows") <= FEW_ROWS))
    first = F.array_min(F.filter(F.sequence(F.lit(0), n - 1), coded))
    units_pair, codes_pair = _pair(u, lambda c: F.get(u, c) > 0), _pair(k, coded)
    paired = scores.withColumns({"_u": units_pair, "_c": codes_pair, "_f": first})
    groups = F.when(F.col("n_rows") < 2, F.array().cast(GROUP)).when(F.col("_u").isNotNull(), by_units(F.col("_u"))).when(F.col("_c").isNotNull(), by_codes(F.col("_c"))).when(F.col("_f").isNotNull(), single(F.col("_f"))).otherwise(F.array().cast(GROUP))
    return paired.select("table_id", F.posexplode(groups).alias("group", "g")).select("table_id", "group", "g.*")
