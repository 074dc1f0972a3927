"""Proposals for texts that match nothing: all known codes or titles within a few edits, by what both become when letters go.

Two strings within n edits share a string that each becomes by dropping n letters at most; so candidates are an equi-join
of those, verified by their distance, and no pair of strings that share none is ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters and digits that scanners mistake for each other: such an edit costs half.
CONFUSED, FOR = "OQDIlLSBZG", "0001115826"
#: Longer strings aren't looked up: the strings they become grow with the square of their length.
LONGEST = 40


def dropped(text: Column, edits: int) -> Column:
    """The distinct strings that a text becomes when up to ``edits`` letters go, itself included."""
    out = level = F.array(text)
    for _ in range(edits):
        shorter = lambda t: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: i <= F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def cost(read: Column, known: Column) -> Column:
    """Edits from one string to the other; half an edit for each that vanishes once what scanners confuse is the same."""
    same = lambda t: F.translate(t, CONFUSED, FOR)
    return (F.levenshtein(read, known) + F.levenshtein(same(read), same(known))) / 2.0


def proposals(read: DataFrame, known: DataFrame, edits: int = 2) -> DataFrame:
    """(text, proposal, edits, cost, rank): all known texts within ``edits`` edits of each text read, the cheapest first.

    Both have a column text; equal ones are one, nulls and empty ones take no part. A text that is known has rank 1 for
    itself at no cost. Texts of more than LONGEST letters have no proposals and are no proposals.
    """
    own = lambda df: df.select("text").where((F.length("text") > 0) & (F.length("text") <= LONGEST)).distinct()
    left = own(read).select("text", F.explode(dropped(F.col("text"), edits)).alias("short"))
    right = own(known).select(F.col("text").alias("proposal"), F.explode(dropped(F.col("text"), edits)).alias("short"))
    near = left.join(right, "short").where(F.abs(F.length("text") - F.length("proposal")) <= edits).select("text", "proposal").distinct()
    priced = near.withColumn("edits", F.levenshtein("text", "proposal")).where(F.col("edits") <= edits).withColumn("cost", cost(F.col("text"), F.col("proposal")))
    order = Window.partitionBy("text").orderBy("cost", "edits", "proposal")
    return priced.withColumn("rank", F.row_number().over(order))
