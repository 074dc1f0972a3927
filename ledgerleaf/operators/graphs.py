"""Reference graphs: transitive closure, cycles, unlocks, affected items. Loops run on the cluster, a join a round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: Levels of a search that are held as parts before they are written as one.
LEVELS = 16
#: Nodes of one row of a set of reached ones, and rounds in which sets are built from those below.
CHUNK, WAVES = 4096, 64


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst) edges -> all (src, dst) with a path of one edge or more.

    Each round joins what the last one found with all that is known, so found paths double and the rounds are the
    logarithm of the longest path; diamonds and cycles are met by set semantics. The driver sees only whether a round
    found anything new.
    """
    known = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    new = known.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for _ in range(max_rounds):
        longer = new.join(known, F.col("b") == F.col("src")).select("a", F.col("dst").alias("c")).distinct()
        new = cut(longer.join(known, (F.col("a") == F.col("src")) & (F.col("c") == F.col("dst")), "left_anti").select("a", F.col("c").alias("b")))
        if new.isEmpty():
            return known
        known = cut(known.union(new))
    raise RuntimeError(f"closure did not settle in {max_rounds} rounds")


def bounded_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what each root reaches, itself left out; frontier by frontier, for few roots in a large graph.

    A root never takes a node twice, so cycles end, however long a chain is. No side is broadcast, which would send it
    to the driver in each round.
    """
    frontier = cut(roots.select(F.col("root"), F.col("root").alias("node")).distinct())
    levels = [frontier]
    while not frontier.isEmpty():
        step = frontier.join(edges.hint("merge"), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.union, levels).select(F.col("root").alias("r"), F.col("node").alias("n")).hint("merge")
        frontier = cut(step.join(known, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")), "left_anti"))
        levels.append(frontier)
        if len(levels) == LEVELS:  # long chains would else be a plan of as many parts
            levels = [cut(reduce(DataFrame.union, levels))]
    return reduce(DataFrame.union, levels).where("root <> node")


def cyclic(closed: DataFrame) -> DataFrame:
    """(node, members): nodes on a cycle, and how many nodes share it (those it reaches and that reach it).

    Nodes that reach themselves are picked first, so only paths among these are joined.
    """
    own = cut(closed.where("src = dst").select(F.col("src").alias("node")))
    inner = cut(closed.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    back = inner.join(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return back.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("members"))


def reached_sets(edges: DataFrame) -> DataFrame:
    """(src, reached): what each node with an edge reaches, in disjoint arrays of at most CHUNK nodes.

    A node's set is made once, of the sets of the nodes its edges lead to; so what is shuffled are sets along edges, not
    the pairs of every round. What lies on or above a cycle, or above more than WAVES nodes in a row, is closed by pairs.
    """
    left = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    done: DataFrame | None = None
    for _ in range(WAVES):
        waiting = left.join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src").distinct()
        ready = stored(left.join(waiting.withColumn("waits", F.lit(True)).hint("merge"), "src", "left").withColumn("waits", F.coalesce("waits", F.lit(False))))
        own = ready.where("NOT waits").select("src", "dst")
        if own.isEmpty():
            break
        left = ready.where("waits").select("src", "dst")
        new = _merged(own, done)
        done = new if done is None else stored(done.union(new)) if len(done.inputFiles()) > 4096 else done.union(new)
    pairs = closure(left)
    rest = _merged(pairs, done) if not pairs.isEmpty() else None
    return reduce(DataFrame.union, [x for x in (done, rest) if x is not None]) if done is not None or rest is not None else pairs.select("src", F.array("dst").alias("reached"))


def _merged(edges: DataFrame, done: DataFrame | None) -> DataFrame:
    """(src, reached): the nodes at the other end of the edges and what those reach. Arrays are dealt by node, then merged."""
    lists = edges.select("src", F.array("dst").alias("reached"))
    if done is not None:
        below = done.select(F.col("src").alias("dst"), "reached")
        lists = lists.union(edges.join(below.hint("merge"), "dst").select("src", "reached"))
    each = lists.repartition("src").select("src", F.explode("reached").alias("dst")).distinct()
    part = F.floor((F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1) / CHUNK)
    return stored(each.withColumn("part", part).groupBy("src", "part").agg(F.collect_list("dst").alias("reached")).select("src", "reached"))


def _shuffled(node: Column, salt: int) -> Column:
    """Another order of whole numbers, without two that are equal."""
    x = node.bitwiseXOR(F.lit(salt).cast("long"))
    for move, by in (("shiftleft", 13), ("shiftrightunsigned", 7), ("shiftleft", 17)):
        x = x.bitwiseXOR(F.call_function(move, x, F.lit(by)))
    return x


def _inner(edges: DataFrame) -> DataFrame:
    """Edges without most of those that no cycle has: ends of the graph are taken off while that makes it much smaller."""
    n = edges.count()
    while n:
        entered, leaving = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = stored(edges.join(entered.hint("merge"), "src", "left_semi").join(leaving.hint("merge"), "dst", "left_semi").select("src", "dst"))
        n, before = edges.count(), n
        if n > 0.9 * before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(node, members) as ``cyclic`` gives them, from edges between whole numbers and without their closure.

    Nodes pass on the least mark that reaches them and the least that they reach. Where both are one node's, all of its
    cycle have been found; other cycles lie among nodes of the same two marks, and are looked for with other marks.
    """
    every = stored(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    left, found = _inner(every.where("src <> dst")), []
    while not left.isEmpty():
        salt = len(found) + 1
        marks = _marks(left, salt)
        found.append(marks.where("into = out").select("node", F.lit(salt).alias("round"), "into"))
        ends = lambda c: marks.where("into <> out").select(F.col("node").alias(c), F.col("into").alias(f"into_{c}"), F.col("out").alias(f"out_{c}")).hint("merge")  # noqa: B023, E731
        within = left.join(ends("src"), "src").join(ends("dst"), "dst").where("into_src = into_dst AND out_src = out_dst")
        left = _inner(stored(within.select("src", "dst")))
    members = every.where("src = dst").select(F.col("src").alias("node"), F.lit(1).cast("long").alias("members"))
    if found:
        parts = reduce(DataFrame.union, found)
        sizes = parts.groupBy("round", "into").agg(F.count("*").alias("members")).where("members > 1")
        members = members.union(parts.join(sizes, ["round", "into"]).select("node", "members"))
    return members.groupBy("node").agg(F.max("members").alias("members"))


def _marks(edges: DataFrame, salt: int) -> DataFrame:
    """(node, into, out): the least mark of the nodes that reach it and of those that it reaches, itself included."""
    mark = _shuffled(F.col("node"), salt)
    state = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", mark.alias("into"), mark.alias("out"), F.lit(True).alias("moved")))
    none = F.lit(None).cast("long")
    while True:
        new = state.where("moved").select("node", "into", "out")
        down = edges.join(new.withColumnRenamed("node", "src").hint("merge"), "src").select(F.col("dst").alias("node"), "into", none.alias("out"))
        up = edges.join(new.withColumnRenamed("node", "dst").hint("merge"), "dst").select(F.col("src").alias("node"), none.alias("into"), "out")
        told = down.union(up).groupBy("node").agg(*(F.min(c).alias(f"{c}_told") for c in ("into", "out")))
        lower = lambda c: F.least(c, f"{c}_told")
        moved = (lower("into") < F.col("into")) | (lower("out") < F.col("out"))
        state = stored(state.join(told.hint("merge"), "node", "left").select("node", lower("into").alias("into"), lower("out").alias("out"), moved.alias("moved")))
        if state.where("moved").isEmpty():
            return state.drop("moved")


def unlocks(edges: DataFrame) -> DataFrame:
    """(prerequisite, n, items): what each prerequisite opens directly."""
    return edges.groupBy(F.col("dst").alias("prerequisite")).agg(F.count_distinct("src").alias("n"), F.array_sort(F.collect_set("src")).alias("items"))
