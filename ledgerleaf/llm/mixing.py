"""Mixing sources to target weights: hierarchical token budgets, then a token-prefix of seeded epochs for each leaf.

DataFrame functions only.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a leaf that may be ordered in one task; a leaf's epoch is dealt into hash buckets of about this size.
ROWS_IN_BUCKET = 4096


def token_estimate(text: Column) -> Column:
    """A quarter of a text's bytes, rounded up, and 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide ``budget`` of each parent over its children by ``weight``, none above ``cap``, adding ``share``.

    What a child can't use goes to its siblings by their weights, until it is used up or all are full: the shares are
    min(cap, weight * level) for the one level that adds up.
    """
    mine = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = mine.orderBy("ratio", name)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = nodes.where("weight > 0").withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("at", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(mine)
    return ranked.withColumn("found", level.level).withColumn("share", F.coalesce(F.least("cap", F.col("weight") * F.col("found")), F.col("cap"))).drop("ratio", "level", "at", "found")


def leaf_budgets(sizes: DataFrame, path: list[str], weights: dict[str, DataFrame], budget: float, max_epochs: int) -> DataFrame:
    """(path..., available, budget) of every leaf that gets tokens.

    ``sizes`` has the path columns and available tokens of the leaves. ``weights[level]`` has the path columns down to
    that level and weight; what it lacks weighs 1. A node can take what its leaves hold times ``max_epochs``, so at
    each level a shortage first goes to siblings, and only what no sibling can take is missing from their parent.
    """
    own = F.lit(float(budget))
    level_sizes = {k: sizes.groupBy(*path[: k + 1]).agg((F.sum("available") * float(max_epochs)).alias("cap")) for k in range(len(path))}
    above = None
    for k, name in enumerate(path):
        nodes = level_sizes[k]
        if name in weights:
            table = weights[name].select(*(F.col(c).alias(f"w_{c}") for c in path[: k + 1]), F.col("weight").cast("double").alias("given"))
            same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in path[: k + 1]]
            nodes = nodes.join(table, same, "left").withColumn("weight", F.coalesce("given", F.lit(1.0))).select(*path[: k + 1], "cap", "weight")
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        if above is None:
            nodes = nodes.withColumn("budget", own)
        else:
            parents = above.select(*(F.col(c).alias(f"p_{c}") for c in path[:k]), F.col("share").alias("budget"))
            nodes = nodes.join(parents, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in path[:k]]).select(*path[: k + 1], "cap", "weight", "budget")
        above = water_fill(nodes, path[:k], name)
    leaves = sizes.select(*(F.col(c).alias(f"l_{c}") for c in path), "available", "rows")
    return above.join(leaves, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in path]).select(*path, "available", "rows", F.floor(F.col("share") + 1e-6).cast("long").alias("leaf_budget"))


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, path: dict[str, Column], weights: dict[str, DataFrame], budget_share: float = 0.5, max_epochs: int = 2, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that a budget of ``budget_share`` of all their tokens takes, once for each time taken.

    ``path`` names the tree's levels from the root down, each a column over docs (domain, language, source); its names
    may also be columns of docs, which then stay as they are. Adds mix_path (struct), mix_tokens and mix_epoch (0 for
    the first). A leaf is read whole in each full epoch, and in the last epoch up to the longest prefix, in the seeded
    order of that epoch, that its budget holds; rows of one doc_id are taken together. Null path values are a node of
    their own, null texts count as one token, null ids as an empty id; empty input gives no rows.
    """
    tokens = tokens if tokens is not None else token_estimate(F.col("text"))
    levels = list(path)
    made = docs.withColumns({"mix_path": F.struct(*(c.alias(k) for k, c in path.items())), "mix_tokens": tokens, "mix_key": F.col("doc_id")})
    narrow = cut(made.select("mix_key", "mix_tokens", *(F.col(f"mix_path.{k}").alias(k) for k in levels)))
    sizes = cut(narrow.groupBy(*levels).agg(F.sum("mix_tokens").alias("available"), F.count("*").alias("rows")))
    total = sizes.agg(F.sum("available"), F.max("rows")).first()
    budgets = leaf_budgets(sizes, levels, weights, budget_share * (total[0] or 0), max_epochs)
    plan = budgets.select(F.struct(*levels).alias("leaf"), F.expr("leaf_budget div available").alias("full"), F.expr("leaf_budget % available").alias("left_over"))
    plan = cut(plan)
    digits = min(8, max(1, ceil(log(max((total[1] or 1) / ROWS_IN_BUCKET, 1), 16))))

    placed = narrow.withColumn("mine", F.struct(*levels)).join(plan, F.col("mine").eqNullSafe(F.col("leaf"))).where("left_over > 0")
    placed = placed.select("leaf", "left_over", "mix_tokens", F.struct(_key(seed, F.col("full"), F.col("mix_key")).alias("hash"), F.coalesce("mix_key", F.lit(-(2**62))).alias("id")).alias("place"))
    placed = placed.withColumn("bucket", F.substring("place.hash", 1, digits))
    # prefix sums in two levels: over runs of buckets, then within each run, so that no task has all of a leaf's buckets
    sums = cut(placed.groupBy("leaf", "bucket").agg(F.sum("mix_tokens").alias("own"), F.first("left_over").alias("left_over")))
    sums = sums.withColumn("run", F.substring("bucket", 1, digits // 2))
    runs = cut(sums.groupBy("leaf", "run").agg(F.sum("own").alias("run_own")))
    before = F.sum("run_own").over(Window.partitionBy("leaf").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("leaf").alias("r_leaf"), F.col("run").alias("r_run"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("own").over(Window.partitionBy("leaf", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.withColumn("within", within).join(runs, F.col("leaf").eqNullSafe(F.col("r_leaf")) & (F.col("run") == F.col("r_run")))
    sums = sums.select("leaf", "bucket", "own", "left_over", (F.col("before") + F.col("within")).alias("upto"))
    sums = cut(sums.where("upto - own < left_over"))  # the buckets that the budget reaches
    whole = sums.where("upto <= left_over").groupBy("leaf").agg(F.max("bucket").alias("last_bucket"))
    edge = sums.where("upto > left_over").select(F.col("leaf").alias("e_leaf"), F.col("bucket").alias("e_bucket"), (F.col("upto") - F.col("own")).alias("ahead"))
    inside = placed.join(edge, F.col("leaf").eqNullSafe(F.col("e_leaf")) & (F.col("bucket") == F.col("e_bucket")))  # one bucket of a leaf
    running = F.sum("mix_tokens").over(Window.partitionBy("leaf").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", F.col("ahead") + running).where("upto <= left_over").groupBy("leaf").agg(F.max("place").alias("last"))
    stops = plan.join(whole.withColumnRenamed("leaf", "b_leaf"), F.col("leaf").eqNullSafe(F.col("b_leaf")), "left")
    stops = stops.join(last.withColumnRenamed("leaf", "l_leaf"), F.col("leaf").eqNullSafe(F.col("l_leaf")), "left")
    stops = cut(stops.select("leaf", "full", "left_over", "last", "last_bucket"))  # a row for each leaf

    hashed = _key(seed, F.col("full"), F.col("mix_key"))
    place = F.struct(hashed.alias("hash"), F.coalesce("mix_key", F.lit(-(2**62))).alias("id"))
    more = F.coalesce(F.substring(hashed, 1, digits) <= F.col("last_bucket"), F.lit(False)) | F.coalesce(place <= F.col("last"), F.lit(False))
    taken = made.join(stops, F.col("mix_path").eqNullSafe(F.col("leaf")))
    taken = taken.withColumn("mix_times", F.col("full") + F.when((F.col("left_over") > 0) & more, 1).otherwise(0)).where("mix_times > 0")
    return taken.select(*docs.columns, "mix_path", "mix_tokens", F.explode(F.sequence(F.lit(0), F.col("mix_times").cast("int") - 1)).alias("mix_epoch"))
