"""Exact vector retrieval: filters below the ranking, a threshold, deterministic top-k, statuses and calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ledgerleaf.functions.vectors import dot, norm

from .common import ratio, top_rows


def scored_pairs(queries: DataFrame, chunks: DataFrame, on: str | None = None, salts: int | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, chunk columns): cosine of each query with every chunk it may see.

    ``queries`` has query_id, q and, with ``on``, an array of the values of the chunk column ``on`` in its scope (an
    empty one is everything). Chunks are dealt into ``salts`` parts, as many as there are shuffle partitions where not
    given, and queries copied to each, so that few scopes still use all tasks. Norms are taken once per row, not per pair.
    """
    salts = salts or max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    q = queries.withColumn("q_norm", norm(F.col("q")))
    c = chunks.withColumn("v_norm", norm(F.col("v"))).withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if on:
        q = q.withColumn("want", F.explode(F.array_distinct("scope")))
        pairs = c.join(q, (F.col(on) == F.col("want")) & (c.salt == q.salt)).drop("want")
    else:
        pairs = c.join(q, c.salt == q.salt)
    both = F.col("q_norm") * F.col("v_norm")
    return pairs.drop("salt").withColumn("similarity", F.when(both == 0, 0.0).otherwise(dot(F.col("q"), F.col("v")) / both)).drop("q", "v", "q_norm", "v_norm")


#: Rows of a block, of chunks as of queries, and queries whose scores with a block are held at once.
BLOCK, TILE = 16_384, 128
#: Products in any order are nearer than this to those summed in order; what lies so near a border is summed in order.
NEAR = 1e-9


class _Vectors:
    """A block's vectors by their lengths, with norms summed in order of the components; null ones have none."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        rows = column.to_pylist()
        self.n, self.of = len(rows), {}
        size = np.array([-1 if r is None or None in r else len(r) for r in rows], np.int64)
        self.norm = np.full(self.n, np.nan)
        self.null = size < 0
        for d in sorted({*size.tolist()} - {-1}):
            at = np.flatnonzero(size == d)
            own = np.array([rows[i] for i in at], float).reshape(len(at), d)
            self.of[d], total = (at, own), np.zeros(len(at))
            for j in range(d):
                total = total + own[:, j] * own[:, j]
            self.norm[at] = np.sqrt(total)


def _scores(q: _Vectors, c: _Vectors, tile: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of the queries of ``tile`` with all chunks, within NEAR, and which of them are null."""
    out[:], null = 0.0, np.ones(out.shape, bool)
    row = np.full(q.n, -1)
    row[tile] = np.arange(len(tile))
    with np.errstate(all="ignore"):
        both = q.norm[tile][:, None] * c.norm[None, :]
        for d, (at, own) in q.of.items():
            here = row[at] >= 0
            if d in c.of and here.any():
                to, cells = c.of[d], np.ix_(row[at[here]], c.of[d][0])
                out[cells] = own[here] @ to[1].T
                null[cells] = False
        out /= both
    zero = both == 0
    out[zero], null[zero] = 0.0, False
    return out, null


def _exact(q: _Vectors, c: _Vectors, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """The similarities of given pairs, summed in order of the components."""
    out, done = np.zeros(len(qi)), np.zeros(len(qi), bool)
    with np.errstate(all="ignore"):
        both = q.norm[qi] * c.norm[ci]
        for d, (at, own) in q.of.items():
            if d in c.of:
                own_row, to_row = np.full(q.n, -1), np.full(c.n, -1)
                own_row[at], to_row[c.of[d][0]] = np.arange(len(at)), np.arange(len(c.of[d][0]))
                i = np.flatnonzero((own_row[qi] >= 0) & (to_row[ci] >= 0))
                x, y, total = own[own_row[qi[i]]], c.of[d][1][to_row[ci[i]]], np.zeros(len(i))
                for j in range(d):
                    total = total + x[:, j] * y[:, j]
                out[i], done[i] = total / both[i], True
    out[both == 0] = 0.0
    return out


def _blocks(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks of about BLOCK rows by hash, each block of one copied to all of the other's."""
    n_q, n_c = (max(-(-df.count() // BLOCK), 1) for df in (queries, chunks))
    n_c = max(n_c, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    deal = lambda df, c, n, as_: df.withColumn(as_, F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    copied = lambda df, n, as_: df.withColumn(as_, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copied(deal(queries, "query_id", n_q, "_q"), n_c, "_c"), copied(deal(chunks, "chunk_id", n_c, "_c"), n_q, "_q")


def best_pairs(queries: DataFrame, chunks: DataFrame, k: int, threshold: float = -1.0, others: bool = False, fits: bool = False) -> DataFrame:
    """Of the rows of ``scored_pairs`` (without ``on``) those among which are each query's k best at or above the threshold.

    Blocks of both sides are multiplied as matrices, and the pairs that may be among a block's k best are then summed in
    order of the components, so that similarities are those of ``scored_pairs`` to the last bit. With ``others`` a query
    doesn't meet the chunk of its own id. With ``fits`` queries have the chunk kinds that they may meet (_fits) and, unless
    it is empty, the ids of the only chunks they may meet (_only); chunks have a _kind. These columns aren't in the result.
    """
    q_names, c_names = ([n for n in df.columns if n not in (v, "_fits", "_only", "_kind")] for df, v in ((queries, "q"), (chunks, "v")))
    schema = StructType([*(queries.schema[n] for n in q_names), *(chunks.schema[n] for n in c_names), StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, qi, ci = _Vectors(left["q"]), _Vectors(right["v"]), [], []
        q_id, c_id = (t[n].to_numpy() for t, n in ((left, "query_id"), (right, "chunk_id")))
        kinds, kind = np.unique(right["_kind"].to_numpy(), return_inverse=True) if fits else (None, None)
        for start in range(0, q.n if c.n else 0, TILE):
            tile = np.arange(start, min(start + TILE, q.n))
            s, null = _scores(q, c, tile, np.empty((len(tile), c.n)))
            s[np.isnan(s)] = np.inf  # ordered first, as Spark has it
            s[null] = -np.inf
            if others:
                s[q_id[tile][:, None] == c_id[None, :]] = -np.inf
            if fits:
                for i, (may, only) in enumerate(zip(*(left[n].slice(start, len(tile)).to_pylist() for n in ("_fits", "_only")), strict=True)):
                    out = ~np.isin(kinds, np.array(may or [], np.int64))[kind]
                    s[i, out if not only else out | ~np.isin(c_id, np.array([x for x in only if x is not None], np.int64))] = -np.inf
            least = np.partition(s, c.n - k, axis=1)[:, c.n - k] if c.n > k else np.full(len(tile), -np.inf)
            at = np.nonzero((s >= np.maximum(least, threshold)[:, None] - NEAR) & (s > -np.inf))
            qi.append(tile[at[0]])
            ci.append(at[1])
        qi, ci = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (qi, ci))
        columns = [*(left[n].take(pa.array(qi)) for n in q_names), *(right[n].take(pa.array(ci)) for n in c_names), pa.array(_exact(q, c, qi, ci))]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    q, c = _blocks(queries, chunks)
    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(run, schema)


def tallies(queries: DataFrame, chunks: DataFrame, by: str, grid: list[float]) -> DataFrame:
    """(query columns, by, n, least, most, at_least): of each query's pairs with other chunks of one value of ``by``: how
    many there are, the least and the greatest similarity, and how many are at or above each threshold of ``grid``.

    As ``best_pairs``, with similarities near a threshold, or near the least or the greatest, summed in order.
    """
    q_names = [n for n in queries.columns if n != "q"]
    schema = StructType([*(queries.schema[n] for n in q_names), chunks.schema[by], StructField("n", LongType()), StructField("least", DoubleType()), StructField("most", DoubleType()), StructField("at_least", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return arrow.empty_table()
        coded = right[by].combine_chunks().dictionary_encode("encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        right, starts = right.take(pa.array(order)), np.flatnonzero(np.diff(code[order], prepend=-1))
        q, c = _Vectors(left["q"]), _Vectors(right["v"])
        q_id, c_id = (t[n].to_numpy() for t, n in ((left, "query_id"), (right, "chunk_id")))
        sizes, found = np.diff(starts, append=c.n), []
        for start in range(0, q.n, TILE):
            tile = np.arange(start, min(start + TILE, q.n))
            s, null = _scores(q, c, tile, np.empty((len(tile), c.n)))
            s[np.isnan(s)] = np.inf
            own = q_id[tile][:, None] == c_id[None, :]
            out = null | own
            low, high = np.where(out, np.inf, s), np.where(out, -np.inf, s)
            near = (low <= np.repeat(np.minimum.reduceat(low, starts, axis=1), sizes, axis=1) + NEAR) | (high >= np.repeat(np.maximum.reduceat(high, starts, axis=1), sizes, axis=1) - NEAR)
            for g in grid:
                near |= np.abs(s - g) < NEAR
            at = np.nonzero(near & ~out)
            s[at] = _exact(q, c, tile[at[0]], at[1])
            s[np.isnan(s)] = np.inf
            count = lambda m: np.add.reduceat(m, starts, axis=1, dtype=np.int64)
            low, high = np.where(out, np.inf, s), np.where(out, -np.inf, s)
            found.append((count(~own), count(~out), np.minimum.reduceat(low, starts, axis=1), np.maximum.reduceat(high, starts, axis=1), np.stack([count((s >= g) & ~out) for g in grid], axis=2) if grid else np.zeros((len(tile), len(starts), 0), np.int64)))
        n, some, low, high, over = (np.concatenate(x) for x in zip(*found, strict=True))
        qi, gi = np.nonzero(n > 0)
        real = lambda x: pa.array(np.where(np.isinf(x[qi, gi]), np.nan, x[qi, gi]), mask=some[qi, gi] == 0)
        columns = [*(left[c].take(pa.array(qi)).combine_chunks() for c in q_names), right[by].take(pa.array(starts[gi])).combine_chunks(), pa.array(n[qi, gi]), real(low), real(high), pa.array(over[qi, gi].tolist(), pa.list_(pa.int64()))]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    q, c = _blocks(queries, chunks)
    parts = q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(run, schema)
    sums = [F.sum(F.col("at_least")[i]).alias(f"_{i}") for i in range(len(grid))]
    whole = parts.groupBy(*q_names, by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *sums)
    return whole.select(*q_names, by, "n", "least", "most", F.array(*(F.col(f"_{i}") for i in range(len(grid)))).cast("array<long>").alias("at_least"))


def top_k(pairs: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """The k most similar chunks of each query at or above the threshold; ties by chunk_id; with rank from 1."""
    kept = pairs.where(F.col("similarity") >= threshold)
    return top_rows(kept, ["query_id"], [F.desc("similarity"), F.col("chunk_id")], k).withColumnRenamed("_rank", "rank")


def source_issue(hits: DataFrame, curriculum: str, has_scope: Column) -> DataFrame:
    """(query_id, issue): several curricula without a scope, else one document with several contents, else none."""
    found = hits.groupBy("query_id").agg(F.count_distinct(curriculum).alias("n_curricula"), F.max(has_scope).alias("scoped"), F.count_distinct("document_id").alias("n_docs"), F.count_distinct("document_id", "byte_hash").alias("n_bytes"))
    issue = F.when((F.col("n_curricula") > 1) & ~F.col("scoped"), "needs_scope").when(F.col("n_bytes") > F.col("n_docs"), "conflicting_sources").otherwise("none")
    return found.select("query_id", issue.alias("issue"))


def retrieval_status(rows: DataFrame) -> DataFrame:
    """Adds status, the first that applies; expects boolean and count columns named as in the ladder below."""
    ladder = [
        (F.col("intent_without_policy"), "invalid_query"),
        (F.col("n_releases") != 1, "release_changed"),
        (~F.col("configuration_equal"), "configuration_mismatch"),
        (~F.col("vector_valid"), "invalid_query"),
        (F.col("n_evidence") == 0, "insufficient_evidence"),
        (F.col("issue") != "none", None),
        (F.col("n_gaps") > 0, "insufficient_evidence"),
        (F.col("policy_id").startswith("uncalibrated"), "uncalibrated"),
    ]
    status = F.lit("ok")
    for condition, name in reversed(ladder):
        status = F.when(F.coalesce(condition, F.lit(False)), F.col("issue") if name is None else F.lit(name)).otherwise(status)
    return rows.withColumn("status", status)


def ranking_metrics(ranked: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Per case (case_id, n_gold): precision over a fixed k, recall (null without gold), and whether nothing was rightly found.

    ``ranked`` has case_id and relevant for the selected rows.
    """
    hits = ranked.groupBy("case_id").agg(F.count("*").alias("n_selected"), F.sum(F.col("relevant").cast("int")).alias("n_hits"))
    rows = cases.join(hits, "case_id", "left").na.fill(0, ["n_selected", "n_hits"])
    return rows.select("case_id", "n_selected", "n_hits", (F.col("n_hits") / F.lit(k)).alias("precision"), ratio(F.col("n_hits"), F.col("n_gold")).alias("recall"), ((F.col("n_gold") == 0) & (F.col("n_selected") == 0)).alias("unsupported_detected"))


def calibrate(pairs: DataFrame, grid: list[float]) -> DataFrame:
    """For each threshold of a grid: gold pairs recovered and others let through, and which threshold is best.

    The best has the most recovered, then the fewest others, then is the highest. One pass over the pairs: each is
    counted at the highest threshold it passes, and the grid's few rows are then summed from the top.
    """
    steps = sorted(grid)
    step = F.lit(None).cast("int")
    for i, t in enumerate(steps):
        step = F.when(F.col("similarity") >= t, i).otherwise(step)
    counts = pairs.select(step.alias("step"), "relevant").where("step IS NOT NULL").groupBy("step").agg(F.sum(F.col("relevant").cast("long")).alias("hit"), F.sum((~F.col("relevant")).cast("long")).alias("miss"))
    return _calibrated(counts, steps)


def calibrate_tallies(found: DataFrame, relevant: Column, grid: list[float]) -> DataFrame:
    """As ``calibrate``, from ``tallies`` over the same grid, in ascending order."""
    over = lambda i: F.coalesce(F.col("at_least")[i], F.lit(0)) if i < len(grid) else F.lit(0)
    steps = found.select(relevant.alias("relevant"), F.explode(F.array(*(F.struct(F.lit(i).alias("step"), (over(i) - over(i + 1)).alias("k")) for i in range(len(grid))))).alias("x"))
    counts = steps.groupBy("x.step").agg(F.sum(F.when(F.col("relevant"), F.col("x.k"))).alias("hit"), F.sum(F.when(~F.col("relevant"), F.col("x.k"))).alias("miss"))
    return _calibrated(counts, grid)


def _calibrated(counts: DataFrame, steps: list[float]) -> DataFrame:
    table = counts.sparkSession.createDataFrame(list(enumerate(steps)), "step int, threshold double").join(counts, "step", "left")
    sums = table.withColumns({"recovered": F.expr("coalesce(sum(hit) OVER (ORDER BY step DESC), 0)"), "false_positives": F.expr("coalesce(sum(miss) OVER (ORDER BY step DESC), 0)")})
    best = F.expr("max(struct(recovered, -false_positives, threshold)) OVER ()")
    return sums.withColumn("best", best["threshold"] == F.col("threshold")).select("threshold", "recovered", "false_positives", "best")
