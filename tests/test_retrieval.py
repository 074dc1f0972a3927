"""Blocks of pairs against all pairs, one by one."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import retrieval

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0, 0.0, 0.0], [1.0, 2.0], [1.0, None, 2.0], [NAN, 1.0, 0.0], [INF, 1.0, 0.0], [0.0, 0.0]]


def sides(spark, seed, odd):
    rng = random.Random(seed)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(30)]
    vectors += [[2 * x for x in v] for v in vectors[:5]] + vectors[:9] + odd  # ties, exact and but for rounding
    rows = [(i, v, rng.choice(["a", "b", None])) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, v array<double>, label string")
    queries = spark.createDataFrame([(i, v, la) for i, v, la in rows if i % 3 == 0 or i > 43], "query_id long, q array<double>, q_label string")
    return queries, chunks


@pytest.mark.parametrize("odd", [[], ODD])
def test_best_pairs(spark, monkeypatch, odd):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    queries, chunks = sides(spark, 1, odd)
    every = retrieval.scored_pairs(queries, chunks)
    for others, threshold in ((False, -1.0), (True, 0.1)):
        want = retrieval.top_k(every.where("chunk_id <> query_id") if others else every, 4, threshold)
        got = retrieval.top_k(retrieval.best_pairs(queries, chunks, 4, threshold, others), 4, threshold)
        names = ["query_id", "rank", "chunk_id", "label", "q_label", "similarity"]
        assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, want.select(names).collect()))


@pytest.mark.parametrize("odd", [[], ODD])
def test_tallies(spark, monkeypatch, odd):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    queries, chunks = sides(spark, 2, [v for v in odd if v is None or not v or v[0] not in (INF,) and v[0] == v[0]])
    every = retrieval.scored_pairs(queries, chunks).where("chunk_id <> query_id")
    grid = [0.1, 0.5, 1.0]
    over = F.array(*(F.count_if(F.col("similarity") >= g) for g in grid)).alias("at_least")
    want = every.groupBy("query_id", "q_label", "label").agg(F.count("*").alias("n"), F.min("similarity").alias("least"), F.max("similarity").alias("most"), over)
    got = retrieval.tallies(queries, chunks, "label", grid)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    best = retrieval.calibrate(every.select("similarity", (F.col("label") == F.col("q_label")).alias("relevant")), grid)
    found = retrieval.calibrate_tallies(got, F.col("label") == F.col("q_label"), grid)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, best.collect()))
