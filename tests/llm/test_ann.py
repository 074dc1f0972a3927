import math

import numpy as np

from ledgerleaf.llm import ann
from ledgerleaf.llm.queries import op1_ann

SCHEMA = "vec_id long, embedding array<double>, vec string, first long, list int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA)


def test_edges_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(40)] + [(400, rows[3][1])]  # many equal vectors, and a repeated row
    bad = [(900, None), (901, [0.0] * 8), (920, [math.nan] + [1.0] * 7), (921, [math.inf] + [1.0] * 7), (940, [None] + [1.0] * 7), (None, [1.0] * 8)]
    clean = dict(rows)
    ids, vectors = np.array(list(clean)), np.array(list(clean.values()))
    got = {}
    for r in sorted(ann.search(_frame(spark, rows + bad), ann.F.col("vec_id") % 20 == 0, 20, probe_ratio=9.0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in clean if i % 20 == 0}
    for q, found in got.items():
        want = ann.brute_force(ids, vectors, q)
        assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], rtol=0, atol=0)


def test_few_candidates_and_empty(spark):
    few = [tuple(r) for r in ann.search(_frame(spark, [(20, [1.0, 0.0]), (21, [0.5, 1.0])]), ann.F.col("vec_id") % 20 == 0, 20).collect()]
    assert few == [(20, 1, 21, 0.5)]
    assert ann.search(_frame(spark, []), ann.F.col("vec_id") % 20 == 0, 20).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got = {}
    for r in op1_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {i for i, _ in ann.brute_force(ids, vectors, q)}) / 20 for q in ids[ids % 20 == 0]]
    assert np.mean(hits) >= 0.9


def _recall(spark, ids, vectors, step):
    frame = spark.createDataFrame([(int(i), v) for i, v in zip(ids, vectors.tolist(), strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, ann.F.col("vec_id") % step == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    asked = ids[ids % step == 0]
    assert all(sorted(r for r, _ in got[q]) == list(range(1, 21)) for q in asked)  # every query has all its ranks
    return np.mean([len({v for _, v in got[q]} & {i for i, _ in ann.brute_force(ids, vectors, q)}) / 20 for q in asked])


def test_recall_where_lists_are_pruned(spark):
    rng = np.random.default_rng(8)
    ids = np.arange(12_000)
    assert _recall(spark, ids, rng.normal(size=(len(ids), 24)), 100) >= 0.9
    clusters = rng.normal(size=(90, 16))[rng.integers(0, 90, len(ids))] + 0.05 * rng.normal(size=(len(ids), 16))
    assert _recall(spark, ids, clusters, 100) >= 0.9


def test_full_ranks_where_near_lists_are_short(spark):
    """One far cluster of a few vectors, whose own lists hold fewer than 20, and many exact ties."""
    rng = np.random.default_rng(9)
    far = rng.normal(size=(5, 6)) * 0.01 + np.array([9.0, 0, 0, 0, 0, 0])
    axes = np.eye(6)[rng.integers(0, 6, 3000)] * rng.integers(1, 400, 3000)[:, None]
    vectors = np.concatenate((far, axes))
    assert _recall(spark, np.arange(len(vectors)), vectors, 5) >= 0.9


def test_lengths_are_tables_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (21, [0.5, 1.0]), (40, [1.0, 1.0, 1.0]), (41, [2.0, 0.0, 0.0])]
    found = sorted(tuple(r) for r in ann.search(_frame(spark, rows), ann.F.col("vec_id") % 20 == 0, 20).collect())
    assert found == [(20, 1, 21, 0.5), (40, 1, 41, 2.0)]


def test_small_groups_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = _frame(spark, [(i, rng.normal(size=8).tolist()) for i in range(2000)])
    ask = lambda: sorted(map(tuple, ann.search(table, ann.F.col("vec_id") % 20 == 0, 20).collect()))
    want = ask()
    monkeypatch.setattr(ann, "GROUP", 50)
    assert ask() == want


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(6000, 16))
    index = ann.Index.fit(vectors, 20_000, float(np.linalg.norm(vectors, axis=1).max()))
    points = index.lift(vectors[:300], index.largest)
    ids, far = index.nearest(points, 40)
    exact = ann._far(points, index.centres)
    assert np.mean(exact.argmin(1) == ids[:, 0]) > 0.97 and np.allclose(np.take_along_axis(exact, ids, 1), far)


def test_lists_are_balanced():
    rng = np.random.default_rng(5)
    points = np.concatenate((rng.normal(size=(3000, 8)) * 0.1, rng.normal(size=(1000, 8))))
    size = np.bincount(ann._far(points, ann.balanced_centroids(points, 32)).argmin(1), minlength=32)
    assert size.max() < 6 * size.mean()
