import random

from ledgerleaf.operators import context, retrieval


def test_retrieval_without_a_row_a_pair(spark, monkeypatch):
    """Equal to the filter over all pairs: null and empty scopes, hints, chunks asked for by id, odd vectors."""
    rng = random.Random(4)
    vector = lambda i: None if i % 17 == 0 else [0.0, 0.0] if i % 19 == 0 else [rng.choice([-1.0, 0.5, 1.0, 2.0]), rng.choice([1.0, 3.0])]
    rows = [(i, vector(i), rng.choice([None, [], ["a"], ["b"], ["a", "b"]]), rng.choice([None, ["x"], ["x", "y"]]), i % 2) for i in range(120)]
    asked = [(q, vector(q + 1), rng.choice([[], ["a"], ["a", "b"]]), rng.choice([[], ["y"], ["x", "z"]]), rng.choice([[], [0], [0, 1]]), rng.choice([[], [], rng.sample(range(120), 30)])) for q in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, v array<double>, scope array<string>, hints array<string>, version int")
    queries = spark.createDataFrame(asked, "query_id long, q array<double>, want_scope array<string>, want_hints array<string>, want_versions array<int>, want_chunks array<long>")
    needs = spark.createDataFrame([(i, i + 2) for i in range(0, 100) if i % 8 < 4] + [(i, i - 4) for i in range(0, 120, 9)], "src long, dst long")
    want = {(r.query_id, r["rank"]): tuple(r) for r in context.retrieve(retrieval.scored_pairs(queries, chunks), needs, 3, 0.3).collect()}
    sent, inner = [], context.best_pairs

    def counted(*a, **b):
        sent.append(inner(*a, **b).count())
        return inner(*a, **b)

    monkeypatch.setattr(context, "best_pairs", counted)
    got = context.retrieve_among(queries, chunks, needs, 3, 0.3).collect()
    assert {(r.query_id, r["rank"]): tuple(r) for r in got} == want and len(got) == len(want) > 50
    assert any(r.neighbours for r in got) and sent[0] < len(rows) * len(asked) / 8  # pairs that may be hits, not all
