from pyspark.sql import functions as F

from ledgerleaf.operators import context

CHUNKS = [  # chunk_id, version, scope, hints, similarity
    (1, 1, ["a"], ["x"], 0.9),
    (2, 1, [], None, 0.8),  # no scope passes, no hints fails where hints are asked for
    (3, 1, ["a"], ["x"], 0.8),
    (4, 1, ["a"], ["x"], 0.1),  # below the threshold, but needed
    (5, 2, ["a"], ["x"], 0.2),  # another version
    (6, 1, ["b"], ["x"], 0.95),  # out of scope
]
NEEDS = [(1, 4), (4, 5), (4, 6), (4, 1), (3, 5)]


def retrieved(spark, hints=(), versions=(), chunks=()):
    rows = [(7, *c, ["a"], list(hints), list(versions), list(chunks)) for c in CHUNKS]
    pairs = spark.createDataFrame(rows, "query_id long, chunk_id long, version long, scope array<string>, hints array<string>, similarity double, want_scope array<string>, want_hints array<string>, want_versions array<long>, want_chunks array<long>")
    needs = spark.createDataFrame(NEEDS, "src long, dst long")
    return [(r["rank"], r.chunk_id, r.neighbours) for r in context.retrieve(pairs, needs, 2, 0.5).orderBy("rank").collect()]


def test_retrieve(spark):
    assert retrieved(spark) == [(1, 1, [4]), (2, 2, [])]  # a tie goes to the smaller id
    assert retrieved(spark, hints=["x"]) == [(1, 1, [4]), (2, 3, [])]
    assert retrieved(spark, versions=[2]) == []
    assert retrieved(spark, chunks=[3, 1]) == [(1, 1, []), (2, 3, [])]  # 4 isn't asked for, so it doesn't come along


def test_parameter_issues(spark):
    rows = spark.createDataFrame([(3, 0.5, 1, 1), (4, 0.5, 1, 1), (None, 0.5, 1, 1), (5, float("nan"), 1, 1), (5, -1.5, 1, 1), (8, 1.0, 33, 1), (8, -1.0, 32, 129)], "k int, t double, f int, c int")
    issue = context.parameter_issue(F.col("k"), F.col("t"), F.col("f"), F.col("c"))
    assert [r[0] for r in rows.select(issue).collect()] == ["none", "bad_k", "bad_k", "bad_threshold", "bad_threshold", "too_many_filters", "too_many_chunks"]


def test_serialised_forms(spark):
    rows = spark.createDataFrame([(1, 1, "p", "q", "x"), (1, 2, "p", None, "y"), (2, 1, "p", "q", "z")], "g long, o long, a string, b string, c string")
    got = {r.g: r for r in context.serialised(rows, "g", ["o"], ["a", "b"], ["c"]).collect()}
    assert got[1].plain == "a=p; b=q; c=x\na=p; b=; c=y" and got[1].compact == "p|q|x\np||y"
    assert got[1].common == "a=p\nb=q; c=x\nb=; c=y" and got[2].common == "a=p; b=q\nc=z"


def test_table_parts(spark):
    rows = [(1, 0, 10, True, False), (1, 1, 30, False, False), (1, 2, 30, False, True), (1, 3, 20, False, False), (1, 4, 200, False, False), (1, 5, 5, False, True), (2, 1, 7, False, False)]
    frame = spark.createDataFrame(rows, "k long, i long, size long, header boolean, joined boolean")
    got = sorted(tuple(r) for r in context.table_parts(frame, ["k"], ["i"], 75).collect())
    assert got == [(1, 1, 2, 70), (1, 2, 1, 30), (1, 3, 2, 215), (2, 1, 1, 7)]  # joined rows stay together, whatever their size


def test_narrowed_chunks(spark):
    claims = spark.createDataFrame([(1, 10, "a"), (2, 10, "a"), (2, 10, "lost")], "request long, subject long, claim string")
    fields = spark.createDataFrame([(10, "a", 5)], "subject long, claim string, chunk_id long")
    needs = spark.createDataFrame([(5, 6), (6, 5), (6, 7)], "src long, dst long")
    members = spark.createDataFrame([(10, i) for i in (1, 2, 5)], "subject long, chunk_id long")
    got = sorted(tuple(r) for r in context.narrowed(claims, fields, needs, members).collect())
    assert got == [(1, 5), (1, 6), (1, 7), (2, 1), (2, 2), (2, 5)]


def test_requests_of_the_same_claims_are_narrowed_once(spark):
    claims = spark.createDataFrame([(i, 10, "a") for i in range(50)] + [(99, 10, "a"), (99, 11, "b")], "request long, subject long, claim string")
    fields = spark.createDataFrame([(10, "a", 5), (11, "b", 8)], "subject long, claim string, chunk_id long")
    needs = spark.createDataFrame([(5, 6)], "src long, dst long")
    own, chunks = context.narrowed_classes(claims, fields, needs, fields.select("subject", "chunk_id"))
    assert {r.request: r.class_id for r in own.collect()} == {**{i: 0 for i in range(50)}, 99: 99}
    assert sorted(tuple(r) for r in chunks.collect()) == [(0, 5), (0, 6), (99, 5), (99, 6), (99, 8)]
