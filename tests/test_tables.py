import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import sets, text, vectors
from ledgerleaf.operators import retrieval
from ledgerleaf.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_loads_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    none = rows.limit(0)
    assert tables.load_checked(rows, none, str(tmp_path / "t")) == 2
    with pytest.raises(ValueError, match="not loaded"):
        tables.load_checked(rows, rows, str(tmp_path / "u"))
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k long, v string")
    assert [r.k for r in tables.conflicts(rows, new, ["k"]).collect()] == [1]
    assert sorted(map(tuple, tables.upsert(rows, new, ["k"]).collect())) == [(1, "b"), (2, None), (3, "c")]
    assert {tuple(r) for r in tables.differences(rows, new, "k", "v").collect()} == {(1, "changed"), (3, "added")}
    assert tables.inventory(spark, str(tmp_path / "t")).where("extension = 'parquet'").count() >= 1
    rows.write.json(str(tmp_path / "j"))
    assert tables.read_records(spark, str(tmp_path / "j"), rows.schema).count() == 2


def test_text(spark):
    assert one(spark, text.clean_text(F.lit(" a­ b ² –\n c"))) == "ab 2 - c".replace("ab", "a b")
    assert one(spark, text.lab_free_key(F.lit("cs-101 L"))) == "CS101" and one(spark, text.lab_free_key(F.lit("xLL"))) == "XLL"
    assert one(spark, text.year_semester(F.lit("Second Year, 1st Semester"))) == 21
    assert one(spark, text.year_semester(F.lit("third year standing, summer"))) == 993
    for shown, want in (("3", 3.0), ("2/1", 3.0), (" 2.5 / 1 ", 3.5), ("three", None), ("", None), ("-1", None)):
        assert one(spark, text.printed_total(F.lit(shown))) == want
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, text.canonical_text(F.lit("é  x"))) == "é x"
    assert [one(spark, text.plain_filename(F.lit(n))) for n in ("a b.pdf", "../x", "a/b", None)] == [True, False, False, False]
    assert one(spark, text.holds_identity(F.lit("id 123456789"))) and not one(spark, text.holds_identity(F.lit("id 12345678")))


def test_vectors_and_sets(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, vectors.cosine(v(1, 0), v(0.8, 0.6))) == pytest.approx(0.8) and one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, vectors.dot(v(1, 0), v(1, 0, 0))) is None and one(spark, vectors.valid(v(0.6, 0.8), 2)) and not one(spark, vectors.valid(v(0.6, 0.9), 2))
    with pytest.raises(Exception, match="zero vector"):
        one(spark, vectors.normalise(v(0, 0)))
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, sets.within(strings(), strings("a"))) and one(spark, sets.within(strings("b"), strings())) and not one(spark, sets.within(strings("a", "b"), strings("a")))
    assert not one(spark, sets.any_of(F.lit(None).cast("array<string>"), strings("a"))) and one(spark, sets.any_of(F.lit(None).cast("array<string>"), strings()))


def test_topk_keeps_ties_and_threshold(spark):
    chunks = spark.createDataFrame([(3, [0.8, 0.6], 0), (2, [0.8, 0.6], 0), (1, [1.0, 0.0], 0), (4, [0.0, 1.0], 0), (5, [-1.0, 0.0], 1)], "chunk_id long, v array<double>, label int")
    queries = spark.createDataFrame([(9, [1.0, 0.0], [0])], "query_id long, q array<double>, scope array<int>")
    got = retrieval.top_k(retrieval.scored_pairs(queries, chunks, on="label"), 3, 0.5).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.similarity, 9)) for r in got] == [(1, 1.0), (2, 0.8), (3, 0.8)]
