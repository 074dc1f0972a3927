from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import capabilities, ingestion, reading, releases



def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_label_places(spark):
    got = one(spark, reading.label_places(F.col("t"), reading.SEMESTER), t="1st Sem, 1ST SEM; Summer")
    assert [(r["at"], r.label) for r in got] == [(1, "1st sem"), (19, "summer")]
    assert one(spark, reading.label_places(F.col("t"), reading.SEMESTER), t="nothing") == []


def test_dictionary_matches_take_the_longest(spark):
    texts = spark.createDataFrame([(1, "a b c a b".split()), (2, ["z"]), (3, [])], "text_id long, tokens array<string>")
    terms = spark.createDataFrame([("a", 1), ("a b", 2), ("b c a", 3), ("a b", 9)], "term string, id long")
    got = sorted(tuple(r) for r in reading.dictionary_matches(texts, terms, 3).collect())
    assert got == [(1, 0, "a", 1), (1, 1, "b c a", 3)]  # "a b" overlaps the longer one on both sides


def test_attached_items(spark):
    boxes = "page long, {} long, left double, right double, top double, bottom double"
    items = spark.createDataFrame([(1, 1, 4.0, 6.0, 4.0, 6.0), (1, 2, 4.0, 6.0, 14.0, 16.0), (1, 3, 44.0, 46.0, 14.0, 16.0), (1, 4, 4.0, 6.0, 90.0, 92.0), (2, 5, 4.0, 6.0, 4.0, 6.0)], boxes.format("item"))
    regions = spark.createDataFrame([(1, 10, 0.0, 10.0, 0.0, 10.0), (1, 11, 40.0, 50.0, 0.0, 10.0), (1, 12, 42.0, 52.0, 2.0, 10.0)], boxes.format("region"))
    got = {r["item"]: r.region for r in reading.attached(items, regions, 12.0).collect()}
    assert got == {1: 10, 2: 10, 3: None, 4: None, 5: None}  # 3 lies below two regions that end alike


def test_key_paths(spark):
    rows = spark.createDataFrame([(1, '{"a":[{"Token":1},{"b":{"token":null}}],"c":"token"}'), (2, None), (3, "not json")], "id long, body string")
    assert sorted(tuple(r) for r in reading.key_paths(rows, "id", "body", ["token"]).collect()) == [(1, "a.0.Token"), (1, "a.1.b.token")]


def test_folded_ids_and_character_diff(spark):
    rows = spark.createDataFrame([(1, "ns1:", "NS2%25253Adoc‐x ｎｓ1:doc ns2:doc")], "id long, own string, text string")
    assert [tuple(r) for r in reading.foreign_ids(rows, "id", "text", r"ns\d+:doc", "own").collect()] == [(1, "ns2:doc")]
    got = one(spark, reading.character_diff(F.col("a"), F.col("b")), a="c0ldd", b="cold")
    assert (got.missing, got.invented) == ("o", "0d")


def test_states_none(spark):
    for text, want in (("None", True), ("n/a.", True), ("— no pre-requisite(s) —", True), ("–", True), ("none?", False), ("", False), ("PX 1", False)):
        assert one(spark, ingestion.states_none(F.col("t")), t=text) is want, text


def test_pointer_moves(spark):
    log = [(1, "a", "rollback"), (2, "a", "activate"), (3, "b", "activate"), (4, "bad", "activate"), (5, "a", "rollback"), (6, "bad", "rollback")]
    events = spark.createDataFrame([("s", i, r, k) for i, r, k in log], "space string, seq long, release string, action string")
    moves = releases.pointer_moves(events, spark.createDataFrame([("a",), ("b",)], "release string")).orderBy("seq").collect()
    assert [(m.applied, m.active, m.superseded) for m in moves] == [(False, None, None), (True, "a", None), (True, "b", "a"), (False, "b", None), (True, "a", "b"), (False, "a", None)]


def test_span_coverage(spark):
    spans = [(1, 0, 2), (1, 2, 5), (2, 0, 2), (2, 3, 5), (3, 0, 3), (3, 2, 5), (4, 1, 5), (5, 0, 4), (6, 0, 0)]
    sizes = spark.createDataFrame([(i, 5) for i in range(1, 8)], "id long, size long")
    got = {r.id: r.coverage for r in releases.span_coverage(spark.createDataFrame(spans, "id long, start long, stop long"), sizes).collect()}
    assert got == {1: "covered", 2: "gap", 3: "overlap", 4: "late_start", 5: "wrong_end", 6: "empty_span", 7: "none"}


def test_near_leaks(spark):
    items = spark.createDataFrame([(1, "a b c d e".split()), (2, []), (3, ["q"])], "item_id long, tokens array<string>")
    texts = spark.createDataFrame([(1, "e d c b a a".split()), (2, "a b c d".split()), (3, "a b x y z".split()), (4, [])], "doc_id long, tokens array<string>")
    assert sorted((r.item_id, r.doc_id, r.similarity) for r in releases.near_leaks(items, texts, 0.8).collect()) == [(1, 1, 1.0), (1, 2, 0.8)]


def test_call_states(spark):
    calls = spark.createDataFrame([("f", {"a": "1"}), ("f", {"a": ""}), ("f", {"a": "1", "b": "2"}), ("g", {})], "operation string, arguments map<string,string>")
    assert [r.state for r in capabilities.call_states(calls, {"f": ("a",)}).collect()] == ["ok", "missing_argument", "unknown_argument", "unsupported"]


def test_attached_copies_and_items_of_two_boxes(spark):
    """Regions alike are a tie, an item of two boxes goes by the nearer one."""
    boxes = "page long, {} long, left double, right double, top double, bottom double"
    items = spark.createDataFrame([(1, 1, 4.0, 6.0, 4.0, 6.0), (1, 2, 4.0, 6.0, 14.0, 16.0), (1, 2, 24.0, 26.0, 4.0, 6.0)] + [(1, i, 24.0, 26.0, 4.0, 6.0) for i in range(3, 40)], boxes.format("item"))
    regions = spark.createDataFrame([(1, 10, 0.0, 10.0, 0.0, 10.0), (1, 11, 0.0, 10.0, 0.0, 10.0), (1, 12, 20.0, 30.0, 0.0, 10.0)], boxes.format("region"))
    found = reading.attached(items, regions, 12.0)
    assert sorted({(r["item"], r.region) for r in found.collect()}) == [(1, None)] + [(i, 12) for i in range(2, 40)] and found.count() == items.count()
    assert reading.attached(items, regions.limit(0), 12.0).where("region IS NULL").count() == items.count()


def test_term_words(spark):
    """Borders are those of ASCII, as in DuckDB; a null text has no words."""
    assert one(spark, text.term_words(F.col("t")), t="Not énot notñ no_t; NEVER, knot") == ["not", "not", "not", "never"]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(text.term_words(F.col("t"))).first()[0] is None
