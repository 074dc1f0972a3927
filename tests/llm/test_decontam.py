import hashlib
import random

import pytest

from ledgerleaf.llm import decontam

from .helpers import DE, EN, docs, rows

ITEMS = [(1, EN), (2, "The CAT, sat! on"), (3, None), (4, "..."), (5, DE + "nothing else"), (6, "two"), (6, "two")]


def _items(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, n_hit int")


def _rows(frame):
    return sorted((tuple(r) for r in decontam.digest(frame).collect()), key=str)


@pytest.mark.parametrize("most", [decontam.MAX_ITEM_BYTES, 60])
def test_query_matches_brute_force(spark, most):
    """In one pass and in several; one of the hit rows has no id, and two have the same."""
    data = rows() + [(None, f"{EN} without id", "en", "s", 1, "", 0, "", ""), (11, EN[5:80], "en", "s", 1, "", 0, "", "")]
    table = docs(spark, data)
    want = []
    for r in table.collect():
        n_words, n_hit, n_items, sha = decontam.brute_force(r.text, ITEMS)
        want.append((r.doc_id, n_words, n_hit, n_items, sha, n_hit > 0))
    found = decontam.contamination(table, _items(spark), max_item_bytes=most)
    assert _rows(found) == sorted(want, key=str)
    one = decontam.contamination(table, _items(spark))
    assert sorted(map(str, found.select("doc_id", "item_ids", "spans").collect())) == sorted(map(str, one.select("doc_id", "item_ids", "spans").collect()))


def test_random_texts_match_brute_force():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "ä", "C", "d."]) for _ in range(n))
    for size in (1, 2, 3, 4, 10):
        items = [(i, text(rng.randint(0, 14))) for i in range(30)]
        found = decontam.Blocks(items, size)
        for _ in range(60):
            t = text(rng.randint(0, 60))
            n, runs, ids = decontam.scan(t, found)
            sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
            assert (n, sum(r[1] - r[0] for r in runs), len(ids), sha) == decontam.brute_force(t, items, size)


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 7)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(5, 60)))) for i in range(6)]
    table = docs(spark, [(i, " ".join(rng.choice("abcd") for _ in range(40)) + " " + items[i % 6][1][20:70], "en", "s", 1, "", 0, "", "") for i in range(20)])
    want = [(r.doc_id, *decontam.brute_force(r.text, items)) for r in table.collect()]
    assert [r[:5] for r in _rows(decontam.contamination(table, _items(spark, items)))] == sorted(want, key=str)


def test_spans_lie_in_the_original_text():
    text = "İx, Before -- THE cat; sat\non The MAT after"
    spans = decontam.scan(text, decontam.Blocks([(1, "the cat sat on the mat")]))[1]
    assert [text[a:b] for _, _, a, b in spans] == ["THE cat; sat\non The MAT"]


def test_empty_tables(spark):
    assert _rows(decontam.contamination(docs(spark, []), _items(spark))) == []
    assert {r[2] for r in _rows(decontam.contamination(docs(spark), _items(spark, [])))} == {0}


def test_keep_clean_keeps_all_columns(spark):
    table = docs(spark, rows() + [(None, f"{EN} without id", "en", "s", 1, "", 0, "", "")])
    want = sorted((tuple(r) for r in table.collect() if decontam.brute_force(r.text, ITEMS[:5])[1] == 0), key=str)
    for most in (decontam.MAX_ITEM_BYTES, 60):
        kept = decontam.keep_clean(table, _items(spark, ITEMS[:5]), max_item_bytes=most)
        assert kept.columns == table.columns and sorted(map(tuple, kept.collect()), key=str) == want
