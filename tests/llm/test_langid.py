import zlib

import pytest

from ledgerleaf.llm import langid
from ledgerleaf.llm.queries import op5_language_id

from .helpers import docs


def out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def check(table, model=None):
    """Every row's prediction against brute force on the labelled rows, each once."""
    rows = table.collect()
    labelled = [(la, t) for la, t, _ in {(r.lang, r.text, r.doc_id) for r in rows if not out(r.doc_id) and r.lang is not None and r.text is not None}]
    got = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in langid.identify(table, model or langid.train(table)).collect()}
    for r in rows:
        lang, score = langid.brute_force(labelled, r.text)
        assert got[r.doc_id, out(r.doc_id)][0] == lang
        assert got[r.doc_id, out(r.doc_id)][1] == pytest.approx(score, abs=1e-5)
    return got


def test_edges_and_brute_force(spark):
    got = check(docs(spark))
    assert got[5, out(5)] == ("und", 0.0)
    assert langid.identify(docs(spark, []), langid.train(docs(spark, []))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark), langid.train(docs(spark, []))).collect()} == {"und"}


def _table(spark, rows):
    return docs(spark, [(i, t, la, "s", 1, "", 0, "", "") for i, t, la in rows])


def test_many_languages_and_ties(spark):
    rows = [(i, " ".join(f"{'abcdefghij'[(i + j) % 10] * (j % 4 + 1)}x" for j in range(12)), f"l{i:03d}") for i in range(60)]
    rows += [(100 + i, "same words here same words here", f"tie{i}") for i in range(8)]  # equal scores: the first by name
    got = check(_table(spark, rows))
    first = min(la for i, _, la in rows if la.startswith("tie") and not out(i))
    assert {got[i, out(i)][0] for i in range(100, 108)} == {first}


def test_rare_languages_are_not_learnt_beyond_the_bound(spark):
    rows = [(i, f"alpha beta w{i % 7}x", "common") for i in range(40)] + [(50, "gamma delta", "rare"), (51, "gamma delta", "rare")]
    model = langid.train(_table(spark, rows), max_languages=1)
    assert model.langs == ["common"] and model.predict(["gamma delta"])[0][0] == "common"


def test_long_words_count_whole(spark):
    """Words of thousands of letters that differ only near their end."""
    rows = [(i, "a" * 260 + ("uv" if i % 2 else "yz") * 3, "ab"[i % 2]) for i in range(6)]
    check(_table(spark, rows))
    model = langid.train(_table(spark, rows))
    assert [p[0] for p in model.predict(["a" * 250 + "uv" * 4, "a" * 250 + "yz" * 4])] == ["b", "a"]


def test_fitting_rows_are_bounded(spark):
    table = _table(spark, [(i, "word" + "abcdefghij"[i % 10] + "abcdefghij"[i // 10] + " common ", "en") for i in range(100)])
    few = langid.train(table, rows_per_language=5)
    assert set(few.words.rows) == {"common"}
    assert len(few.parts.rows) < len(langid.train(table).parts.rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    found = op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert found and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_unseen_words_back_off(spark):
    model = langid.train(docs(spark))
    assert "cats" not in model.words.rows and model.predict(["cats"])[0][0] in model.langs
