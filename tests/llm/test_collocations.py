from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import re

from ledgerleaf.llm import collocations as co

from .helpers import docs, rows


def _brute(data, least, percent=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = {}
    longer = [(k, c) for k, c in f.items() if len(k) == 4 and c >= least]
    for key, a in f.items():
        lang, words = key[0], key[1:]
        if len(words) < 2 or a < least:
            continue
        if len(words) == 2 and any(100 * c >= percent * a for k, c in longer if k[0] == lang and words in (k[1:3], k[2:4])):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for r, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


def _own(spark, data, **more):
    return sorted(map(tuple, co.collocations(docs(spark, data), **more).collect()))


MORE = [(50, "of. The: end? of the the THE the of\tthe\fend\x0bof the", None, "x", 1), (51, "New York city, new york city; new york\nnew York state", "und", "x", 1), (52, "Ä ä É é Ö " * 9, "de", None, 1)]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_equals_brute_force(spark, monkeypatch, least):
    data = [(i, t, la, s, 0, "c", 1, "c", "c") for i, t, la, s, *_ in [*rows(), *MORE, *MORE]]
    monkeypatch.setattr(co, "BUNDLE", 40)
    monkeypatch.setattr(co, "CHUNK", 64)
    assert _own(spark, data, least=least) == _brute(data, least)


def test_only_the_best_are_kept(spark):
    assert _own(spark, rows(), least=2, top=3) == _brute(rows(), 2, top=3)


def test_colliding_words_get_another_seed(spark, monkeypatch):
    monkeypatch.setattr(co, "SPARE_BITS", -2)
    vocabulary = spark.createDataFrame([("en", f"w{i}", 1) for i in range(60)], "lang string, word string, f long")
    out, seed, width, total = co.numbered(vocabulary)
    assert out.select("id").distinct().count() == 60 and total == 60 and width == 10 and seed > 0


def test_empty_tables(spark):
    assert _own(spark, []) == []
    assert _own(spark, [(1, None, "en", "x", 1, "c", 1, "c", "c"), (2, "", None, "x", 1, "c", 1, "c", "c")], least=1) == []


def test_lockstep_at_every_cut():
    """What a row gets doesn't depend on where batches end."""
    stream = [(1, None, None, 50), (1, 2, None, 20), (1, 2, 3, 12), (1, 2, 4, 15), (1, 5, None, 11), (2, None, None, 40), (3, None, None, 30), (3, 1, None, 25), (3, 1, 1, 24)]
    table = pa.RecordBatch.from_arrays([pa.array([r[k] for r in stream], pa.int64()) for k in range(4)], names=["a", "b", "c", "f"])
    run = co._lockstep(("word", "pair", "most"))
    def told(batches):
        return sorted((tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()), key=str)
    want = told([table])
    assert (1, 2, None, 20, 50, 0, 15) in want and (3, 1, 1, 24, 30, 25, 0) in want and (1, 5, None, 11, 50, 0, 0) in want
    for i in range(len(stream) + 1):
        for j in range(i, len(stream) + 1):
            assert told([table.slice(0, i), table.slice(i, j - i), table.slice(j)]) == want


def test_wide_vocabularies_are_packed_otherwise():
    rng = np.random.default_rng(4)
    a, b, c = rng.integers(1, 5, (3, 200))
    narrow, wide = ([x.tolist() for x in co._distinct_triples(a, b, c, bits)] for bits in (4, 24))
    assert narrow == wide and sum(narrow[3]) == 200
    assert dict(zip(zip(*narrow[:3]), narrow[3])) == Counter(zip(a.tolist(), b.tolist(), c.tolist()))


def test_pairs_hash_as_in_spark(spark):
    rows = [(0, 0), (1, 2), (2**61, 5), (7, 2**40 + 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").selectExpr("xxhash64(a, b)").collect()]
    a, b = (np.array(x, np.int64) for x in zip(*rows))
    assert co._pair_hash(a, b).tolist() == got


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    data = [(i, t, la, s, 0, "c", 1, "c", "c") for i, t, la, s, *_ in [*rows(), *MORE, *MORE]]
    monkeypatch.setattr(co, "frequent_filter", lambda frequent, key: np.full(1 << 12, 255, np.uint8))
    assert _own(spark, data, least=2) == _brute(data, 2)
