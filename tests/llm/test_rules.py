import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import rules
from ledgerleaf.llm.queries import op11_quality_rules

from .helpers import EN, docs, rows

SF = "/root/testdata/sf0.01"


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)]


def _own(texts):
    found = rules.statistics([(t or "").encode() for t in texts])
    return [[int(found[c][i]) for c in rules.COUNTS] for i in range(len(texts))]


PART = st.sampled_from(["a", "b", "é", "你好", " ", " ", "\n", "\t", "\x0b", "\x85", " ", "#", "<|", "a b c d e f g h ", "line one\n", "x" * 40])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PART, max_size=40).map("".join), min_size=1, max_size=4))
def test_counts_equal_brute_force(texts):
    assert _own(texts) == [_counts(t) for t in texts]


def test_slices_and_long_words(monkeypatch):
    texts = ["", EN * 40 + "\n" + "é" * 999 + "\n" + EN * 2, "y" * 5000, " ", "a\n" * 30, EN]
    monkeypatch.setattr(rules, "CHUNK", 64)
    assert _own(texts) == [_counts(t) for t in texts]


def test_rows_of_every_kind(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (2, None, "x"), (9, 0, "x"), (None, 0, "x"), (4, 1, "x"), (13, 0, "x"), (99, 0, "x")], "doc_id long, quality int, text string")
    got = rules.quality_rules(docs(spark), labels).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in rules.COUNTS)) for r in got) == sorted((str(i), *_counts(t)) for i, t, *_ in rows())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed) and 0 <= r.score <= 1 for r in got)
    assert rules.quality_rules(docs(spark, []), labels).count() == 0
    alone = rules.quality_rules(docs(spark), labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.describe(docs)
    forest = rules.train(stats, labels.where("doc_id % 2 = 0"))
    told = rules.judge(stats, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "base_failed", "quality").collect()
    good, poor = ([r for r in told if r.quality == q] for q in (1, 0))
    assert len(poor) > 10 and sum(not r.kept for r in poor) / len(poor) > 0.8
    assert sum(r.kept or r.base_failed for r in good) / len(good) > 0.98
    assert op11_quality_rules(spark, SF).count() == docs.count()


@pytest.mark.parametrize("sign", [1, -1])
def test_constraints_hold(sign):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    good = x[:, 0] * sign + 0.4 * np.sin(9 * x[:, 0]) * x[:, 1] + 0.3 * rng.normal(size=3000) > 0.3 * sign
    free, bound = (rules.fit(x, good, s) for s in ([0, 0, 0], [sign, 0, 0]))
    probe = rng.random((200, 3))
    steps = np.repeat(probe[:, None], 50, axis=1)
    steps[:, :, 0] = np.linspace(0, 1, 50)
    rise = [np.diff(f.margins(steps.reshape(-1, 3)).reshape(200, 50) * sign, axis=1) for f in (free, bound)]
    assert rise[0].min() < -1e-6 and rise[1].min() >= -1e-9


def test_flat_arrays_score_as_a_walk_does():
    rng = np.random.default_rng(8)
    x = rng.random((500, 4))
    forest = rules.fit(x, (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5), [0] * 4, trees=5, depth=3)

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return total

    assert np.allclose(forest.margins(x), [walk(r) for r in x]) and np.mean((forest.margins(x) > 0) == ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5))) > 0.9
