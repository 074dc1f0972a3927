import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, key string, width string, positives int"
ANCHOR = "vec_id % 10 = 0"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", "clash", 1) for i, v, lab in rows], SCHEMA)


def _mined(spark, rows, **more):
    return sorted(map(tuple, negatives.mine(_frame(spark, rows), F.expr(ANCHOR), F.col("label"), **more).collect()))


def _brute(rows, **more):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows]
    return sorted((a, p, r, n, ps, ns) for a, p, r, n, ps, ns in negatives.brute_force(whole, [i for i, *_ in rows if i % 10 == 0], **more))


@pytest.mark.parametrize("blocks", [(4096, 4096), (16, 3)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + (i % 3)).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(200 + i, rows[7][1], i % 3) for i in range(30)]  # many equal scores
    rows += [(300, [0.0] * 6, 1), (301, [0.0] * 6, 2), (310, [-1.0] * 6, 0)]
    assert _mined(spark, [*rows, rows[0], rows[7]]) == _brute(rows)  # repeated rows count once


def test_unusable_rows_take_no_part(spark):
    rows = [(10, [1.0, 1.0], 0), (11, [1.0, 0.5], 0), (12, [0.5, 0.5], 1)]
    bad = [(13, None, 1), (14, [math.nan, 1.0], 1), (15, [math.inf, 1.0], 1), (16, [None, 1.0], 1), (17, [1.0, 1.0], None), (None, [0.5, 0.5], 1), (18, [0.5], 1), (20, [], 1), (21, [], 0)]
    assert _mined(spark, rows + bad)[-1:] == _brute(rows) == [(10, 11, 1, 12, 98304, 65536)]
    assert _mined(spark, []) == []
    assert _mined(spark, rows[:1]) == []  # no positive


def test_reads_the_lists_only_as_deep_as_needed():
    rng = np.random.default_rng(1)
    rows = rng.integers(-5, 6, (2000, 4))
    rows[:30] += 1000
    lists = negatives.Lists(np.arange(2000), np.ones(2000, int), rows, 5)
    anchor = np.array([3, 5, 0, 1])
    (at, scores), = lists.search(-1, 1, anchor, True, [None], 10)
    want = sorted(range(2000), key=lambda i: (-int(rows[i] @ anchor), i))[:10]
    assert at.tolist() == want and scores == [int(rows[i] @ anchor) for i in want]
    assert lists.scored < 200
    (far, _), = lists.search(-1, 2, anchor, False, [(30, 90, 100_000)], 10)
    assert all(30_000 <= int(rows[i] @ anchor) <= 90_000 for i in far)


def test_integers_beyond_floats_stay_exact():
    big = 2**40
    rows = np.array([[big, 1], [big, 2], [big, 3]])
    (at, scores), = negatives.Lists(np.array([5, 6, 7]), np.zeros(3, int), rows, big).search(0, 0, np.array([big, 1]), True, [None], 2)
    assert at.tolist() == [2, 1] and scores == [big * big + 3, big * big + 2]
