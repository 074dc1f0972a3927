import itertools
import random
import re

import pytest

from ledgerleaf.operators import grids

CODE = re.compile(grids.CODE.removeprefix("(?i)"), re.I)
NO_CODE = re.compile(grids.NO_CODE.removeprefix("(?i)"), re.I)


def is_code(t):
    t = " ".join(t.split())
    return len(t) <= 25 and not NO_CODE.search(t) and bool(CODE.match(t))


def is_units(t):
    return bool(re.match(grids.UNITS, " ".join(t.split())))


def search(grid):
    """Every cut of a table into one or two groups, by exhaustion: the best pair of unit columns, else of code columns."""
    n = max(map(len, grid))
    codes, units = ([sum(f(r[c]) for r in grid if c < len(r)) for c in range(n)] for f in (is_code, is_units))
    if len(grid) < 2:
        return []
    first = lambda score, cs, key=None: next((c for c in cs if (score[c], (key(c) if key else 0)) == max((score[x], key(x) if key else 0) for x in cs)), None)
    some = lambda score, low, high: [c for c in range(low, high) if score[c]]
    pick = lambda score, low, high, other: other if not some(score, low, high) else first(score, some(score, low, high))
    pair = lambda score, cs: max(((a, b) for a, b in itertools.combinations(cs, 2) if b - a >= 3), key=lambda p: (score[p[0]] + score[p[1]], -p[0], -p[1]), default=None)
    found = pair(units, some(units, 0, n))
    if found:
        u1, u2 = found
        c1 = pick(codes, 0, u1, 0)
        between = some(codes, u1 + 1, u2)
        c2 = first(codes, between, lambda c: -abs((u2 - c) - (u1 - c1))) if between else u1 + (u2 - u1) // 2
        return [(c1, c1 + 1, u1, u1 + 1 if c2 > u1 + 1 else u1), (c2, c2 + 1 if u2 > c2 + 1 else c2, u2, u2 + 1 if n > u2 + 1 else u2)]
    coded = [c for c in range(n) if codes[c] >= (1 if len(grid) <= 8 else 2)]
    if not coded:
        return []
    found = pair(codes, coded)
    if found:
        c1, c2 = found
        u1, u2 = pick(units, c1 + 1, c2, c1 + 2), pick(units, c2 + 1, n, min(c2 + 2, n - 1))
        return [(c1, c1 + 1, u1, u1 + 1 if u1 + 1 < c2 else u1), (c2, c2 + 1, u2, u2 + 1 if u2 + 1 < n else u2)]
    c1 = coded[0]
    u1 = pick(units, c1 + 1, n, min(c1 + 2, n - 1))
    u2 = pick(units, u1 + 1, n, None)
    if n >= 6 and u2 is not None:
        c2 = u2 - 1 if u2 > u1 + 1 else u1 + 1
        return [(c1, c1 + 1, u1, u1 + 1 if u2 - u1 >= 3 else u1), (c2, c2, u2, u2)]
    return [(c1, c1 + 1, u1, min(u1 + 1, n - 1))]


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_an_exhaustive_search(spark, seed):
    rng = random.Random(seed)
    texts = ["PX 101", "ABC-12b", "GE Rizal", "NSTP Fit 2", "3", "3/2", "12", "Some title", "TOTAL 18", "YEAR 1", "", "None", "PX 101, PX 102", "A" * 30]
    want, cells = {}, []
    for t in range(150):
        n_rows, n_cols = rng.choice([1, 2, 3, 8, 9, 20]), rng.randint(1, 10)
        liked = [rng.choices(texts, weights=[rng.random() ** 3 for _ in texts], k=1)[0] for _ in range(n_cols)]
        grid = [[c if rng.random() < 0.6 else rng.choice(["", "Some title", "None", *texts[:2], "3"] if rng.random() < 0.2 else ["", "Some title"]) for c in liked] for _ in range(n_rows)]
        want[t] = search(grid)
        cells += [(t, r, c, x or None) for r, row in enumerate(grid) for c, x in enumerate(row)]
    rng.shuffle(cells)
    got = {}
    for r in grids.column_groups(grids.column_scores(spark.createDataFrame(cells, "table_id long, row int, col int, text string"))).collect():
        got.setdefault(r.table_id, {})[r.group] = (r.code_idx, r.title_idx, r.unit_idx, r.prereq_idx)
    assert {t: [g[i] for i in sorted(g)] for t, g in got.items()} == {t: g for t, g in want.items() if g}
    assert {len(g) for g in want.values()} == {0, 1, 2}


def test_no_cells(spark):
    assert grids.column_groups(grids.column_scores(spark.createDataFrame([], "table_id long, row int, col int, text string"))).count() == 0
