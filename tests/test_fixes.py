import random

from ledgerleaf.operators import fixes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_all_within_two_edits(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("PXO01IéS", k=rng.randint(1, 6)))
    read, known = [word() for _ in range(60)], [word() for _ in range(80)]
    same = lambda t: t.translate(str.maketrans(fixes.CONFUSED, fixes.FOR))
    want = {}
    for t in set(read):
        near = sorted(((distance(t, k) + distance(same(t), same(k))) / 2, distance(t, k), k) for k in set(known) if distance(t, k) <= 2)
        want |= {(t, k): (d, c, i) for i, (c, d, k) in enumerate(near, 1)}
    frame = lambda ts: spark.createDataFrame([(t,) for t in [*ts, *ts[:3], None, "", "x" * 50]], "text string")
    got = {(r.text, r.proposal): (r.edits, r.cost, r["rank"]) for r in fixes.proposals(frame(read), frame(known)).collect()}
    assert got == want and len(want) > 50


def test_dropped(spark):
    got = spark.createDataFrame([("abc",), ("a",), ("",)], "t string").select(fixes.dropped(fixes.F.col("t"), 2)).collect()
    assert [set(r[0]) for r in got] == [{"abc", "ab", "ac", "bc", "a", "b", "c"}, {"a", ""}, {""}]
