import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerleaf.llm import mixing

from .helpers import docs, rows


def fill(children, budget):
    """Water-filling by halving the level, for {child: (weight, cap)}."""
    low, high = 0.0, 1e18
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for w, c in children.values()) < budget else (low, mid)
    return {k: min(c, w * high) for k, (w, c) in children.items()}


def by_name(lang, source):
    return "s" if (source or "") < "src2" else "t", lang, source


def slow_mix(data, weights, share, epochs, seed, path=by_name):
    leaf = defaultdict(list)
    for i, text, lang, source, *_ in data:
        leaf[path(lang, source)].append((i, max(1, -(-len((text or "").encode()) // 4))))
    cap = {p: epochs * sum(t for _, t in d) for p, d in leaf.items()}
    shares = {(): share * sum(cap.values()) / epochs}
    for depth in range(3):
        for parent in [p for p in shares if len(p) == depth]:
            kids = {p[: depth + 1] for p in leaf if p[:depth] == parent}
            shares |= fill({k: (weights.get(k, 1.0), sum(c for p, c in cap.items() if p[: depth + 1] == k)) for k in kids if weights.get(k, 1.0) > 0}, shares[parent])
    out = []
    for p, d in leaf.items():
        budget = int(shares.get(p, 0) + 1e-6)
        full, rest = divmod(budget, sum(t for _, t in d))
        key = lambda i: (hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest(), i or 0)  # noqa: B023, E731
        out += [(i, e) for i, _ in d for e in range(full)]
        spent = 0
        for k in sorted({key(i) for i, _ in d}):
            own = [(i, t) for i, t in d if key(i) == k]
            spent += sum(t for _, t in own)
            if spent > rest:
                break
            out += [(i, full) for i, _ in own]
    return sorted(out, key=str)


def _run(spark, table, share, epochs):
    path = {"d": F.when(F.coalesce("source", F.lit("")) < "src2", "s").otherwise("t"), "l": F.col("lang"), "source": F.col("source")}
    weights = {"d": spark.createDataFrame([("s", 3.0), ("t", 1.0)], "d string, weight double"), "l": spark.createDataFrame([("s", "en", 2.0), ("t", "de", 0.0), ("s", None, 5.0)], "d string, l string, weight double")}
    return mixing.mix(table, path, weights, share, epochs, seed=9)


WEIGHTS = {("s",): 3.0, ("t",): 1.0, ("s", "en"): 2.0, ("t", "de"): 0.0, ("s", None): 5.0}


def test_matches_brute_force(spark, monkeypatch):
    data = [(i, "x" * (i * 37 % 101), ["en", "de", None][i % 3], f"src{i % 4}", 0, "", 0, "", "") for i in range(200)]
    for share, epochs, size in ((0.4, 2, 4096), (0.9, 3, 4)):
        monkeypatch.setattr(mixing, "ROWS_IN_BUCKET", size)
        got = sorted(((r.doc_id, r.mix_epoch) for r in _run(spark, docs(spark, data), share, epochs).collect()), key=str)
        assert got == slow_mix(data, WEIGHTS, share, epochs, 9)


def test_edges(spark):
    got = sorted(((r.doc_id, r.mix_epoch) for r in _run(spark, docs(spark), 0.7, 1).collect()), key=str)
    assert got == slow_mix(rows(), WEIGHTS, 0.7, 1, 9)
    assert _run(spark, docs(spark, []), 0.5, 1).count() == 0
