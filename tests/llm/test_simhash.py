import random

import numpy as np
import xxhash

from ledgerleaf.llm import simhash
from ledgerleaf.llm.components import connected_components

from .helpers import docs


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, tau=4):
    ids = sorted({i for i, _ in pairs if i is not None})
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in pairs:
            for j, b in pairs:
                if i is not None and j is not None and (a ^ b).bit_count() <= tau and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_query_matches_brute_force(spark):
    table = docs(spark)
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in table.collect()]
    label = slow_components(prints)
    got = sorted((tuple(r) for r in simhash.near_duplicates(table).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", label.get(i)) for i, f in prints), key=str)
    assert label[2] == label[3] == 1 and label[7] == 5


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def _cloud(rng, n):
    out = set()
    for _ in range(n // 20):
        centre = rng.getrandbits(64)
        for _ in range(20):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
    return out | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # one dense group


def test_links_connect_all_near_pairs(spark, monkeypatch):
    rng = random.Random(1)
    prints = sorted(_cloud(rng, 600))
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    signed = {int(np.uint64(x).astype(np.int64)): x for x in prints}
    want, todo = {}, set(prints)
    while todo:
        seed = min(todo)
        group, front = {seed}, [seed]
        todo.discard(seed)
        while front:
            a = front.pop()
            near = {b for b in todo if (a ^ b).bit_count() <= 4}
            todo -= near
            group |= near
            front += near
        want |= {x: frozenset(group) for x in group if len(group) > 1}
    for block in (simhash.BLOCK, 64):  # with and without split buckets
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = connected_components(simhash.links(frame)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.root, set()).add(signed[r.node])
        assert {x: frozenset(g) for g in groups.values() for x in g} == want


def test_plans_lose_no_pair():
    sample = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    for n in (10, 10**5, 10**8, 10**10):
        parts = simhash.plan(sample, n, 4)
        unused = bin(~sum(p.mask for p in parts) & (2**64 - 1)).count("1")
        assert sum(p.threshold + 1 for p in parts) == 5 and (unused == 0 or any(p.threshold for p in parts) or len(parts) == 5)
    assert {p.threshold for p in simhash.plan(sample, 10**8, 4)} != {0}  # unequal thresholds pay at scale


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 9, 20], [0, 1, 2, 30], [0, 7, 9, 11]]
    from itertools import product

    for total in range(-3, 7):
        best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in product(range(-1, 3), repeat=3) if sum(ts) == total)
        assert simhash.allocate(costs, total)[0] == best
