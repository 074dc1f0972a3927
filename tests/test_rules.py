import random

import pytest

from ledgerleaf.operators import graphs, rules

from . import planning_brute as brute

NODES = "owner_id long, node_id int, parent_id int, ordinal int, depth int, kind string, ref_id long"
FACTS = "subject_id long, course_id long, passed boolean, failed boolean, enrolled boolean"

ONE = [(0, None, 0, 0, "course", 1)]
CO = [(0, None, 0, 0, "co_requisite", 1)]
ALL = [(0, None, 0, 0, "all_of", None), (1, 0, 0, 1, "course", 1), (2, 0, 1, 1, "course", 3)]
ANY = [(0, None, 0, 0, "any_of", None), *ALL[1:]]
OPEN = [(0, None, 0, 0, "unresolved", None)]
NONE = [(0, None, 0, 0, "verified_none", None)]
# tree, passed, failed, enrolled -> outcome, coverage
TRUTH = [
    (ONE, [1], [], [], "eligible", "complete"),
    (ONE, [], [1], [], "ineligible", "complete"),
    (ONE, [], [], [], "unknown", "complete"),
    (ONE, [1], [1], [], "unknown", "complete"),
    (ALL, [1, 3], [], [], "eligible", "complete"),
    (ALL, [], [1], [], "ineligible", "complete"),
    (ALL, [1], [], [], "unknown", "complete"),
    (ANY, [1], [], [], "eligible", "complete"),
    (ANY, [], [1], [], "unknown", "complete"),
    (ANY, [], [1, 3], [], "ineligible", "complete"),
    (CO, [], [], [1], "eligible", "complete"),
    (CO, [], [], [], "unknown", "complete"),
    (OPEN, [1], [], [], "unknown", "partial"),
    (NONE, [], [], [], "eligible", "complete"),
    ([], [1], [], [], "unknown", "absent"),
]


def test_truth_table(spark):
    nodes = [(i, *n) for i, (tree, *_) in enumerate(TRUTH) for n in tree]
    facts = [(i, c, c in p, c in f, c in e) for i, (_, p, f, e, *_) in enumerate(TRUTH) for c in {*p, *f, *e}]
    asked = spark.createDataFrame([(i, i) for i in range(len(TRUTH))], "subject_id long, owner_id long")
    found = rules.evaluate(asked, spark.createDataFrame(nodes, NODES), spark.createDataFrame(facts, FACTS), 1)
    got = {r.owner_id: (r.outcome, r.coverage) for r in found.collect()}
    assert got == {i: t[4:] for i, t in enumerate(TRUTH)}


def test_lists_of_a_conflict_and_of_a_first_choice(spark):
    tree = [(9, 0, None, 0, 0, "all_of", None), (9, 1, 0, 0, 1, "course", 1), (9, 2, 0, 1, 1, "any_of", None), (9, 3, 2, 0, 2, "course", 2), (9, 4, 2, 1, 2, "course", 3)]
    facts = [(1, 1, True, True, False), (1, 2, False, True, False), (2, 1, True, False, False), (2, 3, True, False, False), (2, 2, False, True, False)]
    asked = spark.createDataFrame([(1, 9), (2, 9)], "subject_id long, owner_id long")
    got = {r.subject_id: r for r in rules.evaluate(asked, spark.createDataFrame(tree, NODES), spark.createDataFrame(facts, FACTS), 2).collect()}
    assert (got[1].outcome, got[1].violated, got[1].unknown, got[1].conflicts) == ("unknown", [], ["completion_unknown:3"], ["completion_conflict:1"])
    assert (got[2].outcome, got[2].satisfied) == ("eligible", ["passed:1", "passed:3"])


@pytest.mark.parametrize("seed", range(5))
def test_trees_equal_a_recursion(spark, seed):
    rng = random.Random(seed)
    trees = {o: brute.some_rule(rng, list(range(6))) for o in range(40)}
    passed, failed, enrolled = ({c for c in range(6) if rng.random() < 0.4} for _ in range(3))
    facts = [(0, c, c in passed, c in failed, c in enrolled) for c in range(6)]
    asked = spark.createDataFrame([(0, o) for o in trees], "subject_id long, owner_id long")
    nodes = [n for o, t in trees.items() for n in brute.nodes_of(o, t)]
    got = {r.owner_id: r.outcome for r in rules.evaluate(asked, spark.createDataFrame(nodes, NODES), spark.createDataFrame(facts, FACTS), 2).collect()}
    assert got == {o: brute.named(brute.verdict(t, passed, failed, enrolled)) for o, t in trees.items()}


def test_closure_and_cycles(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(45)]
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in edges if b == c} - want
        if not more:
            break
        want |= more
    frame = spark.createDataFrame(edges, "src long, dst long")
    closed = graphs.closure(frame)
    assert {tuple(r) for r in closed.collect()} == want
    ring = {a: len({b for x, b in want if x == a and (b, a) in want}) for a, _ in want if any((b, a) in want for x, b in want if x == a)}
    assert {r.node: r.members for r in graphs.cyclic(closed).collect()} == ring
    roots = spark.createDataFrame([(0,), (7,)], "root long")
    assert {tuple(r) for r in graphs.bounded_closure(frame, roots).collect()} == {(a, b) for a, b in want if a in (0, 7) and a != b}
    assert graphs.closure(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_cycles_and_sets_without_the_closure(spark, seed):
    """Rings that feed one another, loops, ends and a part without cycles; sets of more nodes than one array holds."""
    rng = random.Random(seed)
    edges = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(50)} | {(i, 100 + (i - 99) % 8) for i in range(100, 108)} | {(7, 100), (107, 200), (200, 201), (201, 201), (201, 202), (300, 301), (301, 302)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    ring = {a: len({b for x, b in want if x == a and (b, a) in want}) for a, _ in want if any((b, a) in want for x, b in want if x == a)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.node: r.members for r in graphs.cycles(frame).collect()} == ring
    graphs.CHUNK, whole = 3, graphs.CHUNK
    try:
        sets = graphs.reached_sets(frame).collect()
    finally:
        graphs.CHUNK = whole
    pairs = [(r.src, d) for r in sets for d in r.reached]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and max(len(r.reached) for r in sets) == 3


def test_many_leaves_and_subjects_of_one_case(spark):
    """More leaves than one word of bits holds; a null subject has no verdict; each case is evaluated once."""
    tree = [(1, 0, None, 0, 0, "all_of", None)] + [(1, i, 0, i, 1, "course", i) for i in range(1, 46)]
    facts = [(s, c, True, False, False) for s in (1, 2) for c in range(1, 46)] + [(3, c, c != 44, c == 44, False) for c in range(1, 46)]
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (None, 1)], "subject_id long, owner_id long")
    got = {r.subject_id: r for r in rules.evaluate(asked, spark.createDataFrame(tree, NODES), spark.createDataFrame(facts, FACTS), 1).collect()}
    assert {s: (r.outcome, r.coverage) for s, r in got.items()} == {1: ("eligible", "complete"), 2: ("eligible", "complete"), 3: ("ineligible", "complete"), 4: ("unknown", "complete"), None: ("unknown", "absent")}
    assert got[3].violated == ["not_completed:44"] and len(got[3].satisfied) == 44 and len(got[4].unknown) == 45
    leaves = spark.createDataFrame([(1, i - 1, i) for i in range(1, 46)], "owner_id long, at int, ref_id long")
    words = rules.fact_words(asked, leaves, spark.createDataFrame(facts, FACTS), 3).where("subject_id < 3").select("w0", "w1", "w2").distinct().collect()
    assert len(words) == 1 and words[0].w0 == sum(1 << 3 * i for i in range(20))
