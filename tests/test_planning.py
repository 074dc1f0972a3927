import random

import pytest

from ledgerleaf.operators import planning, recovery, rules

from . import planning_brute as brute

NODES = "owner_id long, node_id int, parent_id int, ordinal int, depth int, kind string, ref_id long"


def _nodes(spark, trees):
    return spark.createDataFrame([n for o, r in trees.items() for n in brute.nodes_of(o, r)], NODES)


def _facts(spark, key, known):
    return spark.createDataFrame([(k, c, c in p, c in f, False) for k, (p, f) in known.items() for c in sorted(set(p) | set(f))], f"{key} long, course long, passed boolean, failed boolean, enrolled boolean")


def test_verdicts_carry_over_terms(spark):
    trees = {1: ("verified_none",), 2: ("course", 1), 3: ("course", 1), 4: ("course", 9), 5: ("course", 4), 6: ("co_requisite", 7), 7: ("verified_none",)}
    plan = [(1, 1, 3.0), (1, 2, 3.0), (2, 3, 3.0), (2, 4, 3.0), (3, 5, None), (4, 6, 3.0), (4, 7, 3.0)]
    courses = spark.createDataFrame([(1, *p) for p in plan], "plan_id long, term long, course long, units double")
    got = {r.term: r for r in planning.check_plans(courses, _facts(spark, "plan_id", {1: ([], [9])}), _nodes(spark, trees), 0, 5.0).collect()}
    assert got[1].outcome == "unknown" and got[1].n_needs_info == 1  # a pass of the same term doesn't help
    assert got[2].outcome == "blocked" and got[2].units == 6.0 and got[2].load == "over"
    assert got[3].outcome == "blocked" and got[3].load == "unknown"
    assert got[4].outcome == "works_with_warning"  # taking both at once is enough for a co-requisite


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    trees = {c: brute.some_rule(rng, list(range(12))) for c in range(10)}
    plans = {p: {t: set(rng.sample(range(12), rng.randint(1, 4))) for t in range(rng.randint(1, 6))} for p in range(40)}
    known = {p: tuple({c for c in range(12) if rng.random() < 0.3} for _ in range(2)) for p in plans}
    rows = [(p, t, c) for p, terms in plans.items() for t, cs in terms.items() for c in cs]
    got = planning.term_verdicts(spark.createDataFrame(rows + rows[:3], "plan_id long, term long, course long"), _facts(spark, "plan_id", known), _nodes(spark, trees), 2).collect()
    want = {(p, t, c): v for p, terms in plans.items() for (t, c), v in brute.check_plan(terms, trees, *known[p]).items()}
    assert {(r.plan_id, r.term, r.course): r.verdict for r in got} == want and len(got) == len(want)


def test_empty_plans(spark):
    none = spark.createDataFrame([], "plan_id long, term long, course long, units double")
    assert planning.check_plans(none, _facts(spark, "plan_id", {1: ([1], [])}), _nodes(spark, {1: ("verified_none",)}), 0, 5.0).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_earliest_terms_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    curricula = {k: {100 * k + i: (rng.randrange(3), rng.randrange(9)) for i in range(9)} for k in range(4)}
    trees = {c: brute.some_rule(rng, [r for r in own if r != c]) for own in curricula.values() for c in own if rng.random() < 0.95}
    asked, known, want = [], {}, {}
    for q in range(60):
        k = rng.randrange(4)
        own = curricula[k]
        target, start, last = rng.choice([*own]), rng.randrange(6), rng.randrange(8, 20)
        passed, failed = ({c for c in own if rng.random() < 0.2} for _ in range(2))
        asked.append((q, k, target, start, last))
        known[q] = passed, failed
        want[q] = brute.earliest(target, own, trees, passed, failed, start, last)
    requests = spark.createDataFrame(asked, "request long, curriculum long, target long, start int, last int")
    placed = spark.createDataFrame([(k, c, s, due) for k, own in curricula.items() for c, (s, due) in own.items()], "curriculum long, course long, slot int, due int")
    got = planning.earliest_terms(requests, _facts(spark, "request", known), placed, _nodes(spark, trees), 2).collect()
    assert {r.request: (r.state, r.slot) for r in got} == want and len(got) == 60


@pytest.mark.parametrize("seed", range(2))
def test_alternatives_mean_the_same(spark, seed):
    rng = random.Random(seed)
    trees = {o: brute.some_rule(rng, list(range(6))) for o in range(60)}
    got = {r.owner_id: [[tuple(x) for x in a] for a in r.alternatives] for r in rules.alternatives(rules.leaf_paths(_nodes(spark, trees), 2), 2).collect()}
    for o, r in trees.items():
        for _ in range(20):
            passed, enrolled = ({c for c in range(6) if rng.random() < 0.5} for _ in range(2))
            assert any(all(c in passed or (co and c in enrolled) for c, co in a) for a in got[o]) == (not brute.verdict(r, passed, set(range(6)) - passed, enrolled))


@pytest.mark.parametrize("seed,capacity", [(0, 6.0), (1, 9.0), (2, 3.0), (3, None)])
def test_recovery_drafts_equal_a_scheduler(spark, seed, capacity):
    rng = random.Random(seed)
    curricula, trees, asked, known, want = {}, {}, [], {}, {}
    for k in range(6):
        terms = sorted(rng.choice([0, 1, 3, 4, 6, 7, 9, 10, 2, 5]) for _ in range(11))
        curricula[k] = {100 * k + i: (t, rng.choice([3.0, 3.0, 4.0, 5.0, None]), i) for i, t in enumerate(terms)}
        for c, (t, _, _) in curricula[k].items():
            earlier = [r for r, x in curricula[k].items() if x[0] < t]
            same = [r for r, x in curricula[k].items() if x[0] == t and r != c]
            trees[c] = ("all_of", brute.some_rule(rng, earlier, 1), *([("co_requisite", rng.choice(same))] if same and rng.random() < 0.5 else []))
    for q in range(70):
        own = curricula[rng.randrange(6)]
        course = rng.choice([*own][:8])
        stated = rng.choice([None, None, rng.randrange(12)])
        passed = {c for c in own if rng.random() < 0.05}
        failed = {c for c in own if rng.random() < 0.05} - passed
        k = course // 100
        asked.append((q, k, course, stated, q % 2 == 0))
        known[q] = passed, failed
        want[q] = brute.drafts(course, stated, own, trees, passed, failed, passed | failed, capacity)
    requests = spark.createDataFrame(asked, "request long, curriculum long, failed_course long, stated int, fastest boolean")
    placed = spark.createDataFrame([(k, c, *x) for k, own in curricula.items() for c, x in own.items()], "curriculum long, course long, due int, units double, ord int")
    found = recovery.recovery_drafts(requests, _facts(spark, "request", known), placed, _nodes(spark, trees), 3, capacity, 20.0).collect()
    assert len(found) == 4 * len(want)
    states = set()
    for r in found:
        state, detail, shape = want[r.request][r.variant]
        states.add(state)
        assert (r.request, r.variant, r.state, r.moved) == (r.request, r.variant, state, None if shape is None else " ".join(f"{k}:{c}:{m}" for k, c, m in shape))
        if state == "draft":
            assert (r.n_requests, r.rejoin, r.same_as, r.course) == (*detail[:2], None, None)
            rank = lambda v: (want[r.request][v][1][1], want[r.request][v][1][0]) if r.request % 2 == 0 else (v != "D", want[r.request][v][1][0], want[r.request][v][1][2])
            ordered = sorted((v for v in "DABC" if want[r.request][v][0] == "draft"), key=lambda v: (rank(v), "DABC".index(v)))
            assert r.place == ordered.index(r.variant) + 1
        elif state == "same_as":
            assert r.same_as == detail and r.place is None
        else:
            assert r.course == detail
    assert {"draft", "same_as"} <= states
