import random

from ledgerleaf.operators import recovery

from . import planning_brute as brute
from .test_planning import _facts, _nodes


def _shifted(rule, by):
    return (rule[0], rule[1] + by) if rule[0] in ("course", "co_requisite") else (rule[0], *(_shifted(r, by) for r in rule[1:]))


def test_requests_that_differ_in_names_alone_are_drafted_once(spark, monkeypatch):
    rng = random.Random(7)
    terms = sorted(rng.choice([0, 1, 3, 4, 6, 7, 9, 2, 5]) for _ in range(9))
    base = {i: (t, rng.choice([3.0, 4.0, None]), i) for i, t in enumerate(terms)}
    rules = {c: ("all_of", brute.some_rule(rng, [r for r in base if base[r][0] < t], 1)) for c, (t, _, _) in base.items()}
    curricula = {k: {100 * k + c: x for c, x in base.items()} for k in range(1, 8)}
    trees = {100 * k + c: _shifted(r, 100 * k) for k in curricula for c, r in rules.items()}
    trees[708] = ("all_of", ("course", 100))  # the last two curricula aren't closed: a rule of one names a course of the other
    curricula[7].update({100 + c: (t, u, 20 + c) for c, (t, u, _) in base.items() if c == 0})
    asked, known, want = [], {}, {}
    for q in range(56):
        k = q % 7 + 1
        own, course = curricula[k], 100 * k + q % 3
        passed = {100 * k + 5} if q % 4 == 0 else set()
        failed = {100 * k + 4} if q % 5 == 0 else set()
        asked.append((q, k, course, None, q % 2 == 0))
        known[q] = passed, failed
        want[q] = brute.drafts(course, None, own, trees, passed, failed, passed | failed, 6.0)
    drafted = []
    inner = recovery._class_drafts
    monkeypatch.setattr(recovery, "_class_drafts", lambda requests, *a: drafted.append(requests.count()) or inner(requests, *a))
    requests = spark.createDataFrame(asked, "request long, curriculum long, failed_course long, stated int, fastest boolean")
    placed = spark.createDataFrame([(k, c, *x) for k, own in curricula.items() for c, x in own.items()], "curriculum long, course long, due int, units double, ord int")
    found = recovery.recovery_drafts(requests, _facts(spark, "request", known), placed, _nodes(spark, trees), 3, 6.0, 20.0).collect()
    assert len(found) == 4 * len(asked)
    for r in found:
        state, _, shape = want[r.request][r.variant]
        assert (r.request, r.variant, r.state, r.moved) == (r.request, r.variant, state, None if shape is None else " ".join(f"{k}:{c}:{m}" for k, c, m in shape))
        assert r.course is None or r.course in curricula[r.request % 7 + 1]
    assert drafted[0] < len(asked)  # five curricula are alike


def test_shapes_tell_rules_and_openness(spark):
    trees = {1: ("verified_none",), 2: ("course", 1), 11: ("verified_none",), 12: ("course", 11), 21: ("verified_none",), 22: ("co_requisite", 21), 31: ("verified_none",), 32: ("course", 31), 99: ("course", 31)}
    placed = spark.createDataFrame([(k, 10 * k + i, i, 3.0, i) for k in range(4) for i in (1, 2)], "curriculum long, course long, due int, units double, ord int")
    got = {r.curriculum: r for r in recovery._shapes(placed, _nodes(spark, trees)).collect()}
    assert got[0].shape == got[1].shape and got[2].shape != got[0].shape
    assert got[3].shape == "own:3" and not got[3].closed and got[0].courses == [1, 2]  # 99 is in no curriculum
