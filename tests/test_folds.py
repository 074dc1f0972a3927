import random
from datetime import datetime, timedelta

from ledgerleaf.operators import folds, similarity
from ledgerleaf.streaming import state

START = datetime(2024, 1, 1)


def test_rate_limit_boundaries(spark):
    seconds = [0, 1, 2, 10, 11, 11, 12, 25, 100]
    frame = spark.createDataFrame([(1, i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)], "person long, event_id long, ts timestamp")
    got = {r.event_id: (r.admitted, r.wait_s) for r in folds.rate_limit(frame, 2, 10).collect()}
    times, want = [], {}
    for i, s in enumerate(seconds):
        times = [t for t in times if t > s - 10]
        ok = len(times) < 2
        want[i] = (ok, 0 if ok else max(1, times[0] + 10 - s))
        times += [s] * ok
    assert got == want and want[2] == (False, 8) and want[3] == (True, 0)  # a whole window after the oldest is free again


def test_session_boundary(spark):
    frame = spark.createDataFrame([(1, START + timedelta(seconds=s)) for s in (0, 1800, 3601)], "key long, ts timestamp")
    assert sorted(r.n for r in folds.sessions(frame, 1800).collect()) == [1, 2]


def test_streams_agree_with_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, i, START + timedelta(seconds=rng.randint(0, 20_000))) for i, k in enumerate([1, 2, 3] * 40)]
    frame = spark.createDataFrame(rows, "person long, event_id long, ts timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = state.stream_of(spark, str(tmp_path / "in"))
    got = state.run_once(state.rate_limit_stream(stream, 3, 600), str(tmp_path / "a"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.rate_limit(frame, 3, 600).collect()))
    got = state.run_once(state.session_stream(stream.withColumnRenamed("person", "key"), 900), str(tmp_path / "b"), "complete")
    batch = folds.sessions(frame.withColumnRenamed("person", "key"), 900)
    assert sorted((r.key, r.n) for r in got.collect()) == sorted((r.key, r.n) for r in batch.collect())
    turns = state.run_once(state.distinct_turns(stream.select("person", "ts"), ["person"], "30 days"), str(tmp_path / "c"))
    assert turns.count() == 3


def test_context_groups_enter_whole(spark):
    group = lambda *m: [(c, n) for c, n in m]
    hits = [(1, 1, 10, group((10, 40), (11, 20))), (1, 2, 12, group((12, 50), (13, 10))), (1, 3, 11, group((11, 20))), (1, 4, 14, group((14, 30), (11, 20))), (1, 5, 15, group((15, 5), (99, None)))]
    frame = spark.createDataFrame(hits, "query_id long, rank long, chunk_id long, members array<struct<chunk_id:long,n_tokens:long>>")
    got = [(r.outcome, r.n_new, r.used) for r in folds.assemble_context(frame, 100).orderBy("rank").collect()]
    assert got == [("admitted", 2, 60), ("context_budget", 0, 60), ("already_present", 0, 60), ("admitted", 1, 90), ("missing_required_neighbor", 0, 90)]


def test_packing(spark):
    items = [(1, i, n) for i, n in enumerate([3, 4, 9, 1, 1, 20, 2])]
    got = [tuple(r) for r in folds.pack(spark.createDataFrame(items, "owner long, pos long, n_tokens long"), 10).orderBy("chunk").collect()]
    assert got == [(1, 0, 0, 1, 2, 7), (1, 1, 2, 3, 2, 10), (1, 2, 4, 4, 1, 1), (1, 3, 5, 5, 1, 20), (1, 4, 6, 6, 1, 2)]


def test_fact_merge(spark):
    rows = [(1, "a", "passed", "statement", 1), (1, "a", "taken_unknown", "statement", 2), (1, "b", "failed", "upload", 1), (1, "b", "failed", "statement", 2), (1, "c", "passed", "upload", 1), (1, "c", "failed", "statement", 2), (1, "c", "taken_unknown", "statement", 3)]
    frame = spark.createDataFrame(rows, "session long, course string, state string, source string, seq long")
    got = sorted((r.course, r.state, r.source) for r in folds.merge_facts(frame).collect())
    assert got == [("a", "passed", "statement"), ("b", "failed", "upload"), ("c", "failed", "statement"), ("c", "passed", "upload")]


def test_dialogue_keeps_the_pinned_exchange(spark):
    rows = [(1, m, m, 10, m == 0) for m in range(6)] + [(1, 5, 9, 30, False)]
    got = folds.bounded_dialogue(spark.createDataFrame(rows, "session long, message long, seq long, size long, pinned boolean"), 3, 45).first()
    assert tuple(got) == (1, 7, 2, 40, 0)


def test_similarity_matches_all_pairs(spark):
    rng = random.Random(6)
    sets = [[str(x) for x in rng.sample(range(14), rng.randint(0, 9))] for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    for threshold in (0.5, 0.8):
        alike = lambda a, b: bool(a and b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold  # noqa: B023, E731
        want = {i: sum(alike(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
        assert {r.id: r.n_links for r in similarity.linked_rows(frame, threshold).collect()} == want
