import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import reading
from ledgerleaf.sources import commits, tables


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _folder(tmp_path):
    return f"file://{tmp_path}/releases"


def test_of_two_writers_one_wins(spark, tmp_path):
    """Both read the same log and meet before they write: one gets the number, the other tries again, or is a conflict."""
    folder, meet, out = _folder(tmp_path), threading.Barrier(2), []
    commits.create_release(spark, folder, "a", {"chunks": _ids(spark, "x")}, ["chunks"])

    def write(name, based_on):
        met = []

        def make(log):
            if not met:
                met.append(log.count())
                meet.wait(60)
            return {"action": "activate", "release": "a", "actor": name}

        try:
            out.append(commits.commit(spark, folder, make, based_on))
        except commits.Conflict:
            out.append("conflict")

    for based_on, want in ((None, [1, 2]), (2, [3, "conflict"])):
        out.clear()
        threads = [threading.Thread(target=write, args=(n, based_on)) for n in ("p", "q")]
        for t in threads:
            t.start()
        for t in threads:
            t.join(120)
        assert sorted(out, key=str) == want
    log = sorted((r.version, r.actor) for r in commits.entries(spark, folder).collect())
    assert [v for v, _ in log] == [0, 1, 2, 3] and {log[1][1], log[2][1]} == {"p", "q"}


def test_many_writers_lose_nothing(spark, tmp_path):
    folder, out = _folder(tmp_path), []
    threads = [threading.Thread(target=lambda i=i: out.append(commits.commit(spark, folder, lambda log: {"action": "swap", "actor": str(i)}))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(out) == list(range(6)) and sorted(r.actor for r in commits.entries(spark, folder).collect()) == list("012345")


def test_life_of_releases(spark, tmp_path):
    folder, none, one = _folder(tmp_path), _ids(spark).where("false"), _ids(spark, "bad")
    with pytest.raises(ValueError, match="no release"):
        commits.active_part(spark, folder, "chunks")
    for faulty in ({"chunks": _ids(spark, "x", "x")}, {"chunks": none}, {"chunks": _ids(spark, None)}, {"rules": _ids(spark, "r")}):
        with pytest.raises(ValueError, match="membership"):
            commits.create_release(spark, folder, "a", faulty, ["chunks"])
    commits.create_release(spark, folder, "a", {"chunks": _ids(spark, "x", "y"), "rules": none}, ["chunks"])
    with pytest.raises(ValueError, match="exists"):
        commits.create_release(spark, folder, "a", {"chunks": _ids(spark, "z")}, ["chunks"])
    with pytest.raises(ValueError, match="doesn't exist"):
        commits.activate(spark, folder, "b", none)
    with pytest.raises(ValueError, match="not activated"):
        commits.activate(spark, folder, "a", one)
    commits.create_release(spark, folder, "b", {"chunks": _ids(spark, "z")}, ["chunks"])
    with pytest.raises(ValueError, match="never active"):
        commits.rollback(spark, folder, "b", none)
    commits.activate(spark, folder, "a", none)
    held = commits.active_part(spark, folder, "chunks")  # a reader that began before the move
    commits.activate(spark, folder, "b", none, based_on=2)
    assert [r.id for r in commits.active_part(spark, folder, "chunks").collect()] == ["z"]
    assert sorted(r.id for r in held.collect()) == ["x", "y"]
    commits.rollback(spark, folder, "a", none)
    assert [(r.action, r.active, r.superseded) for r in commits.history(spark, folder).orderBy("version").collect()] == [("draft", None, None), ("draft", None, None), ("activate", "a", None), ("activate", "b", "a"), ("rollback", "a", "b")]


def test_an_entry_that_is_not_whole_is_none(spark, tmp_path):
    folder = _folder(tmp_path)
    commits.commit(spark, folder, lambda log: {"action": "swap", "path": "p"})
    whole = json.dumps({"version": 1, "action": "swap", "path": "q"})
    (tmp_path / "releases" / "_log" / f"{1:0{commits.DIGITS}d}.json").write_text(whole[:-9])
    assert [r.path for r in commits.entries(spark, folder).collect()] == ["p"]
    assert commits.commit(spark, folder, lambda log: {"action": "swap", "path": "r"}) == 2  # its number stays taken
    assert commits.entries(spark, folder).agg(F.max_by("path", "version")).first()[0] == "r"


def test_swaps_follow_the_log(spark, tmp_path):
    folder, rows = _folder(tmp_path), _ids(spark, "x", "y")
    tables.swap_checked(folder, rows, rows.where("false"))
    with pytest.raises(ValueError):
        tables.swap_checked(folder, rows, rows)
    tables.swap_checked(folder, rows.where("id = 'x'"), rows.where("false"))
    assert [r.id for r in tables.current_version(spark, folder).collect()] == ["x"]


def test_keys_at_any_depth(spark):
    def nested(n):
        return {"Secret": 1} if not n else {"a": nested(n - 1)} if n % 2 else [1, nested(n - 1)]

    rows = spark.createDataFrame([(n, json.dumps(nested(n))) for n in range(9)], "k long, doc string")
    got = {r.k: r.path for r in reading.key_paths(rows, "k", "doc", ["secret"]).collect()}
    path = lambda n: "Secret" if not n else f"a.{path(n - 1)}" if n % 2 else f"1.{path(n - 1)}"
    assert got == {n: path(n) for n in range(9)}
