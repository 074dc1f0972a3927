import datetime
import random

from ledgerleaf.operators import folds
from ledgerleaf.streaming import state

START = datetime.datetime(2024, 1, 1)


def _requests(rng, n):
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 1, 2, 5])
        rows.append((i % 3, i, rng.choice([None, 1, 2, 3, 4, 5, 6]), START + datetime.timedelta(seconds=at), rng.randint(1, 20)))
    return rows


def _loop(rows, running, waiting):
    """A clock that ticks second by second: slots, a queue, and who is inside."""
    out = {}
    for pool in {r[0] for r in rows}:
        inside, queue, slots = [], [], []  # (request, account, takes); running: (request, account, end)
        own = sorted((int((r[3] - START).total_seconds()), r[1], r[2], r[4]) for r in rows if r[0] == pool)
        begun = {}
        for now in range(max(r[0] for r in own) + 1 + 30 * len(own)):
            for s in [s for s in slots if s[2] <= now]:
                slots.remove(s)
            while queue and len(slots) < running:
                i, a, takes = queue.pop(0)
                slots.append((i, a, now + takes))
                begun[i] = now
            for at, i, a, takes in [r for r in own if r[0] == now]:
                inside = [x[1] for x in slots] + [x[1] for x in queue]
                if a is not None and a in inside:
                    out[pool, i] = ("account_busy", None)
                elif len(inside) >= running + waiting:
                    out[pool, i] = ("answers_busy", None)
                elif len(slots) < running:
                    slots.append((i, a, now + takes))
                    out[pool, i] = ("admitted", 0)
                else:
                    queue.append((i, a, takes))
                    out[pool, i] = ("waiting", at)
        for i, at in begun.items():
            out[pool, i] = ("waiting", (at - out[pool, i][1]) * 1_000_000)
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "pool long, request long, account long, ts timestamp, takes_s int")


def test_admissions_equal_a_clock(spark):
    rows = _requests(random.Random(3), 240)
    got = {(r.pool, r.request): (r.state, r.wait_us) for r in folds.admissions(_frame(spark, rows), 2, 1).collect()}
    assert got == _loop(rows, 2, 1) and {s for s, _ in got.values()} == {"admitted", "waiting", "account_busy", "answers_busy"}
    assert folds.admissions(_frame(spark, []), 2, 1).count() == 0


def test_a_stream_in_several_batches(spark, tmp_path):
    rows = _requests(random.Random(5), 90)
    for k in range(3):
        _frame(spark, rows[30 * k : 30 * k + 30]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(_frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.pool, r.request): (r.state, r.wait_us) for r in state.run_once(state.admission_stream(read, 2, 1), f"{tmp_path}/run").collect()}
    assert got == _loop(rows, 2, 1)
