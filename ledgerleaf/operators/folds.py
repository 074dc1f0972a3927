"""Folds over ordered rows whose every step depends on the last: packing, rate limits, merges, bounded buffers.

Rows of one key are read in order as a stream, so a task's memory holds one key's state and a batch of rows, never a
whole key, however many rows it has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Fold(Protocol):
    """One key's state: rows out for each row in, and at the end."""

    def step(self, row: Any) -> Iterator[tuple]: ...

    def finish(self) -> Iterator[tuple]: ...


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """Deal rows by ``keys``, sort each task's rows by keys and ``order``, and fold each key's rows in that order."""
    columns = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if fold is None or own != key:
                    if fold is not None:
                        out.extend(fold.finish())
                    key, fold = own, start(own)
                out.extend(fold.step(row))
            yield pd.DataFrame(out, columns=columns)
        if fold is not None:
            yield pd.DataFrame(list(fold.finish()), columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class _Limiter:
    def __init__(self, key: tuple, limit: int, window: int):
        self.key, self.limit, self.window, self.times = key[0], limit, window, deque()

    def step(self, row: Any) -> Iterator[tuple]:
        while self.times and self.times[0] <= row.at - self.window:
            self.times.popleft()
        admitted = len(self.times) < self.limit
        wait = 0 if admitted else max(1, -(-(self.times[0] + self.window - row.at) // 1_000_000))
        if admitted:
            self.times.append(row.at)
        yield self.key, row.event_id, admitted, wait

    def finish(self) -> Iterator[tuple]:
        return iter(())


class Pool:
    """Answers that run or wait in one pool: their release times and accounts, at most ``running + waiting`` of them."""

    def __init__(self, running: int, waiting: int, held: list[tuple[int, Any]] | None = None):
        self.running, self.waiting, self.held = running, waiting, held or []

    def offer(self, at: int, account: Any, takes: int) -> tuple[str, int | None]:
        """What becomes of a request at a time, and how long it waits for a slot; slots go in the order of admission."""
        self.held = [h for h in self.held if h[0] > at]
        if account is not None and any(a == account for _, a in self.held):
            return "account_busy", None
        if len(self.held) >= self.running + self.waiting:
            return "answers_busy", None
        ahead = len(self.held) - self.running
        start = sorted(r for r, _ in self.held)[ahead] if ahead >= 0 else at
        self.held.append((start + takes, account))
        return ("admitted" if start == at else "waiting"), start - at


class _Admission:
    def __init__(self, key: tuple, running: int, waiting: int):
        self.key, self.pool = key[0], Pool(running, waiting)

    def step(self, row: Any) -> Iterator[tuple]:
        yield self.key, row.request, *self.pool.offer(row.at, None if pd.isna(row.account) else row.account, row.takes)

    def finish(self) -> Iterator[tuple]:
        return iter(())


def admissions(requests: DataFrame, running: int, waiting: int) -> DataFrame:
    """(pool, request, state, wait_us) of requests (pool, request, account, ts, takes_s): each pool runs so many at once, so
    many more wait, and an account has one at a time; a null account is nobody's.

    States: admitted, waiting (for wait_us), account_busy and answers_busy. A request is released when it has run; one that
    ends just when another comes is gone. Equal times go by request. A pool is read in order as a stream.
    """
    rows = requests.select("pool", "request", "account", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("takes_s") * 1_000_000).cast("long").alias("takes"))
    return ordered_fold(rows, ["pool"], ["at", "request"], lambda key: _Admission(key, running, waiting), "pool long, request long, state string, wait_us long")


def rate_limit(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """(person, event_id, admitted, wait_s) of events (person, event_id, ts): at most ``limit`` admitted ones in a window.

    Refused events don't count; an event a whole window after an admitted one no longer sees it. A pause of a window or
    more forgets everything, so each person's rows are first cut there and the pieces are dealt out by themselves.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("person").orderBy("at", "event_id")
    rows = events.select("person", "event_id", at.alias("at"))
    fresh = F.coalesce(F.col("at") - F.lag("at").over(w) >= window_s * 1_000_000, F.lit(True))
    rows = rows.withColumn("piece", F.sum(fresh.cast("long")).over(w))
    return ordered_fold(rows, ["person", "piece"], ["at", "event_id"], lambda key: _Limiter(key, limit, window_s * 1_000_000), "person long, event_id long, admitted boolean, wait_s long")


class _Packer:
    def __init__(self, key: tuple, most: int):
        self.key, self.most, self.lines, self.size, self.chunk = key[0], most, [], 0, 0

    def _out(self) -> Iterator[tuple]:
        if self.lines:
            yield self.key, self.chunk, self.lines[0], self.lines[-1], len(self.lines), self.size
            self.chunk += 1
            self.lines, self.size = [], 0

    def step(self, row: Any) -> Iterator[tuple]:
        if self.size + row.n_tokens > self.most:
            yield from self._out()
        self.lines.append(row.pos)
        self.size += row.n_tokens

    def finish(self) -> Iterator[tuple]:
        return self._out()


def pack(items: DataFrame, most: int) -> DataFrame:
    """(owner, chunk, first, last, n_items, n_tokens): items (owner, pos, n_tokens) in order, packed greedily.

    A chunk never passes ``most`` tokens but for an item that does so alone.
    """
    return ordered_fold(items, ["owner"], ["pos"], lambda key: _Packer(key, most), "owner long, chunk long, first long, last long, n_items long, n_tokens long")


class _Context:
    def __init__(self, key: tuple, budget: int):
        self.key, self.budget, self.used, self.seen = key[0], budget, 0, set()

    def step(self, row: Any) -> Iterator[tuple]:
        members = {m["chunk_id"]: m["n_tokens"] for m in row.members}
        new = [c for c in members if c not in self.seen]
        if row.chunk_id in self.seen:
            outcome, new = "already_present", []
        elif any(members[c] is None or members[c] != members[c] for c in members):
            outcome, new = "missing_required_neighbor", []
        else:
            size = sum(members[c] for c in new)
            if self.used + size > self.budget:
                outcome, new = "context_budget", []
            else:
                outcome, self.used = "admitted", self.used + size
                self.seen.update(new)
        yield self.key, row.rank, row.chunk_id, outcome, len(new), self.used

    def finish(self) -> Iterator[tuple]:
        return iter(())


def assemble_context(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, rank, chunk_id, outcome, n_new, used): hits (query_id, rank, chunk_id, members) admitted by rank.

    ``members`` is the hit and all that must travel with it, as an array of (chunk_id, n_tokens); n_tokens is null for
    what can't be found. A hit enters with its whole group or not at all; members already there cost nothing, a hit that
    came along earlier is skipped, and a group over the budget leaves room for smaller later ones.
    """
    schema = "query_id long, rank long, chunk_id long, outcome string, n_new long, used long"
    return ordered_fold(hits.select("query_id", "rank", "chunk_id", "members"), ["query_id"], ["rank"], lambda key: _Context(key, budget), schema)


class _Facts:
    def __init__(self, key: tuple):
        self.key, self.kept = key, []

    def step(self, row: Any) -> Iterator[tuple]:
        known = [f for f in self.kept if f[0] != "taken_unknown"]
        if row.state == "taken_unknown" and known:
            return iter(())
        upload = any(src != "statement" and state == row.state for state, src, _ in self.kept)
        self.kept = [f for f in self.kept if f[1] != "statement"]
        if not upload:
            self.kept.append((row.state, row.source, row.seq))
        return iter(())

    def finish(self) -> Iterator[tuple]:
        for state, source, seq in self.kept:
            yield (*self.key, state, source, seq)


def merge_facts(statements: DataFrame) -> DataFrame:
    """(session, course, state, source, seq) that stand after statements (session, course, state, source, seq) in order.

    The newest own statement of a course wins; one that only says it was taken never erases a known result; an upload
    that says the same stands alone, one that says otherwise stays beside the statement.
    """
    schema = "session long, course string, state string, source string, seq long"
    return ordered_fold(statements.select("session", "course", "state", "source", "seq"), ["session", "course"], ["seq"], _Facts, schema)


class _Dialogue:
    def __init__(self, key: tuple, most: int, most_bytes: int):
        self.key, self.most, self.most_bytes, self.items, self.revision = key[0], most, most_bytes, [], 0

    def step(self, row: Any) -> Iterator[tuple]:
        self.items = [i for i in self.items if i[0] != row.message]
        self.items.append((row.message, row.size, row.pinned))
        while len(self.items) > 1 and (len(self.items) > self.most or sum(i[1] for i in self.items) > self.most_bytes):
            pinned = max((k for k, i in enumerate(self.items) if i[2]), default=None)
            drop = 1 if pinned == 0 else 0
            self.items.pop(drop)
        self.revision += 1
        return iter(())

    def finish(self) -> Iterator[tuple]:
        yield self.key, self.revision, len(self.items), sum(i[1] for i in self.items), self.items[0][0]


def bounded_dialogue(exchanges: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(session, revision, n_kept, bytes, oldest) after exchanges (session, message, seq, size, pinned) in order.

    An exchange of a known message replaces it; the oldest go first while there are too many or too large, but for the
    last pinned one, to which an open question refers.
    """
    schema = "session long, revision long, n_kept long, bytes long, oldest long"
    return ordered_fold(exchanges, ["session"], ["seq"], lambda key: _Dialogue(key, most, most_bytes), schema)


def sessions(accesses: DataFrame, idle_s: int) -> DataFrame:
    """(key, session, first_at, last_at, n): accesses (key, ts) cut where the pause is longer than ``idle_s``, natively."""
    w = Window.partitionBy("key").orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    new: Column = F.coalesce(gap > idle_s * 1_000_000, F.lit(True))
    numbered = accesses.withColumn("session", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "session").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))
