"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, scanning every text once.

The automaton holds every fifth run of five words of an item. Any ten consecutive words contain such a block whole, so
each occurrence of a window starts from a block's hit, which is then extended to the longest run of words that text and
item share; all words of a run of ten or more lie in windows. That needs a tenth of the memory that all windows would.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut

WINDOW = 10
#: An automaton takes items of about so many bytes of text (some 50 bytes of memory for each); more items go into further
#: automata of that size, each scanning the texts in a pass of its own.
MAX_ITEM_BYTES = 4 << 20
#: Longer items are cut into pieces of so many words, which overlap by a window less one word.
PIECE = 20_000
#: Word characters, as a fixed value of the contract: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER = dict(zip(range(65, 91), range(97, 123), strict=True))
_TABLE = bytes(_LOWER.get(b, b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
#: Bytes of text that a task handles at once.
SLICE = 4 << 20


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased."""
    return (text or "").encode().translate(_TABLE).split()


class Blocks:
    """An automaton over the items' blocks; each block knows where it lies in which items."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW):
        self.size, self.items, places = size, [], {}
        width = max(1, size // 2)
        for item_id, text in sorted(set(items), key=repr):
            own = words(text)
            at = len(self.items)
            if own:
                self.items.append((item_id, own))
            for i in range(0, len(own) - width + 1, width) if len(own) >= size else [0][: len(own)]:
                block = own[i : i + width] if len(own) >= size else own
                places.setdefault(b" ".join(block), []).append((at, i))
        self.found = ahocorasick.Automaton() if places else None
        for block, at in places.items():
            self.found.add_word(f" {block.decode('latin-1')} ", (block.count(b" ") + 1, at))
        if places:
            self.found.make_automaton()

    def runs(self, own: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """The runs of a text's words that lie in windows, as (first, stop) without overlap, and the items found."""
        if not own or self.found is None:
            return [], []
        hits = list(self.found.iter(f" {b' '.join(own).decode('latin-1')} "))  # one byte is one character
        if not hits:
            return [], []
        last_of, end = {}, 0
        for i, w in enumerate(own):
            end += len(w) + 1
            last_of[end] = i
        runs, ids, known = [], set(), {}
        for end, (width, places) in hits:
            stop = last_of[end] + 1
            for at, i in places:
                item_id, item = self.items[at]
                shift = stop - width - i
                if known.get((at, shift), -1) >= stop:  # the run that an earlier block of this item was extended to
                    continue
                a, b = stop - width, stop
                while a > 0 and a > shift and own[a - 1] == item[a - 1 - shift]:
                    a -= 1
                while b < len(own) and b - shift < len(item) and own[b] == item[b - shift]:
                    b += 1
                known[at, shift] = b
                if b - a >= min(self.size, len(item)):
                    runs.append((a, b))
                    ids.add(item_id)
        return merged(runs), sorted(ids)


def merged(runs: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Runs (first, stop, and start and end offsets if given) joined where they overlap or meet."""
    out: list[tuple[int, ...]] = []
    for r in sorted(runs):
        if out and r[0] <= out[-1][1]:
            old = out.pop()
            r = (old[0], max(old[1], r[1]), *(() if len(r) == 2 else (old[2], max(old[3], r[3]))))
        out.append(r)
    return out


def scan(text: str | None, found: Blocks) -> tuple[int, list[tuple[int, int, int, int]], list[int]]:
    """Words, runs of hit words with their code point offsets in the original text, and items found."""
    own = words(text)
    runs, ids = found.runs(own)
    if not runs:
        return len(own), [], []
    spans = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return len(own), [(a, b, spans[a][0], spans[b - 1][1]) for a, b in runs], ids


_built: dict[str, Blocks] = {}


def _automaton(shared: Broadcast) -> Blocks:
    """A worker's automaton of a pass, built once; that of another pass makes room."""
    name, items, size = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Blocks(items, size)
    return _built[name]


def pieces(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, text): the items' words; long ones in overlapping pieces, so that each window lies in one of them."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)), F.lit(PIECE))
    each = own.select("item_id", "w", F.explode(starts).alias("at"))
    return each.select("item_id", F.array_join(F.slice("w", F.col("at"), F.lit(PIECE + size - 1)), " ").alias("text")).distinct()


def passes(items: DataFrame, size: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> list[Broadcast]:
    """The items of each pass over the texts, broadcast; without items one pass that finds nothing."""
    parts = cut(pieces(items, size))
    total = parts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // max_item_bytes) or 1
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    share = parts.sparkSession.sparkContext.broadcast
    return [share((uuid.uuid4().hex, [tuple(r) for r in (parts if n == 1 else parts.where(shard == i)).collect()], size)) for i in range(n)]


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs.

    Each row is judged by its own text, whatever its id. A task filters its own rows, in as many passes as the items
    take, so texts aren't shuffled. Null and empty texts stay; without items all rows stay.
    """
    at_text = docs.columns.index("text")

    def filtered(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(shared)
            for batch in batches:
                for part in byte_slices(batch, at_text, SLICE):
                    yield part.filter(pa.array([not found.runs(words(t))[0] for t in part.column(at_text).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    every = passes(items, size, max_item_bytes)
    for shared in every:
        docs = filtered(docs, shared)
        if len(every) > 1:  # else all passes' automata would be in memory at once
            docs = cut(docs)
    return docs


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Which words of each document lie inside test items.

    Takes doc_id and text, item_id and text; other columns are ignored. Returns doc_id, n_words, n_hit, item_ids (those
    with an occurring window, sorted) and spans (start and end of each hit run in the original text, in code points).
    Null and empty texts have no words; items without id, text or words and an empty table of items hit nothing;
    repeated rows stay; null doc_ids stay. Items of more than ``max_item_bytes`` in all take several passes, whose hits
    are joined by two hashes of the text; the rows are the same.
    """
    docs, every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), passes(items, size, max_item_bytes)
    if len(every) == 1:
        return _one_pass(docs, every[0])
    copy = [F.xxhash64(F.lit(i), F.coalesce("text", F.lit(""))).alias(f"copy{i}") for i in (1, 2)]
    keyed = docs.select("doc_id", "text", *copy)
    hits = [_hits(keyed.select("text", "copy1", "copy2"), shared) for shared in every]
    union = hits[0]
    for h in hits[1:]:
        union = union.union(h)
    # runs and ids of equal texts are equal, so a set of each pass's is enough
    found = union.groupBy("copy1", "copy2").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids")).mapInArrow(_joined, f"copy1 long, copy2 long, {SCHEMA.removeprefix('doc_id long, n_words long, ')}")
    own = keyed.select("doc_id", F.size(column_words(F.col("text"))).cast("long").alias("n_words"), "copy1", "copy2")
    return own.join(found, ["copy1", "copy2"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("item_ids", "array<long>"), ("spans", "array<struct<start:int,end:int>>"))))


def column_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _one_pass(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(shared)
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                rows = [scan(t, found) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([sum(b - a for a, b, _, _ in runs) for _, runs, _ in rows], pa.int64()),
                        pa.array([ids for _, _, ids in rows], pa.list_(pa.int64())),
                        pa.array([[{"start": s, "end": e} for _, _, s, e in runs] for _, runs, _ in rows], _SPANS),
                    ],
                    names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
                )

    return docs.mapInArrow(run, SCHEMA)


def _hits(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """(copy1, copy2, runs, ids) of the texts that a pass hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(shared)
        for batch in batches:
            for part in byte_slices(batch, 0, SLICE):
                rows = [(i, *scan(t, found)) for i, t in enumerate(part.column(0).to_pylist())]
                rows = [(i, runs, ids) for i, _, runs, ids in rows if runs]
                at = part.take(pa.array([r[0] for r in rows], pa.int64()))
                runs = [[dict(zip(("first", "stop", "start", "end"), r, strict=True)) for r in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays([at.column(1), at.column(2), pa.array(runs, _RUNS), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["copy1", "copy2", "runs", "ids"])

    return texts.mapInArrow(run, "copy1 long, copy2 long, runs array<struct<first:long,stop:long,start:int,end:int>>, ids array<long>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of all passes joined."""
    for batch in batches:
        runs = [merged([tuple(r.values()) for r in rows]) for rows in batch.column(2).to_pylist()]
        n_hit = pa.array([sum(r[1] - r[0] for r in rows) for rows in runs], pa.int64())
        spans = pa.array([[{"start": r[2], "end": r[3]} for r in rows] for rows in runs], _SPANS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_hit, batch.column(3), spans], names=["copy1", "copy2", "n_hit", "item_ids", "spans"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[int, str | None]], size: int = WINDOW) -> tuple[int, int, int, str]:
    """The contract for one text by comparing every window with every position; for tests."""
    own, hit, found = [w.lower() for w in _WORD.findall((text or "").translate(_LOWER))], set(), set()
    for item_id, item in items:
        its = _WORD.findall((item or "").translate(_LOWER))
        n = min(size, len(its))
        for i in range(len(its) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == its[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item_id)
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
