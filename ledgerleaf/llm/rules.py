"""Quality rules: exact statistics of whole texts, and gradient-boosted trees over them as flat arrays of nodes.

Texts are read once, in slices of bytes; hashes of words, lines and windows only pick the texts in which something may
repeat, and those are counted exactly. What trains the trees is a bounded sample of labelled rows' statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut

#: Bytes of text handled at once, and of a text's words hashed at once.
SLICE, CHUNK = 1 << 20, 1 << 20
#: Words of a window in which a repetition is looked for.
WINDOW = 8
#: Labelled rows of each class that the trees are fit on: all up to this number, else those of the least hashes.
MAX_ROWS = 20_000
#: Number and depth of the trees, bins of a feature, step, penalty of leaf values, and the least weight of a leaf.
TREES, DEPTH, BINS, RATE, PENALTY, LEAST = 60, 4, 64, 0.2, 1.0, 5.0
#: A row stays at this probability of being good, or more: doubt keeps a text, since a good one lost costs more than a poor
#: one kept. Of held-out rows of sf0.1 no poor one scored above 0.03, and one good one of 1,621 below 0.7 (at 0.49).
KEEP = 0.25
#: Base rules: fewer words, or more words in repeated windows in a hundred, fail.
LEAST_WORDS, MOST_REPEATED = 20, 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and their constraints: -1 where a larger value must never raise the probability of a good text.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "digit_share": 0, "mark_share": 0, "shout_share": -1, "words_per_line": 0, "longest_word": -1,
}

_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL, _UPPER, _DIGIT, _MARK, _SHOUT = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:", b"!?"))
_POINT = (np.arange(256) & 0xC0) != 0x80  # a code point's first byte
with np.errstate(over="ignore"):
    _FACTORS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> np.ndarray:
    return _FACTORS[:n] if n <= len(_FACTORS) else np.cumprod(np.full(n, _FACTORS[0], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word in some bytes, which end with a blank."""
    out, at = [], 0
    while at < len(b):
        end = min(at + CHUNK, len(b))
        blank = np.flatnonzero(_BLANK[b[at:end]])
        while not len(blank):  # a word longer than that
            end = min(2 * end - at, len(b))
            blank = np.flatnonzero(_BLANK[b[at:end]])
        part = b[at : at + blank[-1] + 1]
        edges = np.diff(np.concatenate(([0], (~_BLANK[part]).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if len(starts):
            reach = np.diff(np.concatenate(([0], starts, [len(part)])))
            place = np.arange(len(part)) - np.repeat(np.concatenate(([0], starts)), reach)
            value = np.where(_BLANK[part], 0, part.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
            out.append((starts + at, ends - starts, _mixed(np.add.reduceat(value, starts))))
        at += len(part)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _doubled(key: np.ndarray) -> np.ndarray:
    """Where a key stands that comes more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def repeated_words(text: bytes) -> int:
    """Words that lie in windows of WINDOW words which come twice or more in the text."""
    numbers: dict[bytes, int] = {}
    row = np.array([numbers.setdefault(w, len(numbers)) for w in text.split()], np.int64)
    if len(row) <= WINDOW:
        return 0
    rank, width = row, 1
    while width < WINDOW:  # the number of each run of `width` words, then of twice as many
        rank = np.unique(rank[:-width] * (len(row) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    edges = np.zeros(len(row) + 1, np.int64)
    found = np.flatnonzero(np.bincount(rank)[rank] > 1)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The exact counts of each text, and the features of the trees."""
    n = len(texts)
    b = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # each text ends with a line's end
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    per = lambda table: np.add.reduceat(table[b], begins[:-1], dtype=np.int64)
    starts, sizes, hashes = _words(b)
    of = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(of, minlength=n)
    counts = {"n_words": words, "word_chars": per(_POINT & ~_BLANK), "n_symbols": per(_SYMBOL), "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    salt = _mixed(of.astype(np.uint64) + np.uint64(1))
    lines = np.zeros(n, np.int64)
    if len(starts):
        line = np.searchsorted(np.flatnonzero(b == 10), starts)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.concatenate((first, [len(line)]))))
        lines = np.bincount(of[first], minlength=n)
        keys = _mixed(np.add.reduceat(hashes * _powers(int(place.max()) + 1)[place], first)) ^ salt[first]
        for i in np.unique(of[first[_doubled(keys)]]):
            counts["n_dup_lines"][i] = duplicate_lines(texts[i])
    if len(starts) > WINDOW:
        m = len(starts) - WINDOW + 1
        keys = sum(hashes[k : m + k] * _FACTORS[k] for k in range(WINDOW)) ^ salt[:m]
        inside = np.flatnonzero(of[:m] == of[WINDOW - 1 :])
        for i in np.unique(of[inside[_doubled(keys[inside])]]):
            counts["n_repeat_words"][i] = repeated_words(texts[i])
    distinct = np.bincount(of[np.unique(hashes ^ salt, return_index=True)[1]], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of, sizes)
    some, chars = np.maximum(words, 1), np.maximum(counts["word_chars"], 1)
    features = {
        "log_words": np.log1p(words), "mean_word": counts["word_chars"] / some, "symbols_per_word": counts["n_symbols"] / some,
        "dup_line_share": counts["n_dup_lines"] / np.maximum(lines, 1), "repeat_share": counts["n_repeat_words"] / some, "distinct_share": distinct / some,
        "upper_share": per(_UPPER) / chars, "digit_share": per(_DIGIT) / chars, "mark_share": per(_MARK) / some, "shout_share": per(_SHOUT) / some,
        "words_per_line": words / np.maximum(lines, 1), "longest_word": longest,
    }
    return counts | {k: np.asarray(v, float) for k, v in features.items()}


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, features): the statistics of each row's whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                found = statistics(pc.fill_null(part.column(1), b"").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c]) for c in (*COUNTS, *FEATURES))], names=["doc_id", *COUNTS, *FEATURES])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in arrays: a row goes left where its feature is at most the threshold; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of a good text."""
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


class _Grower:
    """Grows trees on binned features. A split on a constrained feature bounds what lies on its two sides by their middle."""

    def __init__(self, x: np.ndarray, signs: list[int], bins: int, penalty: float, least: float):
        self.signs, self.penalty, self.least = signs, penalty, least
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        self.binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        self.bins = max(map(len, self.edges)) + 1

    def _value(self, g, h, low: float, high: float):
        return np.clip(-g / (h + self.penalty), low, high)

    def _gain(self, g, h, value):
        """What a leaf of this value takes off the loss."""
        return -(g * value + 0.5 * (h + self.penalty) * value * value)

    def split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple | None:
        best = None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        whole = self._gain(total_g, total_h, self._value(total_g, total_h, low, high))
        for f, edges in enumerate(self.edges):
            own = self.binned[rows, f]
            left_g, left_h = (np.cumsum(np.bincount(own, v[rows], self.bins))[: len(edges)] for v in (g, h))
            right_g, right_h = total_g - left_g, total_h - left_h
            left, right = self._value(left_g, left_h, low, high), self._value(right_g, right_h, low, high)
            fits = (left_h >= self.least) & (right_h >= self.least) & (self.signs[f] * (right - left) >= 0)
            gain = np.where(fits, self._gain(left_g, left_h, left) + self._gain(right_g, right_h, right) - whole, -np.inf)
            if len(gain) and gain.max() > (best[0] if best else 1e-9):
                k = int(gain.argmax())
                best = float(gain[k]), f, k, (float(left[k]) + float(right[k])) / 2
        return best

    def tree(self, g: np.ndarray, h: np.ndarray, depth: int, rate: float, nodes: list[tuple], out: np.ndarray) -> int:
        """Adds a tree's nodes, and to ``out`` what it gives each row; returns the root."""

        def grow(rows: np.ndarray, left: int, low: float, high: float) -> int:
            at = len(nodes)
            nodes.append(())
            found = self.split(rows, g, h, low, high) if left else None
            if found is None:
                value = float(self._value(g[rows].sum(), h[rows].sum(), low, high)) * rate
                out[rows] += value
                nodes[at] = (0, 0.0, at, at, value)
                return at
            _, f, k, middle = found
            goes, sign = self.binned[rows, f] <= k, self.signs[f]
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[sign]
            a, b = grow(rows[goes], left - 1, *bounds[0]), grow(rows[~goes], left - 1, *bounds[1])
            nodes[at] = (f, float(self.edges[f][k]), a, b, 0.0)
            return at

        return grow(np.arange(len(g)), depth, -np.inf, np.inf)


def fit(x: np.ndarray, good: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, penalty: float = PENALTY, least: float = LEAST) -> Forest:
    """Boosted trees of logistic loss, both classes of equal weight; with one class or none there is a base value only."""
    n, k = len(good), int(good.sum())
    base = 0.0 if 0 < k < n else 10.0 if k == n else -10.0
    nodes, roots, margin = [], [], np.full(n, base)
    if 0 < k < n:
        weight = np.where(good, n / (2 * k), n / (2 * (n - k)))
        grower = _Grower(x, signs, bins, penalty, least)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grower.tree(weight * (p - good), weight * np.maximum(p * (1 - p), 1e-6), depth, rate, nodes, margin))
    columns = [np.array(c) for c in zip(*nodes, strict=True)] or [np.zeros(0, int)] * 5
    return Forest(*columns, np.array(roots, int), depth, base)


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """Trees fit on the statistics of labelled rows: up to ``max_rows`` of each class, by a hash of doc_id.

    An id is good if none of its labels is 0; ids without a label, and rows without an id, aren't used. Of several rows of
    one id one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(label_col) > 0).alias("good"))
    totals = {r[0]: r[1] for r in known.groupBy("good").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("good"), max_rows / max(totals.get(True, 0), 1)).otherwise(max_rows / max(totals.get(False, 0), 1))
    taken = known.where(place < share)  # about max_rows of each class, cut to that below
    rows = stats.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min(F.struct("good", *FEATURES)).alias("s")).select("doc_id", "s.*")
    found = rows.withColumn("place", F.xxhash64("doc_id")).toPandas().sort_values(["place", "doc_id"])
    found = found.groupby("good").head(max_rows)
    return fit(found[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), found["good"].to_numpy(bool), list(FEATURES.values()))


def judge(stats: DataFrame, forest: Forest, keep: float = KEEP) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of rows with statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(replace(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = np.stack([part.column(c).to_numpy() for c in FEATURES], axis=1)
                words, repeated = part.column("n_words").to_numpy(), part.column("n_repeat_words").to_numpy()
                failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
                score = shared.value.scores(x)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *COUNTS)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return stats.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, score double, kept boolean"]))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row.

    Takes doc_id and text of ``docs``, doc_id and quality of ``labels``; other columns are ignored. Words are runs of
    anything but space and ``\\t`` to ``\\r``. A null or empty text has no words and fails the base rules (fewer than 20
    words, or over 30 in 100 of them in windows of 8 that come twice or more); repeated rows stay. ``score`` is the trees'
    probability of a good text; ``kept`` needs it at KEEP or above, and the base rules. The score never rises with more
    symbols, capitals, exclamation marks, repeated lines or windows, or a longer longest word. Without labels of both
    classes the base rules alone decide, but if all labels are poor nothing stays.
    """
    stats = cut(describe(docs))
    return judge(stats, train(stats, labels))
