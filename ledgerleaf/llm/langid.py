"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices

#: The classifier is fit on at most so many labelled rows of each language, and so many bytes of their whole texts (but
#: for one row, if that is longer), chosen by hash order of doc_id.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 1000, 16 << 20
#: It learns the languages of the most labelled rows, up to so many, and from fewer rows of each where all would be more.
MAX_LANGUAGES, MAX_ROWS = 1000, 250_000
#: A word is known if the fitting rows of one language have it at least so often.
LEAST_COUNT = 2
LONGEST = 4
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of text handled at once, and of the memory of unseen words, before it starts anew.
SLICE, MEMORY = 1 << 20, 16 << 20


@dataclass
class Logs:
    """Log frequencies of keys by language: ``base`` for a key that a language lacks, and what those that have it add."""

    rows: dict[str, int]
    starts: np.ndarray
    langs: np.ndarray
    more: np.ndarray
    base: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[int, str, int]], n_langs: int) -> Logs:
        """From (language, key, count), with half a count added to each."""
        counts = sorted(counts, key=lambda c: (c[1], c[0]))
        rows: dict[str, int] = {}
        at = np.fromiter((rows.setdefault(k, len(rows)) for _, k, _ in counts), np.int64, len(counts))
        langs = np.fromiter((c[0] for c in counts), np.int64, len(counts))
        n = np.fromiter((c[2] for c in counts), float, len(counts))
        total = np.bincount(langs, n, n_langs) + 0.5 * len(rows) + 1
        starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(rows)))))
        return cls(rows, starts.astype(np.int64), langs.astype(np.int32), np.log((n + 0.5) / 0.5).astype(np.float32), np.log(0.5 / total))

    def sums(self, group: np.ndarray, row: np.ndarray, weight: np.ndarray, n_groups: int) -> np.ndarray:
        """Weighted sums of rows' logs for each group and language."""
        n_langs, sizes = len(self.base), self.starts[row + 1] - self.starts[row]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[row] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        cell = np.repeat(group, sizes) * n_langs + self.langs[at]
        found = np.bincount(cell, self.more[at] * np.repeat(weight, sizes), n_groups * n_langs).reshape(n_groups, n_langs)
        return found + np.bincount(group, weight, n_groups)[:, None] * self.base


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    words: Logs
    parts: Logs
    memory: dict[str, np.ndarray] = field(default_factory=dict)
    room: int = MEMORY

    def _backed_off(self, words: list[str]) -> None:
        """Puts into memory each word's mean log frequency of its longest n-grams that are known at all; zeros if none is."""
        group, row, weight = [], [], []
        known = self.parts.rows
        for i, word in enumerate(words):
            for n in range(LONGEST, 0, -1):
                found = [r for g in grams(word, n) if (r := known.get(g)) is not None]
                if found:
                    group += [i] * len(found)
                    row += found
                    weight += [1 / len(found)] * len(found)
                    break
        logs = self.parts.sums(np.array(group, np.int64), np.array(row, np.int64), np.array(weight, float), len(words))
        self.memory.update(zip(words, logs, strict=True))
        self.room -= sum(len(w) * 4 + 200 + 8 * len(self.langs) for w in words)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's likeliest language and its share among all; ``und`` without a letter or without any language."""
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if not self.langs or not any(found):
            return [("und", 0.0)] * len(texts)
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        coded = pa.array([w for f in found for w in f], pa.large_string()).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        del coded
        row = np.fromiter((self.words.rows.get(w, -1) for w in distinct), np.int64, len(distinct))
        if self.room < 0:
            self.memory.clear()
            self.room = MEMORY
        new = [w for w, r in zip(distinct, row, strict=True) if r < 0 and w not in self.memory]
        if new:
            self._backed_off(new)
        known = row[which] >= 0
        total = self.words.sums(doc[known], row[which[known]], np.ones(int(known.sum())), len(texts))
        rest = np.flatnonzero(row < 0)
        if len(rest):
            logs, place = np.stack([self.memory[distinct[i]] for i in rest]), np.full(len(distinct), -1)
            place[rest] = np.arange(len(rest))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc[~known], logs[place[which[~known]], k], len(texts))
        best = total.argmax(axis=1)  # ties: the first in the order of names
        share = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [(self.langs[b], float(s)) if f else ("und", 0.0) for b, s, f in zip(best, share, found, strict=True)]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows never learnt from: crc32 of the id's text leaves no remainder by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, size, n): a task's words, with size 0, and n-grams of each size."""
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[lang].update(_WORD.findall(text.lower()))
    for lang, own in words.items():
        for size in range(LONGEST + 1):
            found: Counter = own if not size else Counter()
            if size:
                for w, n in own.items():
                    for g in grams(w, size):
                        found[g] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([size] * len(keys), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["lang", "key", "size", "n"])


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on rows that aren't held out and have both text and lang (columns doc_id, text, lang).

    Of more than ``max_languages`` languages those with the fewest labelled rows (or the last by name) aren't learnt,
    and are never predicted. Rows of the same id, language and text are one.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], Logs.fit([], 0), Logs.fit([], 0))
    most = max(1, min(rows_per_language, MAX_ROWS // len(langs)))
    spark = docs.sparkSession
    # of a large language only about twice the rows wanted, by the same hash, reach the ranking
    shares = [(r["lang"], (2 * most + 500) / r["count"] if r["count"] > 4 * most + 1000 else 1.0) for r in sizes]
    learnt = F.broadcast(spark.createDataFrame(shares, "lang string, share double"))  # max_languages rows
    order = F.xxhash64(F.lit("fit"), "doc_id")
    low = order.cast("double") <= (F.col("share") - 0.5) * 2.0**64
    narrow = labelled.join(learnt, "lang").where(low).select("lang", "doc_id", "copy", F.octet_length("text").alias("bytes")).distinct()
    ranked = Window.partitionBy("lang").orderBy(order, "doc_id", "copy")
    before = F.sum("bytes").over(ranked.rowsBetween(Window.unboundedPreceding, -1))
    chosen = narrow.select("lang", "doc_id", "copy", F.row_number().over(ranked).alias("rank"), F.coalesce(before, F.lit(0)).alias("before")).where((F.col("rank") <= most) & (F.col("before") < bytes_per_language))
    keys = F.broadcast(chosen.select("lang", "doc_id", "copy"))  # MAX_ROWS rows
    texts = labelled.join(keys, ["lang", "doc_id", "copy"], "left_semi").dropDuplicates(["lang", "doc_id", "copy"]).select("lang", "text")
    counts = texts.mapInArrow(_counts, "lang string, key string, size int, n long").groupBy("lang", "key", "size").agg(F.sum("n").alias("n"))
    found = counts.where((F.col("size") > 0) | (F.col("n") >= LEAST_COUNT)).toArrow()  # bounded by the fitting rows
    at = {x: i for i, x in enumerate(langs)}
    rows = list(zip(map(at.__getitem__, found["lang"].to_pylist()), found["key"].to_pylist(), found["n"].to_pylist(), found["size"].to_pylist(), strict=True))
    # n-grams of all sizes are one table: a key's length is its size
    return Model(langs, Logs.fit([r[:3] for r in rows if not r[3]], len(langs)), Logs.fit([r[:3] for r in rows if r[3]], len(langs)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, from its whole text alone.

    Takes doc_id and text; other columns are ignored. Null texts and texts without a letter get ``und`` and score 0;
    equal scores go to the first language by name; repeated rows stay; an untrained model answers ``und``. Words of any
    length count with all their n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in byte_slices(batch, 2, SLICE):
                langs, scores = zip(*own.predict(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language of at least that score.

    Each task filters its own rows, so texts aren't shuffled to join the predictions.
    """
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in byte_slices(batch, at_text, SLICE):
                found = own.predict(part.column(at_text).to_pylist())
                yield part.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def brute_force(labelled: list[tuple[str, str]], text: str | None) -> tuple[str, float]:
    """The prediction for one text from (lang, text) rows to learn, straight from the definition; for tests."""
    found, langs = _WORD.findall((text or "").lower()), sorted({lang for lang, _ in labelled})
    if not found or not langs:
        return "und", 0.0
    words = {lang: Counter(w for of, t in labelled if of == lang for w in _WORD.findall(t.lower())) for lang in langs}
    parts = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in words[lang].items():
            for size in range(1, LONGEST + 1):
                for i in range(len(w) + 3 - size):
                    parts[lang][f"_{w}_"[i : i + size]] += n
        words[lang] = Counter({w: n for w, n in words[lang].items() if n >= LEAST_COUNT})

    def logs(counts: dict[str, Counter], key: str) -> list[float]:
        keys = len({k for c in counts.values() for k in c})
        return [log((counts[x][key] + 0.5) / (sum(counts[x].values()) + 0.5 * keys + 1)) for x in langs]

    total = [0.0] * len(langs)
    for word in found:
        own = [0.0] * len(langs)
        if any(word in c for c in words.values()):
            own = logs(words, word)
        else:
            for size in range(LONGEST, 0, -1):
                known = [g for i in range(len(word) + 3 - size) if any((g := f"_{word}_"[i : i + size]) in c for c in parts.values())]
                if known:
                    own = [sum(x) / len(known) for x in zip(*(logs(parts, g) for g in known), strict=True)]
                    break
        total = [a + b for a, b in zip(total, own, strict=True)]
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(exp(t - total[best]) for t in total)
