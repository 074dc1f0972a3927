"""Phrase collocations per language: exact n-gram counts, and lockstep merges of count streams in prefix and suffix order.

A word is told by a hash of as many bits as leave the whole vocabulary without a collision, which is checked, so no table
of words is sent to the tasks. Each task sends its distinct pairs of words once, then those triples whose words and pairs
all may come often enough, as filters of a fixed size say; those that do make two streams. In prefix order a word is followed by its pairs and a pair by its triples, so that one pass hands down
the counts of left parts and hands up the largest extension; in suffix order the same pass does so for right parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

#: Words whose n-grams a task holds at once, and bytes of text split at once.
BUNDLE, CHUNK = 1_500_000, 1 << 20
#: Rows of n-grams in a shuffle partition, about.
PART_ROWS = 2_000_000
#: What begins (or ends) with one word is dealt to so many tasks.
SPREAD = 16
#: Buckets in which phrases are ranked before those of a language meet.
RANK_BUCKETS = 16
#: Bits of a word's hash beyond twice those of the vocabulary's size: a try has no collision in 97 of 100 cases.
SPARE_BITS, MOST_BITS = 4, 62
#: Bits of a filter for each frequent word or pair; and at most (32 MB to each task, whatever there is).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes(0xFF if b in b".,;:!?\n\v\f\r" else b for b in range(256)).lower()


class _Numbers(dict):
    """Numbers words from 1 in the order of their first use; 0 is a break."""

    def __init__(self) -> None:
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, breaks between pieces included, about CHUNK bytes at once; only a word can be longer."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            end = max(text.rfind(b" ", at, at + CHUNK), text.rfind(_BREAK, at, at + CHUNK)) + 1
            if not end:
                ends = [p for p in (text.find(b" ", at + CHUNK), text.find(_BREAK, at + CHUNK)) if p >= 0]
                end = min(ends) + 1 if ends else len(text)
        yield text[at:end].replace(_BREAK, b" \xff ").split()
        at = end


class _Bundle:
    """The words of one language in some texts."""

    def __init__(self) -> None:
        self.numbers, self.parts = _Numbers(), []

    def add(self, text: bytes) -> int:
        size = 0
        for words in _pieces(text):
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            size += len(words)
        self.parts.append(np.zeros(1, np.int32))
        return size + 1

    def row(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(2, np.int32)])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, _Bundle]]:
    """Texts (lang, text) as numbers of words, by language, about BUNDLE words at once."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            size += held.setdefault(lang, _Bundle()).add(text.as_py())
            if size >= BUNDLE:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _bundles(batches):
        for lang, own in held.items():
            words = [*own.numbers][1:]
            counts = np.bincount(own.row(), minlength=len(words) + 1)[1:]
            for a in range(0, len(words), 100_000):
                part = pa.array(words[a : a + 100_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(counts[a : a + 100_000], pa.int64())], names=["lang", "word", "f"])


def _distinct_pairs(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers, in two columns, and how often each comes."""
    pairs, counts = np.unique(a << bits | b, return_counts=True)
    return pairs >> bits, pairs & ((1 << bits) - 1), counts


def _distinct_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    mask = (1 << bits) - 1
    if 3 * bits <= 63:
        triples, counts = np.unique(a << 2 * bits | b << bits | c, return_counts=True)
        return triples >> 2 * bits, triples >> bits & mask, triples & mask, counts
    pairs = a << bits | b  # the pair's place among the pairs is shorter
    known = np.unique(pairs)
    triples, counts = np.unique(np.searchsorted(known, pairs) << bits | c, return_counts=True)
    first = known[triples >> bits]
    return first >> bits, first & mask, triples & mask, counts


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives two longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = np.full(len(a), 42, np.uint64)
    for x in (a, b):
        h = h + p5 + np.uint64(8)
        h ^= turn(x.astype(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def frequent_filter(frequent: DataFrame, key: Column) -> np.ndarray:
    """Bits, one of which is set for each frequent key. A rare one may share it, which costs rows, never a count: what holds
    a rare word or pair is rare itself. The fuller the filter, the more rare ones go on."""
    size = min(1 << max(FILTER_BITS * frequent.count(), 1 << 15).bit_length(), MOST_FILTER_BITS)
    at = key.bitwiseAND(size - 1) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((size >> 15, 1 << 12), np.uint8)  # buckets of 32,768 bits
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _grams(seed: int, width: int, words: Broadcast, pairs: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct pairs of words that pass ``words``, or, given ``pairs``, distinct triples whose pairs pass that as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _bundles(batches):
            for lang, own in held.items():
                head = f"{seed}\t{lang}\t".encode()
                ids = np.array([0, *(xxhash.xxh64_intdigest(head + w, 42) >> (64 - width) for w in [*own.numbers][1:])], np.int64)
                some = _passes(words.value, ids)
                some[0] = False
                bits = max(len(ids) - 1, 1).bit_length()
                row = np.where(some, np.arange(len(ids)), 0)[own.row()]  # a rare word is a break
                at = np.flatnonzero((row[:-2] > 0) & (row[1:-1] > 0))
                if pairs is None:
                    *columns, counts = _distinct_pairs(row[at], row[at + 1], bits)
                else:
                    at = at[_passes(pairs.value, _pair_hash(ids[row[at]], ids[row[at + 1]]))]
                    at = at[np.isin(at + 1, at, assume_unique=True)]  # the second pair as well
                    *columns, counts = _distinct_triples(row[at], row[at + 1], row[at + 2], bits)
                for x in range(0, len(counts), 65_536):
                    y = slice(x, x + 65_536)
                    yield pa.RecordBatch.from_arrays([*(pa.array(ids[c[y]]) for c in columns), pa.array(counts[y])], names=[*("w1", "w2", "w3")[: len(columns)], "f"])

    return run


def _id(seed: int, width: int) -> Column:
    """A word's hash, the same as in ``_grams``."""
    return F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{seed}\t"), "lang", F.lit("\t"), "word")), 64 - width)


def numbered(vocabulary: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The vocabulary (lang, word, f) with an ``id`` that no two entries share, and its seed, its width and all words' count."""
    size, total = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    width, seed = min(2 * max(size, 2).bit_length() + SPARE_BITS, MOST_BITS), 0
    while (out := vocabulary.withColumn("id", _id(seed, width))).select("id").distinct().count() < size:
        seed += 1
    return out, seed, width, total


def _lockstep(names: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a sorted stream of words, their pairs and their triples (three keys, and their count f): each row gets
    its word's count, a triple gets its pair's, and a pair the largest of its triples. ``names`` are those of what is added.

    Memory is that of a batch: what a row needs of those before it are two counts, and only the last pair waits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pair = most = 0
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            n, f = batch.num_rows, batch.column("f").to_numpy()
            level = 1 + np.asarray(batch.column(1).is_valid()).astype(int) + np.asarray(batch.column(2).is_valid()).astype(int)
            at = np.arange(n)
            last = [np.maximum.accumulate(np.where(level == k, at, -1)) for k in (1, 2)]
            words, pairs = (np.where(x >= 0, f[x], before) for x, before in zip(last, (word, pair), strict=True))
            first = np.flatnonzero(level == 2)
            top = np.zeros(n, np.int64)
            inner = (level == 3) & (last[1] >= 0)
            np.maximum.at(top, last[1][inner], f[inner])
            if held is not None:
                top[0] = max(top[0], most)
            word, pair = int(words[-1]), int(pairs[-1])
            keep = np.ones(n, bool)
            held = None
            if len(first) and level[first[-1] :].min() > 1:  # its triples may go on in the next batch
                keep[first[-1]] = False
                held, most = batch.slice(first[-1], 1), int(top[first[-1]])
            added = [pa.array(words), pa.array(np.where(level == 3, pairs, 0)), pa.array(np.where(level == 2, top, 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names]).filter(pa.array(keep))
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array([x], pa.int64()) for x in (word, 0, most))], names=[*held.schema.names, *names])

    return run


def _stream(rows: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    """``rows`` in the order of ``keys``, with what the lockstep pass adds. The pairs and triples of one word are dealt to
    SPREAD ranges, each of which gets the word's own row; so no word's rows must lie in one task."""
    own = F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda x: x.cast("int"))
    part = F.when(F.col(keys[1]).isNull(), own).otherwise(F.array(F.pmod(F.xxhash64(keys[1]), F.lit(SPREAD)).cast("int")))
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.select(*keys, *rest, F.explode(part).alias("part"))
    count = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = dealt.repartitionByRange(int(count), keys[0], "part").sortWithinPartitions(keys[0], "part", keys[1], keys[2])
    schema = T.StructType([*ordered.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    out = ordered.mapInArrow(_lockstep(names), schema)
    return out.where(F.col(keys[1]).isNotNull() | (F.col("part") == 0)).drop("part")


def _score(a: int, left: int, right: int) -> int:
    return 1_000_000 * a * a // (left * right)


def _scored(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs and triples with their lowest cut; those that a longer candidate stands for are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w1, w2, w3, a, left1, left2, right1, right2, longer in zip(*(batch.column(c).to_pylist() for c in ("w1", "w2", "w3", "f", "left1", "left2", "right1", "right2", "longer")), strict=True):
                if longer and 100 * longer >= percent * a:
                    continue
                cuts = [(left1, right1)] if w3 is None else [(left1, right2), (left2, right1)]
                score, _, x, y = min((_score(a, x, y), k, x, y) for k, (x, y) in enumerate(cuts))
                out.append((w1, w2, w3, a, x, y, score))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["w1", "w2", "w3", "a", "l", "r", "score"])

    return run


def frequent_grams(docs: DataFrame, vocabulary: DataFrame, seed: int, width: int, total: int, least: int) -> DataFrame:
    """(w1, w2, w3, f): words, pairs and triples that come ``least`` times or more; what a shorter one lacks is null."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_ROWS))
    frequent = vocabulary.where(F.col("f") >= least)
    words = spark.sparkContext.broadcast(frequent_filter(frequent, F.col("id")))

    def counted(grams: DataFrame) -> DataFrame:
        """Dealt by all words of an n-gram, which a task sends once, so none is hot; then sums need no further shuffle."""
        keys = grams.columns[:-1]
        return cut(grams.repartition(parts, *keys).groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") >= least))

    two = counted(docs.mapInArrow(_grams(seed, width, words), "w1 long, w2 long, f long"))
    pairs = spark.sparkContext.broadcast(frequent_filter(two, F.xxhash64("w1", "w2")))
    three = counted(docs.mapInArrow(_grams(seed, width, words, pairs), "w1 long, w2 long, w3 long, f long"))
    none = F.lit(None).cast("long")
    one = frequent.select(F.col("id").alias("w1"), none.alias("w2"), none.alias("w3"), "f")
    return one.unionByName(two.select("w1", "w2", none.alias("w3"), "f")).unionByName(three)


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    Takes text and lang; other columns are ignored. A-Z are lower-cased; words don't cross ``[.,;:!?\\n-\\r]``. A null or
    empty text has no words, a null lang is ``und``; repeated rows count each time. A phrase comes ``a`` times, ``least``
    or more; its score is a million times a / l of a / r in the cut of the lowest score, l and r being the counts of its
    two parts and n that of all words. A phrase goes if one that holds it comes ``percent`` hundredths as often or more.
    Ranks are by score, then a, then phrase; ``top`` of each language are kept. Counts are exact over all rows.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())
    counted = texts.mapInArrow(_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    vocabulary, seed, width, total = numbered(cut(counted))
    grams = frequent_grams(texts, vocabulary, seed, width, total, least)
    prefixes = cut(_stream(grams, ["w1", "w2", "w3"], ("left1", "left2", "longer_right")))
    # In suffix order the keys are the last word, the one before, and the one before that.
    size = 1 + F.col("w2").isNotNull().cast("int") + F.col("w3").isNotNull().cast("int")
    back = F.slice(F.reverse(F.array("w1", "w2", "w3")), 4 - size, size)
    turned = prefixes.select(*(F.get(back, k).alias(f"s{k + 1}") for k in range(3)), *prefixes.columns)
    merged = _stream(turned, ["s1", "s2", "s3"], ("right1", "right2", "longer_left")).where(F.col("w2").isNotNull())
    scored = merged.select("w1", "w2", "w3", "f", "left1", "left2", "right1", "right2", F.greatest("longer_right", "longer_left").alias("longer")).mapInArrow(_scored(percent), "w1 long, w2 long, w3 long, a long, l long, r long, score long")
    names = vocabulary.where(F.col("f") >= least)
    rows = scored.join(names.select(F.col("id").alias("w1"), "lang", F.col("word").alias("x1")), "w1")
    rows = rows.join(names.select(F.col("id").alias("w2"), F.col("word").alias("x2")), "w2")
    rows = rows.join(names.select(F.col("id").alias("w3"), F.col("word").alias("x3")), "w3", "left")
    rows = rows.select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    near = rows.withColumn("bucket", bucket).withColumn("near", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("near") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
