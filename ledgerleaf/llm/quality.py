"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams from trusted text.

A symbol is a lower-cased code point (an upper-case letter is a mark and its lower-case one, a decimal digit is 0);
there is no limit to the symbols nor to the n-grams, which are strings of ``ORDER`` symbols in tables sharded by n-gram.
Texts go into bundles, a compressed one for some megabytes of text, written once as a table bucketed by bundle. Only the
distinct n-grams of each bundle are shuffled: to the counts, to the probabilities, and back to their bundle, where the
texts still lie.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_dir

ORDER = 5
CAPITAL, START, NUL = 1, 2, 3
#: Bytes of text in a bundle, about, and symbols handled at once.
BUNDLE, SLICE = 32 << 20, 2 << 20
#: One in so many trusted rows, by crc32 of doc_id, sets the bounds; the model is that of the others.
FOLDS = 5
#: Quantiles of the held-out trusted rows' deviations, per language, and how far beyond them, in parts of their distance
#: from the middle, a row may lie.
LOW_QUANTILE, HIGH_QUANTILE, MARGIN = 0.05, 0.95, 1.5
#: The log perplexity of n symbols scatters by about sqrt(1 / n + 1 / LONG): in long texts by what differs between texts.
LONG = 5000
#: Up to so many trusted ids are broadcast (some 60 bytes each in a hash table); beyond it the texts are shuffled once to join them.
BROADCAST_IDS = 4_000_000
#: All letter cases and decimal digits of Unicode lie below it.
_CASES = 0x20000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point below ``_CASES``, and whether it is a capital."""
    points = np.arange(_CASES, dtype=np.uint32)
    low, capital = points.copy(), np.zeros(_CASES, bool)
    for c in range(_CASES):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        y = x.lower()
        if y != x and len(y) == 1:
            low[c], capital[c] = ord(y), True
        elif x.isdecimal():
            low[c] = ord("0")
    low[0] = NUL
    return low, capital


def encode(text: str) -> np.ndarray:
    """A text's symbols, as code points."""
    low, capital = _tables()
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    near = np.minimum(points, _CASES - 1)
    symbols = np.where(points < _CASES, low[near], points)
    upper = capital[near] & (points < _CASES)
    if upper.any():
        out = np.full(len(symbols) + int(upper.sum()), CAPITAL, np.uint32)
        out[np.arange(len(symbols)) + np.cumsum(upper)] = symbols
        return out
    return symbols.astype(np.uint32)


class Grams:
    """The n-grams of a bundle's texts as integers, of the same order as their symbols."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        points = np.zeros(0x110000, bool)
        for t in texts:
            if t:
                points[np.frombuffer(t.encode("utf-32-le"), "<u4")] = True
        found = np.flatnonzero(points)
        seen = np.zeros(0x110000, bool)
        seen[encode("".join(map(chr, found)))] = True
        seen[START] = True
        self.alphabet = np.flatnonzero(seen).astype(np.uint32)
        self.number = np.cumsum(seen) - 1
        self.bits = max(int(len(self.alphabet) - 1).bit_length(), 1)
        #: Symbols in the first of two integers, where one doesn't hold all.
        self.wide = self.bits * ORDER > 63

    def slices(self, which: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(texts, sizes, keys) of some texts, about SLICE symbols at once; a long text comes in one slice."""
        held, size = [], 0
        for i in which:
            symbols = encode(self.texts[i]) if self.texts[i] else np.zeros(0, np.uint32)
            held.append((i, symbols))
            size += len(symbols)
            if size >= SLICE:
                yield self._keys(held)
                held, size = [], 0
        if held:
            yield self._keys(held)

    def _keys(self, held: list[tuple[int, np.ndarray]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        start = np.full(ORDER - 1, START, np.uint32)
        row = self.number[np.concatenate([x for _, s in held for x in (start, s)])]
        sizes = np.array([len(s) for _, s in held])
        inside = np.ones(len(row), bool)
        begins = np.concatenate(([0], np.cumsum(sizes + ORDER - 1)))[:-1]
        inside[(begins[:, None] + np.arange(ORDER - 1)).ravel()] = False
        last = np.flatnonzero(inside)
        first = np.zeros(len(last), np.int64)
        for k in range(ORDER - 1, -1, -1) if not self.wide else (4, 3):
            first = first << self.bits | row[last - k]
        if not self.wide:
            return [i for i, _ in held], sizes, first
        second = np.zeros(len(last), np.int64)
        for k in (2, 1, 0):
            second = second << self.bits | row[last - k]
        return [i for i, _ in held], sizes, np.stack((first, second), axis=1)

    def distinct(self, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of some texts, and how often each comes."""
        parts = [np.unique(own, axis=0, return_counts=True) if self.wide else np.unique(own, return_counts=True) for _, _, own in self.slices(which)]
        if not parts:
            return np.zeros((0, 2) if self.wide else 0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), axis=0, return_inverse=True)
        return keys, np.bincount(at.ravel(), np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def strings(self, keys: np.ndarray) -> pa.Array:
        mask, out = (1 << self.bits) - 1, np.zeros((len(keys), ORDER), np.uint32)
        for k in range(ORDER):
            if not self.wide:
                out[:, k] = self.alphabet[keys >> self.bits * (ORDER - 1 - k) & mask]
            else:
                part, place = (keys[:, 0], 1 - k) if k < 2 else (keys[:, 1], 4 - k)
                out[:, k] = self.alphabet[part >> self.bits * place & mask]
        return pa.array(np.ascontiguousarray(out).view(f"<U{ORDER}").ravel(), pa.string())

    def keys(self, strings: pa.Array) -> np.ndarray:
        """The integers of n-grams whose symbols the bundle has."""
        points = np.frombuffer("".join(strings.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
        row = self.number[points].astype(np.int64)
        parts = [range(ORDER)] if not self.wide else [range(2), range(2, ORDER)]
        out = []
        for part in parts:
            key = np.zeros(len(row), np.int64)
            for k in part:
                key = key << self.bits | row[:, k]
            out.append(key)
        return np.stack(out, axis=1) if self.wide else out[0]


_BUNDLES = pa.schema([("bundle", pa.int64()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("none", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary()), ("grams", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _bundle(name: int, ids: list, langs: list, texts: list[str | None], counted: list[bool]) -> pa.RecordBatch:
    grams = Grams(texts)
    mine = [i for i, c in enumerate(counted) if c]
    keys, counts = grams.distinct(mine)
    rest, zero = grams.distinct([i for i, c in enumerate(counted) if not c])
    keys, at = np.unique(np.concatenate((keys, rest)), axis=0, return_inverse=True)
    counts = np.bincount(at.ravel(), np.concatenate((counts, zero * 0)), len(keys)).astype(np.int64)
    raw = [(t or "").encode() for t in texts]
    row = [name, ids, langs, [t is None for t in texts], list(map(len, raw)), zstandard.ZstdCompressor(level=3).compress(b"".join(raw))]
    own = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (grams.strings(keys), pa.array(counts))]
    return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(row, _BUNDLES.types[:-2], strict=True)), *own], schema=_BUNDLES)


def bundles(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, text, counted) in bundles: their ids, languages, compressed texts, distinct n-grams, and how
    often each n-gram comes in the rows to count. A longer text is a bundle of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], []), 0
        name = lambda: int.from_bytes(os.urandom(7))  # noqa: E731  of what is written once, and only then read
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    for h, v in zip(held, row, strict=True):
                        h.append(v)
                    size += len(row[2] or "") + 16
                    if size >= BUNDLE:
                        yield _bundle(name(), *held)
                        held, size = ([], [], [], []), 0
        if held[0]:
            yield _bundle(name(), *held)

    return docs.select("doc_id", "lang", "text", "counted").mapInArrow(run, "bundle long, ids array<long>, langs array<string>, none array<boolean>, lengths array<long>, texts binary, grams array<string>, counts array<long>")


def discounts(counts: DataFrame) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and 3 or more, by how many n-grams have each count."""
    of = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (of[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)]


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, p) for each distinct ``wanted`` gram, from (gram, c) of the trusted texts.

    Lower orders count the distinct symbols before an n-gram. From the lowest order up, a table of the wanted grams'
    endings is joined with the counts, with what their context frees for the lower order, and with the lower order.
    """
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, cut(levels[0].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("c"))))
    needs = [wanted]
    for order in range(ORDER - 1, 0, -1):
        needs.insert(0, needs[0].select(F.substring("gram", 2, order).alias("gram")).distinct())
    below: DataFrame | None = None
    base = 1 / (levels[0].count() + 1)  # of every symbol, and of one that wasn't seen
    for order, (level, need) in enumerate(zip(levels, needs, strict=True), 1):
        cuts = discounts(level)
        d = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        rows = level.select("gram", F.substring("gram", 1, order - 1).alias("context"), "c", d.alias("d"))
        found = need.select("gram", F.substring("gram", 1, order - 1).alias("context")).join(rows.select("gram", (F.col("c") - F.col("d")).alias("own")), "gram", "left")
        of = [F.count_if(F.col("c") == k) * cuts[k - 1] for k in (1, 2)] + [F.count_if(F.col("c") >= 3) * cuts[2]]
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), (of[0] + of[1] + of[2]).alias("freed"))
        found = found.join(F.broadcast(contexts) if order == 1 else contexts, "context", "left")  # the empty context: one row
        if below is None:
            found = found.withColumn("low", F.lit(base))
        else:
            found = found.withColumn("ending", F.substring("gram", 2, order - 1)).join(below.select(F.col("gram").alias("ending"), F.col("p").alias("low")), "ending")
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("freed") * F.col("low")) / F.col("total"))
        below = cut(found.select("gram", p.alias("p")))
    return below


def _scores(bundle: pa.Table, found: pa.Table) -> pa.Table:
    """(doc_id, lang, n_symbols, perplexity) of a bundle's rows, from the log probabilities of its n-grams."""
    row = {c: bundle[c].combine_chunks()[0].as_py() for c in ("ids", "langs", "none", "lengths", "texts")}
    raw, ends = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(sum(row["lengths"]), 1)), np.cumsum(row["lengths"]).tolist()
    texts = [None if none else raw[e - n : e].decode() for n, e, none in zip(row["lengths"], ends, row["none"], strict=True)]
    del raw
    grams = Grams(texts)
    known, logs = grams.keys(found["gram"].combine_chunks()), np.log(found["p"].to_numpy())
    if grams.wide:
        order = np.lexsort((known[:, 1], known[:, 0]))
    else:
        order = known.argsort()
    known, logs = known[order], logs[order]
    found_at = _places(known) if len(known) and not grams.wide else None
    n, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for which, sizes, keys in grams.slices(list(range(len(texts)))):
        if grams.wide:
            distinct, at = np.unique(keys, axis=0, return_inverse=True)
            place = np.searchsorted(_void(known), _void(distinct))
            place, keys = place[at.ravel()], distinct[at.ravel()]
        else:
            place = found_at(keys) if found_at else np.zeros(len(keys), np.int64)
        place = np.minimum(place, max(len(known) - 1, 0))
        if len(keys) and (not len(known) or not np.array_equal(known[place], keys)):
            raise RuntimeError("a bundle's n-grams have no probability")
        full = np.flatnonzero(sizes)
        n[which] = sizes
        if len(full):
            sums[np.array(which)[full]] = np.add.reduceat(logs[place], (np.cumsum(sizes) - sizes)[full])
    with np.errstate(invalid="ignore", over="ignore"):
        perplexity = np.exp(-sums / n)
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_symbols": pa.array(n), "perplexity": pa.array(perplexity, mask=n == 0)})


def _places(known: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Where integers lie among the sorted ``known``: by a table of hashes, and by search where that has another one."""
    shift = np.uint64(64 - min(len(known).bit_length() + 3, 24))
    slot = lambda keys: (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
    table = np.zeros(1 << int(64 - int(shift)), np.int32)
    table[slot(known)] = np.arange(len(known), dtype=np.int32)

    def find(keys: np.ndarray) -> np.ndarray:
        place = table[slot(keys)].astype(np.int64)
        other = np.flatnonzero(known[place] != keys)
        place[other] = np.searchsorted(known, keys[other])
        return place

    return find


def _void(keys: np.ndarray) -> np.ndarray:
    """Pairs of integers as bytes that sort like the pairs."""
    return np.ascontiguousarray(keys.astype(">u8")).view("V16").ravel()


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity) of each row of (doc_id, lang, text, counted), under the model of those
    counted; a null or empty text has no perplexity."""
    spark = docs.sparkSession
    name, width = f"bundles_{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bundles(docs).write.bucketBy(width, "bundle").option("path", new_dir(spark, "bundles")).option("compression", "zstd").saveAsTable(name)
    try:
        table = spark.read.table(name)
        each = table.select("bundle", F.explode(F.arrays_zip("grams", "counts")).alias("x")).select("bundle", F.col("x.grams").alias("gram"), F.col("x.counts").alias("c"))
        wanted = cut(each.groupBy("gram").agg(F.sum("c").alias("c")))
        found = probabilities(wanted.where("c > 0"), wanted.select("gram"))
        back = each.select(F.col("bundle").alias("home"), "gram").join(found, "gram").select("home", "gram", "p")
        texts = table.select("bundle", "ids", "langs", "none", "lengths", "texts")
        return cut(texts.groupBy("bundle").cogroup(back.groupBy("home")).applyInArrow(_scores, "doc_id long, lang string, n_symbols long, perplexity double"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, lower, upper, keep) of every row.

    Takes doc_id, text and lang, and labels with doc_id and quality; other columns are ignored. The trusted rows are
    those that any label calls quality 1 and none calls otherwise. Four in five of them, by a hash of doc_id, are the
    model's text; the others, which it hasn't seen, set the bounds (all of them do where no row is held out). A row's
    deviation is that of its log perplexity from the median of its language's held-out rows, over the scatter that its
    length explains; so short rows have wide bounds and don't widen those of long ones. A row is kept if its deviation
    lies between the quantiles of those rows, with a margin; the bounds never are narrower than the scatter itself.
    Languages (or a null one) without held-out rows take the median and quantiles of all. Rows without text aren't kept;
    without trusted rows all other rows are. Repeated rows stay.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1")
    good = cut(good.select(F.col("doc_id").cast("long").alias("good"), (~held_out(F.col("doc_id"))).alias("counted")))
    few = good.count() <= BROADCAST_IDS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    marked = own.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("good"), "left").select("doc_id", "lang", "text", F.coalesce("counted", F.lit(False)).alias("counted"))
    scored = score(marked)
    bounding = good.where("NOT counted")
    if bounding.isEmpty():
        bounding = good
    known = scored.where("perplexity IS NOT NULL").join(bounding, F.col("doc_id") == F.col("good"), "left_semi")
    scatter = F.sqrt(1 / F.greatest("n_symbols", F.lit(1)) + F.lit(1 / LONG))

    def beside(rows: DataFrame, own: DataFrame, every: DataFrame, names: list[str]) -> DataFrame:
        """Each row with its language's values, or else those of all rows."""
        own = own.select(F.col("lang").alias("of"), *(F.col(c).alias(f"own_{c}") for c in names))
        every = every.select(*(F.col(c).alias(f"all_{c}") for c in names))
        out = rows.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(every))  # one row
        return out.select(*rows.columns, *(F.coalesce(f"own_{c}", f"all_{c}").alias(c) for c in names))

    middle = F.percentile_approx("perplexity", 0.5, 10_000).alias("middle")
    known = cut(beside(known, known.groupBy("lang").agg(middle), known.agg(middle), ["middle"]).withColumn("z", F.log(F.col("perplexity") / F.col("middle")) / scatter))
    values = [F.first("middle").alias("middle"), *(F.percentile_approx("z", q, 10_000).alias(c) for c, q in (("low", LOW_QUANTILE), ("high", HIGH_QUANTILE)))]
    every = known.agg(middle, *values[1:])
    placed = beside(scored, known.groupBy("lang").agg(*values), every, ["middle", "low", "high"])
    bound = lambda z: F.col("middle") * F.exp(z * (1 + MARGIN) * scatter)
    placed = placed.withColumn("lower", bound(F.least("low", F.lit(-1.0)))).withColumn("upper", bound(F.greatest("high", F.lit(1.0))))
    without = F.col("middle").isNull()  # no trusted rows
    placed = placed.withColumns({c: F.when(~without, F.col(c)) for c in ("lower", "upper")})
    keep = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.col("perplexity").isNotNull())
    return placed.select("doc_id", "lang", "n_symbols", "perplexity", "lower", "upper", keep.alias("keep"))
