"""Approximate nearest neighbours by balanced posting lists over a navigable graph of centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Vectors wanted in a posting list, and the most lists: their centroids and graph are in every task's memory. Beyond
#: MAX_LISTS * LIST_SIZE distinct vectors lists grow longer.
LIST_SIZE, MAX_LISTS = 128, 65_536
#: The index is fit on so many distinct vectors for each list, chosen by hash order, but on at most so many components.
SAMPLE_PER_LIST, SAMPLE_VALUES = 32, 1 << 24
#: A vector also goes to lists whose centroid is at most this many times as far as its nearest, and to this many at most.
REPLICA_RATIO, MAX_REPLICAS = 1.15, 3
#: A query reads lists whose centroid is at most this many times as far as its nearest one, or as a sample vector's
#: usual distance from its own, if that is more: a vector at a list's very centre still has neighbours elsewhere.
PROBE_RATIO = 1.15
#: Neighbours of a centroid in the graph, the least width of a search's front, and what it expands at once.
DEGREE, FRONT, BEAM = 24, 96, 4
#: Posting rows, and queries, that meet in one task at once: lists are packed into groups of that size or split.
GROUP = 16_384


def _far(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means whose assignment pays a price for lists that are already long, so that lists come out near equal."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].astype(float)
    price = np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate([(_far(points[i : i + 4096], centres) + price).argmin(1) for i in range(0, len(points), 4096)])
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        price = 0.5 * price + 0.05 * (size / (len(points) / k) - 1) * _far(points[:256], centres).min(1).mean()
    return centres


def centroid_tree(points: np.ndarray, k: int) -> np.ndarray:
    """k centroids; of many, first the square root of as many, and then those of each one's points."""
    if k <= 1024:
        return balanced_centroids(points, k)
    coarse = balanced_centroids(points, isqrt(k))
    own = np.concatenate([_far(points[i : i + 4096], coarse).argmin(1) for i in range(0, len(points), 4096)])
    size = np.bincount(own, minlength=len(coarse))
    return np.concatenate([balanced_centroids(points[own == c], max(1, min(round(k * n / len(points)), n))) for c, n in enumerate(size) if n])


@dataclass
class Index:
    """Centroids, and the graph among them: near neighbours and a few long links."""

    centres: np.ndarray
    graph: np.ndarray
    largest: float
    usual: float

    @classmethod
    def fit(cls, vectors: np.ndarray, n: int, largest: float) -> Index:
        """From a sample of ``n`` distinct vectors whose norms are at most ``largest``."""
        points = cls.lift(vectors, largest)
        centres = centroid_tree(points, max(1, min(MAX_LISTS, n // LIST_SIZE, len(points))))
        k = len(centres)
        degree, near = min(DEGREE, k - 1), []
        for i in range(0, k, 1024):
            far = _far(centres[i : i + 1024], centres)
            far[np.arange(len(far)), i + np.arange(len(far))] = np.inf
            near.append(far.argpartition(degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(far), 0), int))
        rng = np.random.default_rng(11)
        links = [np.concatenate(near)]
        for _ in range(4):  # long links: rings through all centroids in random orders, so that each can be reached
            ring = rng.permutation(k)
            links.append(ring[(ring.argsort() + 1) % k][:, None])
        usual = float(np.sqrt(np.median(_far(points[:4096], centres).min(1))))
        return cls(centres, np.concatenate(links, axis=1).astype(np.int32), largest, usual)

    @staticmethod
    def lift(vectors: np.ndarray, largest: float) -> np.ndarray:
        """Unit-scale vectors with one more component that makes all norms equal: the largest product is then nearest."""
        scaled = vectors / (largest or 1)
        return np.concatenate((scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(1, keepdims=True), 0))), axis=1)

    def nearest(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The graph's best-first search for many points at once: ids and squared distances of ``width`` centroids."""
        k, n = len(self.centres), len(points)
        width = min(width, k)
        starts = np.unique(np.linspace(0, k - 1, min(k, 32)).astype(int))
        ids = np.full((n, width), -1)
        far = np.full((n, width), np.inf)
        done = np.zeros((n, width), bool)
        seen = np.zeros((n, k), bool)
        norms, own = (self.centres**2).sum(1), (points**2).sum(1)

        def merge(rows: np.ndarray, new: np.ndarray, new_far: np.ndarray) -> None:
            both, both_far = np.concatenate((ids[rows], new), 1), np.concatenate((far[rows], new_far), 1)
            flags = np.concatenate((done[rows], np.zeros(new.shape, bool)), 1)
            order = both_far.argsort(1, kind="stable")[:, :width]
            ids[rows], far[rows], done[rows] = (np.take_along_axis(x, order, 1) for x in (both, both_far, flags))

        rows = np.arange(n)
        seen[:, starts] = True
        merge(rows, np.broadcast_to(starts, (n, len(starts))), np.maximum(own[:, None] - 2 * points @ self.centres[starts].T + norms[starts], 0))
        while len(rows):
            shut = done[rows] | ~np.isfinite(far[rows])
            rows, shut = rows[~shut.all(1)], shut[~shut.all(1)]
            if not len(rows):
                break
            at = shut.argsort(1, kind="stable")[:, :BEAM]  # the nearest open ones, since fronts are sorted
            opened = ~np.take_along_axis(shut, at, 1)
            done[rows[:, None], at] |= opened
            new = np.where(opened[:, :, None], self.graph[np.maximum(ids[rows[:, None], at], 0)], starts[0]).reshape(len(rows), -1)
            fresh = ~seen[rows[:, None], new]
            order = new.argsort(1, kind="stable")
            same = np.take_along_axis(new, order, 1)
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order[:, 1:], same[:, 1:] == same[:, :-1], 1)
            seen[rows[:, None], new] = True
            i, j = np.nonzero(fresh & ~again)
            new_far = np.full(new.shape, np.inf)
            c = new[i, j]
            new_far[i, j] = np.maximum(own[rows[i]] - 2 * np.einsum("nd,nd->n", points[rows[i]], self.centres[c]) + norms[c], 0)
            merge(rows, new, new_far)
        return ids, far

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, own): the nearest list of each vector, and others about as near."""
        ids, far = self.nearest(self.lift(vectors, self.largest), 4 * MAX_REPLICAS)
        keep = np.isfinite(far) & (np.sqrt(far) <= REPLICA_RATIO * np.sqrt(far[:, :1]) + 1e-12)
        keep &= keep.cumsum(1) <= MAX_REPLICAS
        keep[:, 0] = True
        row, col = np.nonzero(keep)
        return row, ids[row, col], col == 0

    def probes(self, queries: np.ndarray, ratio: float, members: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists each query reads: pruned by the ratio of their centroid's distance to the nearest one's, but so
        many that at least ``least`` vectors, or all, have their nearest list among them; ``members`` counts those."""
        points = np.concatenate((queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))), axis=1)
        out: list[np.ndarray] = [np.zeros(0, int)] * len(points)
        rows, width, k = np.arange(len(points)), FRONT, len(self.centres)
        while len(rows):
            ids, far = self.nearest(points[rows], width)
            keep = np.sqrt(far) <= ratio * np.maximum(np.sqrt(far[:, :1]), self.usual) + 1e-12
            held = np.where(ids < 0, 0, members[ids])
            keep |= held.cumsum(1) - held < least
            keep &= ids >= 0
            wide = keep[:, -1] & (width < k)  # the front ended before the ratio did
            for r in np.flatnonzero(~wide):
                out[rows[r]] = ids[r][keep[r]]
            rows, width = rows[wide], 2 * width
        return out


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed component by component in order."""
    out = np.zeros(len(vectors))
    for i in range(vectors.shape[1]):
        out += vectors[:, i] * queries[:, i]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


_FOUND = pa.schema([("qvec", pa.int64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def meet(posting: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of a group's lists for each query that reads some of them; ties go to the smaller id."""
    if not posting.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    posting = posting.sort_by("list")
    vectors, queries, lists = _matrix(posting["vec"]), _matrix(asked["vec"]), posting["list"].to_numpy()
    reads = asked["lists"].combine_chunks()
    which = np.repeat(np.arange(len(reads)), np.diff(reads.offsets.to_numpy()))
    wanted = reads.flatten().to_numpy()
    order = wanted.argsort(kind="stable")
    which, wanted = which[order], wanted[order]
    most = k * MAX_REPLICAS  # a vector may lie in so many of the lists a query reads
    best = np.full((len(queries), most), -np.inf)

    def floor(q: np.ndarray) -> np.ndarray:
        low = best[q].min(1)
        return np.where(np.isfinite(low), low - 1e-9 * np.maximum(1, np.abs(low)), low)

    pairs = []
    for one in np.unique(lists):
        a, b = np.searchsorted(lists, [one, one + 1])
        c, d = np.searchsorted(wanted, [one, one + 1])
        for i in range(c, d, 1024):
            q = which[i : min(i + 1024, d)]
            rough = queries[q] @ vectors[a:b].T
            both = np.concatenate((best[q], rough), axis=1)
            best[q] = np.partition(both, both.shape[1] - most, axis=1)[:, -most:]
            qi, vi = np.nonzero(rough >= floor(q)[:, None])
            pairs.append((q[qi], a + vi, rough[qi, vi]))
    q, v, rough = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 3
    keep = rough >= floor(q)
    first = posting["first"].to_numpy()
    _, one = np.unique(np.stack((q[keep], first[v[keep]])), axis=1, return_index=True)
    q, v = q[keep][one], v[keep][one]
    score = np.concatenate([products(vectors[v[i : i + 65_536]], queries[q[i : i + 65_536]]) for i in range(0, len(q), 65_536)] or [np.zeros(0)])
    order = np.lexsort((first[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    found = posting.take(pa.array(v[keep]))
    return pa.Table.from_arrays([asked["qvec"].take(pa.array(q[keep])), found["first"], found["ids"], pa.array(score[keep])], schema=_FOUND)


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def search(table: DataFrame, is_query: F.Column, k: int = 20, probe_ratio: float = PROBE_RATIO, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every row that ``is_query`` picks.

    ``is_query`` is a condition on vec_id; candidates are all rows but the query's own; ties go to the smaller vec_id.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. A
    product needs equal lengths, so vectors of several lengths are as many tables. Other columns are ignored; repeated
    rows (same id and vector) are candidates once. Rows of equal vectors are one entry of the index with their k + 1
    least ids: no other of them can be among the k nearest of any query. Each query gets k rows, or all there are.
    """
    usable = cut(_usable(table, id_col, vector_col).distinct())
    lengths = sorted(r[0] for r in usable.select(F.size("vec")).distinct().collect())
    if len(lengths) == 1:
        return _search(usable, is_query, k, probe_ratio)
    none = usable.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return reduce(DataFrame.union, (_search(usable.where(F.size("vec") == n), is_query, k, probe_ratio) for n in lengths), none)


def _search(usable: DataFrame, is_query: F.Column, k: int, probe_ratio: float) -> DataFrame:
    spark = usable.sparkSession
    order = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    same = usable.withColumn("at", order).where(F.col("at") <= k + 1).groupBy("vec").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    same = cut(same)
    n, largest, width = same.agg(F.count("*"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))), F.max(F.size("vec"))).first()
    sample = min(max(SAMPLE_PER_LIST * min(n // LIST_SIZE, MAX_LISTS), 4096), max(SAMPLE_VALUES // width, 1024))
    rows = same.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow()
    index = spark.sparkContext.broadcast(Index.fit(_matrix(rows["vec"]), n, largest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, lists, own = index.value.lists_of(_matrix(part.column(2)))
                found = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(own), *found.columns], names=["list", "own", "first", "ids", "vec"])

    postings = cut(same.select("first", "ids", "vec").mapInArrow(place, "list int, own boolean, first long, ids array<long>, vec array<double>"))
    sizes = postings.groupBy("list").agg(F.count("*").alias("rows"), F.count_if("own").alias("members")).collect()  # MAX_LISTS rows
    members, begin, parts = np.zeros(len(index.value.centres), np.int64), np.zeros(len(index.value.centres), np.int32), np.ones(len(index.value.centres), np.int32)
    at, room = 0, GROUP
    for r in sorted(sizes, key=lambda r: r["list"]):  # neighbours in the tree of centroids share a group
        members[r["list"]] = r["members"]
        if r["rows"] > room and room < GROUP:
            at, room = at + 1, GROUP
        begin[r["list"]], parts[r["list"]] = at, -(-r["rows"] // GROUP)
        at, room = (at + int(parts[r["list"]]), GROUP) if r["rows"] > GROUP else (at, room - r["rows"])
    places = spark.sparkContext.broadcast((members, begin, parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, begin, parts = places.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, group, lists = [], [], []
                for i, found in enumerate(index.value.probes(_matrix(part.column(1)), probe_ratio, members, k + 1)):
                    each = np.repeat(found, parts[found])
                    own = np.repeat(begin[found], parts[found]) + np.concatenate([np.arange(p) for p in parts[found]])
                    order = own.argsort(kind="stable")
                    for g, x in zip(*_runs(own[order], each[order]), strict=True):
                        row.append(i)
                        group.append(g)
                        lists.append(x)
                found = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(lists, pa.list_(pa.int32())), *found.columns], names=["grp", "lists", "qvec", "vec"])

    asks = usable.where(is_query)
    times = asks.groupBy("vec").agg(F.count("*").alias("times"))  # one row for each query vector
    queries = cut(times.join(same.select("vec", F.col("first").alias("qvec")), "vec"))
    asks = cut(hot_join(asks, queries, "vec", "times").select(F.col("vec_id").alias("query_id"), "qvec"))
    asked = cut(queries.select("qvec", "vec").mapInArrow(probe, "grp int, lists array<int>, qvec long, vec array<double>"))
    blocks = asked.groupBy("grp").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    to_group = _group(spark, begin, parts)
    dealt = postings.join(F.broadcast(to_group), "list").withColumn("grp", F.col("begin") + F.pmod(F.xxhash64("first"), "parts").cast("int"))  # MAX_LISTS rows
    left = dealt.join(blocks, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "first", "ids", "vec")
    right = asked.join(blocks, "grp").select("grp", F.pmod(F.xxhash64("qvec"), "blocks").cast("int").alias("block"), "lists", "qvec", "vec")
    met = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(lambda p, q: meet(p, q, k + 1), "qvec long, first long, ids array<long>, score double")
    found = met.dropDuplicates(["qvec", "first"])
    top = Window.partitionBy("qvec").orderBy(F.desc("score"), "first")
    found = found.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1)  # k + 1 distinct vectors hold the k nearest rows
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("down"), i.alias("vec_id"), F.col("score").alias("score")))
    lists = found.groupBy("qvec").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("found"))
    lists = cut(lists.join(queries.select("qvec", "times"), "qvec"))
    others = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)
    ranked = hot_join(asks, lists, "qvec", "times").select("query_id", F.posexplode(others).alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score")


def _runs(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The values of each run of equal keys."""
    edges = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate(([0], edges))].tolist() if len(key) else [], np.split(value, edges) if len(key) else []


def _group(spark, begin: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(list, begin, parts): a list's first group and how many it is dealt over."""
    return spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(begin), dtype=np.int32)), "begin": pa.array(begin), "parts": pa.array(parts)}))


def brute_force(ids: np.ndarray, vectors: np.ndarray, query_id: int, k: int = 20) -> list[tuple[int, float]]:
    """The exact answer for one query; for tests and for measuring recall."""
    own = vectors[int(np.flatnonzero(ids == query_id)[0])]
    scores = products(vectors, np.broadcast_to(own, vectors.shape))
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query_id][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]
