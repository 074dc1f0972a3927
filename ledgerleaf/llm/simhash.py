"""SimHash near-duplicates: generalised pigeonhole search with unequal thresholds for groups of correlated bits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut, hot_join
from .components import connected_components

BITS = 64
#: Bytes of text that a task handles at once.
SLICE = 4 << 20
#: The driver sees at most so many fingerprints, to fit the partitions and thresholds.
SAMPLE = 2048
#: Buckets of more members are split into blocks; every pair of blocks is a task's unit of work.
BLOCK = 8192
#: Buckets of up to this size are compared row against row in one vectorised pass.
SMALL = 64
#: One row of an index costs about as much as this many comparisons of fingerprints.
ROW_COST = 400
#: No part makes more keys of one fingerprint than this.
MAX_KEYS = 4096


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Bitwise majority of the XXH64 of a text's word shingles, repeats included; 0 without words.

    Words lie between ASCII white space; A-Z are lower-cased. A text of fewer than ``width`` words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, total, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(BITS, np.int64)
    for i in range(0, total, 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *also): the fingerprint of every row's whole text, as a signed long. Null and empty texts get 0.

    ``also`` names columns of longs that are handed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                fps = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), *part.columns[2:]], names=["doc_id", "fp", *also])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


@dataclass(frozen=True)
class Part:
    """A group of bits (``mask``) and how many of them may differ in a probe."""

    mask: int
    threshold: int

    def flips(self) -> list[int]:
        bits = [1 << i for i in range(BITS) if self.mask >> i & 1]
        return [sum(c) for k in range(self.threshold + 1) for c in combinations(bits, k)]


def group_bits(sample: np.ndarray, m: int) -> list[int]:
    """m masks of near equal width over all 64 bits; bits that vary together in the sample share a mask."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, BITS))
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    alike = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-12)
    left, masks = list(range(BITS)), []
    for k in range(m, 0, -1):
        width, own = -(-len(left) // k), [min(left, key=lambda i: (spread[i], i))]
        left.remove(own[0])
        while len(own) < width:
            best = max(left, key=lambda i: (alike[i, own].sum(), -i))
            own.append(best)
            left.remove(best)
        masks.append(sum(1 << i for i in own))
    return masks


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (part unused) on that add up to ``total`` at the least summed cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        best = {
            s: min((best[s - t][0] + cost[t + 1], best[s - t][1] + [t]) for t in range(-1, len(cost) - 1) if s - t in best)
            for s in {s + t for s in best for t in range(-1, len(cost) - 1)}
        }
    return best[total]


def plan(sample: np.ndarray, n: int, tau: int) -> list[Part]:
    """The parts to search ``n`` distinct fingerprints at distance ``tau``, from a sample of them.

    Thresholds t_i with sum(t_i) = tau - m + 1 lose no pair: differing in more than t_i bits in every part would take
    tau + 1 differences. For every count of parts m, dynamic programming finds the t_i with the fewest expected
    comparisons and index rows, and the cheapest m wins.
    """
    sample = np.ascontiguousarray(sample, "<u8")
    pairs = sample[:, None] ^ sample[None, :]
    pairs = pairs[np.triu_indices(len(sample), 1)] if len(sample) > 1 else np.zeros(0, np.uint64)
    choices = []
    for m in range(1, tau + 2):
        masks, costs = group_bits(sample, m), []
        for mask in masks:
            width, near, cost = mask.bit_count(), np.bitwise_count(pairs & np.uint64(mask)), [0.0]
            for t in range(min(tau, width) + 1):
                rows = 1 + (sum(comb(width, k) for k in range(1, t + 1)) / 2)
                chance = max((near <= t).mean() if len(near) else 0.0, sum(comb(width, k) for k in range(t + 1)) / 2**width)
                cost.append(n * n / 2 * chance + ROW_COST * n * rows if rows <= MAX_KEYS else float("inf"))
            costs.append(cost)
        found = allocate(costs, tau - m + 1)
        choices.append((found[0], [Part(mask, t) for mask, t in zip(masks, found[1], strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _grow(fps: np.ndarray, index: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within one bucket, at most one for each member.

    A member that is already reached is compared only with those not reached yet, so that a bucket of near copies of one
    text takes about as many comparisons as it has members.
    """
    waiting, us, vs = np.arange(len(fps)), [], []
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(fps[waiting] ^ fps[at]) <= tau
            if not index[at]:
                near &= index[waiting]
            new = waiting[near]
            if len(new):
                us.append(np.full(len(new), fps[at]))
                vs.append(fps[new])
                front.extend(new)
                waiting = waiting[~near]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.uint64),) * 2


def _heads(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the links u-v reach."""
    head = np.arange(n)
    while True:
        low, before = np.minimum(head[u], head[v]), head.copy()
        np.minimum.at(head, u, low)
        np.minimum.at(head, v, low)
        head = head[head]
        if (head == before).all():
            return head


def _links(bucket: np.ndarray, fps: np.ndarray, index: np.ndarray, tau: int) -> pa.RecordBatch:
    """Verified links of whole buckets; rows come sorted by bucket, members with their own key (index) first."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(bucket)]))
    sizes = stops - starts
    us, vs = [], []
    for a, b in zip(starts[sizes > SMALL], stops[sizes > SMALL], strict=True):
        u, v = _grow(fps[a:b], index[a:b], tau)
        us.append(u)
        vs.append(v)
    little = np.repeat(sizes <= SMALL, sizes)
    bucket, fps, index = bucket[little], fps[little], index[little]
    ends = []
    for shift in range(1, min(SMALL, len(bucket))):
        same = (bucket[shift:] == bucket[:-shift]) & index[:-shift]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= tau]
        ends.append((at, at + shift))
    if ends:
        head = _heads(len(fps), *map(np.concatenate, zip(*ends, strict=True)))
        moved = np.flatnonzero(head != np.arange(len(fps)))
        us.append(fps[moved])
        vs.append(fps[head[moved]])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, tau: int = 4) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all pairs at ``tau`` or fewer bits.

    Within a bucket only a spanning set of the links is returned; every other pair at that distance is joined by a path.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if n < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    rows = distinct.orderBy(F.xxhash64(F.lit("sample"), "fp"), "fp").limit(SAMPLE).collect()
    parts = plan(np.array([r.fp for r in rows], np.int64).view(np.uint64), n, tau)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(signed(p.mask)).alias("mask"), F.array(*(F.lit(signed(x)) for x in p.flips())).alias("flips")) for i, p in enumerate(parts)))
    probes = (
        distinct.select("fp", F.inline(keys))
        .select("fp", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("own"), F.explode("flips").alias("flip"))
        .select("fp", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") != 0).alias("probe"), "own")
        .where("NOT probe OR key > own")  # of two values near each other, the greater one's bucket holds both
        .drop("own")
    )
    full = cut(probes.groupBy("part", "key").count().where(F.col("count") > BLOCK))
    probes = probes.withColumns({"low": F.lit(0), "high": F.lit(0)})
    if not full.isEmpty():
        blocks = F.ceil(F.col("count") * 2 / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        split = probes.drop("low", "high").join(full.select("part", "key", blocks.alias("blocks")), ["part", "key"])
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("fp", "part", "key", "probe", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"))
        probes = probes.join(full, ["part", "key"], "left_anti").select(*split.columns).union(split)
    order = ["part", "key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            changed = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                changed[1:] |= c[1:] != c[:-1]
            bucket = np.cumsum(changed)
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if last:
                yield _links(bucket[:last], columns[5][:last].view(np.uint64), ~columns[4][:last], tau)
            held = [c[last:] for c in columns]
        if held is not None and len(held[0]):
            yield _links(np.zeros(len(held[0]), int), held[5].view(np.uint64), ~held[4], tau)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return probes.select(*order, "probe", "fp").repartition(width, *order).sortWithinPartitions(*order, "probe").mapInArrow(run, "u long, v long").distinct()


def _reach(distinct: DataFrame, tau: int) -> DataFrame:
    """(fp, first, n, root): each distinct fingerprint with the one that names its component; ``n`` counts its rows."""
    distinct = cut(distinct)
    roots = connected_components(links(distinct.select("fp"), tau))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, tau: int = 4) -> DataFrame:
    """Every row's fingerprint and near-duplicate component.

    Takes doc_id and text; other columns are ignored. Returns doc_id, fp (signed long), fingerprint (16 hex digits) and
    component_id, the least doc_id that links of ``tau`` or fewer differing bits reach. Null, empty and blank texts
    have fingerprint 0 and are linked like any other. Repeated rows stay. A null doc_id gets a fingerprint, but
    can't name a component. Exact copies are one fingerprint, so a group of them takes no comparisons. Components and
    fingerprints that many rows share are joined where the rows lie.
    """
    fps = cut(fingerprints(docs, width))
    reach = cut(_reach(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), tau))
    least = cut(reach.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fingerprints")))
    member = cut(hot_join(reach.select("fp", "n", "root"), least, "root", "fingerprints").select("fp", "n", "component_id"))
    return hot_join(fps, member, "fp", "n").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, width: int = 4, tau: int = 4) -> DataFrame:
    """One row of each near-duplicate component, with all its columns.

    Takes doc_id and text. The row with the least doc_id stays; rows without one come last, and rows that share it go by
    a hash of the whole row, so any run keeps the same row. Ids needn't be known or unique: rows are told apart by two
    hashes of all their columns, and of fully equal rows one stays. Rows without text are one component.
    """
    names = ("_row_a", "_row_b")
    whole = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]  # hashes pass over nulls
    keyed = docs.withColumns({n: F.xxhash64(F.lit(i), *whole) for i, n in enumerate(names)})
    fps = cut(fingerprints(keyed, width, also=names))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *names)
    reach = _reach(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), tau)
    keep = reach.groupBy("root").agg(F.min("first").alias("first")).select("first._row_a", "first._row_b")
    return keyed.join(keep, [*names], "left_semi").dropDuplicates([*names]).select(*docs.columns)
