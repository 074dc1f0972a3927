"""Hard negatives by the threshold algorithm: sorted lists per dimension, read from the end that an anchor's sign favours.

Rows lie in blocks, each with one list per dimension, sorted by component. For an anchor the lists are read in step; every
row met is scored at once (random access). What no list has shown yet can't score more than the products of the
components just read, summed; once that is strictly below the k-th score of every window, its first k rows are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows and anchors of a block, about.
ROWS, ANCHORS = 4096, 4096
#: Depth of the first step down the lists; each further step is as deep as all before it.
FIRST_DEPTH = 8


class Lists:
    """A block's rows with one list per dimension; integers stay exact: floats hold them below 2**53, else Python's."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, largest: int):
        bound = 100 * rows.shape[1] * max(largest, int(np.abs(rows).max(initial=0))) ** 2
        self.kind = np.float64 if bound < 2**53 else object
        self.ids, self.labels, self.rows = ids, labels, rows.astype(self.kind)
        self.order = np.argsort(rows, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(rows, self.order.T, axis=0).T.astype(self.kind)
        self.reads = self.scored = 0

    def search(self, anchor_id: int, label: int, anchor: np.ndarray, same: bool, windows: list[tuple[int, int, int] | None], k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each window the places and scores of its first k rows, by score, then id. A window (low, high, score) takes
        rows of low * score <= 100 * own <= high * score; None takes all. ``same``: rows of the anchor's label, else others."""
        n, a = len(self.ids), anchor.astype(self.kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, done, depth = np.zeros(n, bool), np.zeros(n, bool), 0
        eligible = (self.ids != anchor_id) & ((self.labels == label) if same else (self.labels != label))
        best = [(np.zeros(0, np.int64), np.zeros(0, self.kind)) for _ in windows]
        while n:
            # A list can't be read beyond its end; an anchor of zeros has no list to read, so all rows are met.
            deep = min(max(2 * depth, FIRST_DEPTH), n) if len(up) + len(down) else n
            for lists in (self.order[up, n - deep : n - depth], self.order[down, depth:deep]):
                seen[lists] = True
                self.reads += lists.size
            if deep == n:
                seen[:] = True
            depth = deep
            new = np.flatnonzero(seen & ~done & eligible)
            done |= seen
            self.scored += len(new)
            scores = self.rows[new] @ a
            for w, window in enumerate(windows):
                fits = slice(None) if window is None else (window[0] * window[2] <= 100 * scores) & (100 * scores <= window[1] * window[2])
                at, own = (np.concatenate(x) for x in zip(best[w], (new[fits], scores[fits]), strict=True))
                first = np.lexsort((self.ids[at], -own))[:k] if self.kind is np.float64 else sorted(range(len(at)), key=lambda i: (-own[i], self.ids[at[i]]))[:k]
                best[w] = at[first], own[first]
            if done.all():
                break
            threshold = (a[up] * self.sorted[up, n - depth]).sum() + (a[down] * self.sorted[down, depth - 1]).sum()
            if all((len(s) >= k and threshold < s[-1]) or (w is not None and 100 * threshold < w[0] * w[2]) for w, (_, s) in zip(windows, best, strict=True)):
                break
        return [(at, [int(s) for s in own]) for at, own in best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _first_rows(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, same: bool, low: int, high: int, k: int) -> DataFrame:
    """Each block's first k rows for every anchor and window. ``anchors`` have a list ``positives`` of (positive_id, score)
    that gives their windows; ``same``: one window of all rows of the anchor's label."""
    row_blocks, anchor_blocks = -(-n_rows // ROWS) or 1, -(-n_anchors // ANCHORS) or 1

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("anchor_id", "anchor_key", "at", "found_id", "score")}
        if left.num_rows and right.num_rows:
            queries = _matrix(right["own_vec"])
            lists = Lists(left["vec_id"].to_numpy(), left["label"].to_numpy(), _matrix(left["vec"]), int(np.abs(queries).max(initial=0)))
            for anchor_id, key, label, positives, query in zip(*(right[c].to_pylist() for c in ("own_id", "own_key", "own_label", "positives")), queries, strict=True):
                windows = [None] if same else [(low, high, p) for p in positives]
                for w, (at, scores) in enumerate(lists.search(anchor_id, label, query, same, windows, k)):
                    out["anchor_id"] += [anchor_id] * len(at)
                    out["anchor_key"] += [key] * len(at)
                    out["at"] += [w] * len(at)
                    out["found_id"] += lists.ids[at].tolist()
                    out["score"] += scores
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    each = F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchor_block")
    left = rows.select("vec_id", "key", "label", "vec", F.size("vec").alias("width"), F.pmod("key", F.lit(row_blocks)).alias("row_block"), each)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("row_block")
    # Other names than those of `left`, which has the same source.
    right = anchors.select(F.col("vec_id").alias("own_id"), F.col("key").alias("own_key"), F.col("label").alias("own_label"), F.col("vec").alias("own_vec"), "positives", F.size("vec").alias("width"), F.pmod("key", F.lit(anchor_blocks)).cast("int").alias("anchor_block"), each)
    by = ["width", "row_block", "anchor_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "anchor_id long, anchor_key long, at long, found_id long, score long")


def mine(table: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    Takes vec_id and embedding; ``label`` is an expression over ``table``, ``is_anchor`` a condition on vec_id; other columns
    are ignored. Components become floor(256 * x); a score is the exact integer inner product, higher first, ties to the
    smaller vec_id. An anchor's positives are its first ``n_positives`` other rows of its label; negatives of a positive are
    the first ``n_negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive. Fewer are
    returned where there are fewer; an anchor without positives, or a positive without negatives, has no rows.

    Rows without an id, label or vector, or with a null or non-finite component, take no part. Repeated rows (same id, label
    and vector) count once; other rows of one id each count, and none is a partner of an anchor of its own id. Products
    need equal lengths, so rows meet only those of their own length. Scaled components are held within 64 bits; a score beyond
    them is an error.
    """
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = usable.select("vec_id", "label", vec.alias("vec")).distinct().withColumn("key", F.xxhash64("vec_id", "label", "vec"))
    rows = cut(rows)
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    none = F.array().cast("array<long>")
    near = _first_rows(rows, anchors.withColumn("positives", none), n_rows, n_anchors, True, low, high, n_positives)
    by_score = [F.desc("score"), "found_id"]
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("anchor_id", "anchor_key").orderBy(*by_score))).where(F.col("at") <= n_positives)
    own = near.select("anchor_id", "anchor_key", (F.col("at") - 1).cast("long").alias("at"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = cut(own)
    lists = own.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("at", "positive_score"))).alias("found"))  # n_positives each
    asked = anchors.join(lists.withColumnsRenamed({"anchor_id": "vec_id", "anchor_key": "key"}), ["vec_id", "key"]).withColumn("positives", F.col("found.positive_score"))
    far = _first_rows(rows, asked, n_rows, n_anchors, False, low, high, n_negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "at").orderBy(*by_score))
    far = far.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    found = far.join(own, ["anchor_id", "anchor_key", "at"])
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def brute_force(rows: list[tuple[int, int, list[int]]], anchors: Iterator[int], n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> list[tuple]:
    """The same rows from integer vectors (vec_id, label, vec) of one length, for tests."""
    out, by_id = [], {i: (lab, v) for i, lab, v in rows}
    for a in anchors:
        label, own = by_id[a]
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=True)), i, lab) for i, lab, v in rows if i != a)
        for p, pid in [(-s, i) for s, i, lab in scored if lab == label][:n_positives]:
            fits = [(i, -s) for s, i, lab in scored if lab != label and low * p <= -100 * s <= high * p][:n_negatives]
            out += [(a, pid, r, i, p, s) for r, (i, s) in enumerate(fits, 1)]
    return out
