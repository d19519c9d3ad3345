"""Nearest neighbours by inner product: a vantage-point tree for each shard of the vectors, searched by all queries at once.

With M the largest norm, x' = (x, sqrt(M² - |x|²)) and q' = (q, 0), the distance of q' and x' falls as the inner product of q and x
grows, so a metric tree answers the search.  A subtree is left out if the triangle inequality puts it beyond ``slack`` times the
distance of the worst neighbour so far: ``slack`` 1 gives exact results, a smaller one opens fewer leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one shard (bounds a task's memory) and of one leaf; queries that walk a tree together.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 16384, 256, 1024

#: Rounding of squared distances in single precision, as a share of the squared norms.
ROUNDING = 4e-6

FOUND = "query_id long, vec_id long, score double"


class Tree:
    """A vantage-point tree over the rows of ``points``: equal halves by distance, so equal points make no deep branch."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS, seed: int = 7):
        self.points = points
        self.norms = np.einsum("ij,ij->i", points, points)
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int):
        """(rows) of a leaf, or (vantage row, inner low, inner high, outer low, outer high, inner, outer)."""
        if len(rows) <= leaf:
            return (rows,)
        few = self.points[self.rng.choice(rows, min(len(rows), 64), replace=False)]
        spread = [np.std(np.linalg.norm(few - v, axis=1)) for v in few[:8]]
        vantage = few[int(np.argmax(spread))]
        d = np.linalg.norm(self.points[rows] - vantage, axis=1)
        order = np.argsort(d, kind="stable")
        rows, d, half = rows[order], d[order], len(rows) // 2
        return vantage, d[0], d[half - 1], d[half], d[-1], self._grow(rows[:half], leaf), self._grow(rows[half:], leaf)

    def search(self, queries: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and rows of the ``k`` nearest found for each query, in no order; row -1: none.

        Each query first looks into the leaf it falls into.  Then all walk the tree together, leaving out what the bound allows.
        """
        best = np.full((len(queries), k), np.inf, self.points.dtype)
        worst = np.full(len(queries), np.inf, self.points.dtype)
        rows = np.full((len(queries), k), -1)
        squares = np.einsum("ij,ij->i", queries, queries)
        seen: dict[int, np.ndarray] = {}

        def look(mine: np.ndarray, who: np.ndarray) -> None:
            d = squares[who, None] - 2 * (queries[who] @ self.points[mine].T) + self.norms[mine]
            hit = (d < worst[who, None]).any(axis=1)
            who, d = who[hit], np.concatenate([best[who[hit]], d[hit]], axis=1)
            r = np.concatenate([rows[who], np.broadcast_to(mine, (len(who), len(mine)))], axis=1)
            nearest = np.argpartition(d, k - 1, axis=1)[:, :k]
            best[who], rows[who] = np.take_along_axis(d, nearest, 1), np.take_along_axis(r, nearest, 1)
            worst[who] = best[who].max(axis=1)

        def descend(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 1:
                look(node[0], who)
                seen[id(node)] = who
                return
            vantage, _, high, low, _, inner, outer = node
            nearer = np.linalg.norm(queries[who] - vantage, axis=1) <= (high + low) / 2
            descend(inner, who[nearer])
            descend(outer, who[~nearer])

        def walk(node, who: np.ndarray) -> None:
            if len(node) == 1:
                who = np.setdiff1d(who, seen.get(id(node), ()), assume_unique=True)
                if len(who):
                    look(node[0], who)
                return
            vantage, low1, high1, low2, high2, inner, outer = node
            d = np.linalg.norm(queries[who] - vantage, axis=1)
            for low, high, child in ((low1, high1, inner), (low2, high2, outer)):
                bound = np.maximum(np.maximum(low - d, d - high), 0)
                # the margin is for rounding: points at just the worst distance are looked at
                open_ = bound <= slack * np.sqrt(np.maximum(worst[who], 0)) + 1e-4 * (1 + d)
                if open_.any():
                    walk(child, who[open_])

        if len(queries) and len(self.points):
            descend(self.root, np.arange(len(queries)))
            walk(self.root, np.arange(len(queries)))
        return best, rows


class Shard:
    """The vectors of one shard.  Equal vectors share one point of the tree, with their ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, group = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        self.ids, self.copies = ids[by_group], np.bincount(group)
        self.first = np.cumsum(self.copies) - self.copies
        self.largest = largest
        self.vectors = vectors[first].astype(np.float64)
        rest = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", self.vectors, self.vectors), 0))
        self.tree = Tree(np.c_[self.vectors, rest].astype(np.float32))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shard's ``k`` nearest of each query, without the query itself: query ids, ids, scores.

        The tree works in single precision, so some more than k + 1 come out of it.  Where the last of them is within rounding of the k-th,
        others may tie with it unseen, and these queries ask for four times as many.
        """
        queries = queries.astype(np.float64)
        asked = np.c_[queries, np.zeros(len(queries))].astype(np.float32)
        square = np.einsum("ij,ij->i", queries, queries) + self.largest**2
        parts = []
        left, most = np.arange(len(queries)), min(k + 9, len(self.vectors))
        while len(left):
            best, rows = self.tree.search(asked[left], most, slack)
            owner, ids, scores = self._expanded(rows, query_ids[left], queries[left], k)
            counts = np.bincount(owner, minlength=len(left))
            last = np.full(len(left), -np.inf)
            last[owner] = scores  # the last of each owner's is its least
            unsure = (counts < k) | (best.max(axis=1) <= square[left] - 2 * last + ROUNDING * square[left])
            unsure &= most < len(self.vectors)
            sure = ~unsure[owner]
            parts.append((left[owner[sure]], ids[sure], scores[sure]))
            left, most = left[unsure], min(4 * most, len(self.vectors))
        owner, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        return query_ids[owner], ids, scores

    def _expanded(self, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of the ``k`` best among the tree's rows, best first; scores in double precision."""
        owner, place = np.nonzero(rows >= 0)
        found = rows[owner, place]
        scores = np.einsum("ij,ij->i", self.vectors[found], queries[owner])
        copies = np.minimum(self.copies[found], k + 1)
        within = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        ids = self.ids[np.repeat(self.first[found], copies) + within]
        owner, scores = np.repeat(owner, copies), np.repeat(scores, copies)
        other = ids != query_ids[owner]
        owner, scores, ids = owner[other], scores[other], ids[other]
        order = np.lexsort((ids, -scores, owner))
        owner, scores, ids = owner[order], scores[order], ids[order]
        starts = np.searchsorted(owner, np.arange(len(queries)))
        top = np.arange(len(owner)) - starts[owner] < k
        return owner[top], ids[top], scores[top]


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = 20,
    slack: float = 0.6,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` rows of largest inner product with each row of ``is_query`` (a condition on ``vec_id``; default: all), itself left out.

    query_id, rank (from 1), vec_id, score; nearest first, equal scores by id.  Every row is indexed in one of the shards, whose number
    grows with the rows; the queries visit every shard in blocks.  Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do null ids; nor do vectors of another length than the most common one (the shortest of these).  An empty table
    or one row gives no rows.  Repeated rows of an id each count as candidates for other ids.
    """
    spark = vectors.sparkSession
    named = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<float>").alias("v"))
    usable = named.where(
        F.col("vec_id").isNotNull()
        & F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
        & F.expr("exists(v, x -> x != 0)")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shape = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(norm).alias("largest"))
    common = shape.orderBy(F.desc("rows"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, largest = common["n"], common["largest"]
    shards = -(-common["rows"] // shard_rows)
    usable = usable.where(F.size("v") == width)
    shard = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).cast("int")
    indexed = usable.select(shard.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = usable if is_query is None else usable.where(is_query)
    asking = asking.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        at, built = -1, None
        for b in batches:
            shard_no = b.column(0).to_numpy(zero_copy_only=False)
            asks = b.column(1).to_numpy(zero_copy_only=False)
            vec_id = b.column(2).to_numpy(zero_copy_only=False)
            v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cuts = np.flatnonzero((shard_no[1:] != shard_no[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(asks)], strict=True):
                if shard_no[i] != at:
                    at, built, ids, rows = shard_no[i], None, [], []
                if not asks[i]:
                    ids.append(vec_id[i:j].copy())
                    rows.append(v[i:j].copy())
                    continue
                if built is None and ids:
                    built = Shard(np.concatenate(ids), np.concatenate(rows), largest)
                    ids, rows = [], []
                for m in range(i, j if built else i, QUERY_ROWS):
                    n = min(m + QUERY_ROWS, j)
                    q, c, s = built.nearest(vec_id[m:n], v[m:n], k, slack)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = (
        indexed.unionByName(asking)
        .repartition(min(shards, 4096), "shard")
        .sortWithinPartitions("shard", "asks", "vec_id")
        .mapInArrow(run, FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
