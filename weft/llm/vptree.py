"""Nearest neighbours by vantage-point trees, one per shard, with relaxed triangle-inequality pruning.

The nearness is the inner product. Vectors are lifted by one component, sqrt(M^2 - |x|^2) with M the
largest norm, and queries by zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, the nearest in Euclidean
distance, a metric, has the largest inner product, and triangle inequalities hold. A tree halves its
points by their distance from a vantage point and keeps, on both sides, the least and the largest
distance. A query cannot have a point closer than the gap between its own distance and that range.
A leaf is passed over if ``relax`` times the k-th best distance found so far is under the largest gap
on its path: ``relax=1`` is exact, less prunes more.

Rows go to shards by a hash of their id, so any clustering or repeated vector is spread evenly. In a
shard equal vectors are one point with the smallest k+1 ids, all that a result can hold. Vectors come
first and the queries follow in Arrow batches through the same task: a task holds one shard and one
batch. Queries are a stated part of the rows and are dealt to every shard in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
LEAF_ROWS = 256
MIN_SHARDS = 16
#: Measured against brute force: recall 0.999 and more, see the README.
RELAX = 0.5
EPS = 1e-9


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed component by component: equal vectors score equally wherever they lie."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Tree:
    """A vantage-point tree over the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf_rows: int = LEAF_ROWS) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
        _, first, back = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        back = back.ravel()
        by = np.argsort(back, kind="stable")
        again = (np.diff(back[by], prepend=-1) == 0) & (np.diff(ids[by], prepend=ids[by[0]] - 1) == 0)
        by = by[~again]  # a repeated row counts once
        bounds = np.searchsorted(back[by], np.arange(len(first) + 1))
        self.ids = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.points, self.k, self.visits = vectors[first], k, 0
        norms = (self.points**2).sum(1)
        self.top = norms.max()
        self.lift = np.sqrt(np.maximum(self.top - norms, 0))
        self.leaves: list[tuple[np.ndarray, list[tuple[int, int, float, float]]]] = []
        self.vantage: list[int] = []
        self._split(np.arange(len(first)), [], leaf_rows)

    def _split(self, rows: np.ndarray, path: list, leaf_rows: int) -> None:
        todo = [(rows, path)]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append((rows, path))
                continue
            # the point that is farthest from the first one stands at the rim, where halves separate best
            far = rows[np.argmax(self._between(rows[0], rows))]
            d = self._between(far, rows)
            order = np.argsort(d, kind="stable")
            mid, at = len(rows) // 2, len(self.vantage)
            self.vantage.append(far)
            for side in (order[:mid], order[mid:]):
                todo.append((rows[side], [*path, (at, d[side].min(), d[side].max())]))

    def _between(self, row: int, rows: np.ndarray) -> np.ndarray:
        d2 = ((self.points[rows] - self.points[row]) ** 2).sum(1) + (self.lift[rows] - self.lift[row]) ** 2
        return np.sqrt(d2)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, relax: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position of the query, vec_id, score) of the k nearest or more, ties included as far as they can matter."""
        n, k = len(queries), self.k
        q2 = (queries**2).sum(1)
        gap = np.zeros((n, len(self.leaves)))
        if self.vantage:
            v = np.array(self.vantage)
            d = np.sqrt(np.maximum(q2[:, None] + self.top - 2 * queries @ self.points[v].T, 0))
            for j, (_, path) in enumerate(self.leaves):
                for at, low, high in path:
                    np.maximum(gap[:, j], np.maximum(low - d[:, at], d[:, at] - high), out=gap[:, j])
        best = np.full((n, k + 1), -np.inf)  # by inner product; one more, as the query itself may be among them
        seen: list[list[np.ndarray]] = [[] for _ in range(3)]
        home = np.argmin(gap, axis=1)

        def visit(j: int, who: np.ndarray) -> None:
            points = self.leaves[j][0]
            score = queries[who] @ self.points[points].T
            # copies of one point count as often as a result can hold them
            times = np.array([len(self.ids[p]) for p in points])
            wide = np.repeat(score, times, axis=1) if times.max(initial=1) > 1 else score
            every = np.concatenate([best[who], wide], axis=1)
            best[who] = np.sort(np.partition(every, every.shape[1] - k - 1, axis=1)[:, -k - 1 :], axis=1)
            a, b = np.nonzero(score >= best[who][:, :1] - EPS * (1 + np.abs(best[who][:, :1])))
            for held, new in zip(seen, (who[a], points[b], score[a, b]), strict=True):
                held.append(new)

        for j in np.unique(home):  # first the leaf that the query itself would lie in, for a good k-th best
            visit(j, np.flatnonzero(home == j))
        for j in np.argsort(gap.mean(axis=0)):
            kth = best[:, 0]
            reach = np.sqrt(np.maximum(q2 + self.top - 2 * np.where(np.isfinite(kth), kth, 0), 0))
            live = (home != j) & (~np.isfinite(kth) | (gap[:, j] <= relax * reach + EPS))
            if live.any():
                visit(j, np.flatnonzero(live))
                self.visits += int(live.sum())
        if not seen[0]:
            return
        who, point, score = (np.concatenate(x) for x in seen)
        keep = score >= best[who, 0] - EPS * (1 + np.abs(best[who, 0]))
        who, point = who[keep], point[keep]
        exact = inner(queries[who], self.points[point])
        times = np.array([len(self.ids[p]) for p in point])
        ids = np.concatenate([self.ids[p] for p in point])
        who, exact = np.repeat(who, times), np.repeat(exact, times)
        own = ids != query_ids[who]
        who, ids, exact = who[own], ids[own], exact[own]
        by = np.lexsort((ids, -exact, who))
        who, ids, exact = who[by], ids[by], exact[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        yield who[place < k], ids[place < k], exact[place < k]


def _usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(table: DataFrame, queries: Column, k: int = 20, relax: float = RELAX, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows of every query among all rows but itself: ``query_id, rank, vec_id, score``.

    ``queries`` is a condition on the table's rows (in terms of its own columns). Scores are inner
    products of the stored vectors in double precision; ties go to the smaller id. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors
    are compared with those of the same length only. Rows with equal id and vector count once. Fewer
    candidates than k give fewer rows; an empty table gives none. Extra columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v")))
    shards = max(MIN_SHARDS, -(-table.count() // shard_rows))
    dim = F.size("v")
    points = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), dim.alias("dim"), F.lit(0).alias("kind"), "id", "v")
    asks = rows.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), dim.alias("dim"), F.lit(1).alias("kind"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, tree = None, None
        for batch in batches:
            shard, dims, kind, ids = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            cuts = np.flatnonzero(np.diff(shard) | np.diff(dims) | np.diff(kind)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                key = (shard[a], dims[a])
                if key != now:
                    held, now, tree = [], key, None
                vectors = flat[offsets[a] : offsets[b]].reshape(b - a, dims[a])
                if kind[a] == 0:
                    held.append((ids[a:b], vectors))
                    continue
                if not held:
                    continue
                tree = tree or Tree(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k)
                for at in range(a, b, 1024):
                    some = slice(at - a, min(at + 1024, b) - a)
                    asked = ids[a:b][some]
                    for who, found, score in tree.search(asked, vectors[some], relax):
                        yield pa.record_batch([pa.array(asked[who]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    dealt = points.unionByName(asks).repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "kind", "id")
    # one exchange by query serves both the repeated queries and the ranking
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double").repartition("query_id").dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
