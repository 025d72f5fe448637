"""Nearest neighbours by inner product with a vantage-point tree per shard.

Inner products are no metric, so each shard lifts its vectors by one coordinate,
sqrt(M^2 - |x|^2) with M the shard's largest norm: Euclidean nearness of the lifted
vectors is the order of inner products. Each tree node holds the range of distances
from its vantage point to the points of either side. A side whose range lies
further from the query's distance than the query's current k-th distance can't hold
a nearer point (triangle inequality). `factor` scales that gap: above one it cuts
more and may miss; one restores exact search.

Shards hold a bounded number of rows, so their number follows the table. Queries go
in blocks to every shard; a block walks a tree together, with matrix products at
the leaves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256


class Tree:
    """Distinct vectors of a shard; each with its least `held` ids, which is all that k nearest can use."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, held: int, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        of = rank[of.reshape(-1)]
        self.vectors = vectors[np.sort(first)]  # in order of their least ids
        by = np.argsort(of, kind="stable")
        start = np.searchsorted(of[by], np.arange(len(self.vectors) + 1))
        place = np.arange(len(by)) - np.repeat(start[:-1], np.diff(start))
        few = place < held
        self.ids, self.off = ids[by][few], np.searchsorted(of[by][few], np.arange(len(self.vectors) + 1))
        norm = (self.vectors**2).sum(1)
        self.top = float(norm.max(initial=0.0))
        self.lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(self.top - norm, 0))])
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(self.vectors)))
        del self.random

    def _grow(self, at: np.ndarray) -> tuple:
        if len(at) <= LEAF:
            return (at,)
        point = self.lifted[at[self.random.integers(len(at))]]
        d = np.sqrt(((self.lifted[at] - point) ** 2).sum(1))
        inner = d <= np.median(d)
        if inner.all():
            return (at,)
        a, b = d[inner], d[~inner]
        return (point, (a.min(), a.max(), self._grow(at[inner])), (b.min(), b.max(), self._grow(at[~inner])))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k nearest; a row with the query's own id is none."""
        n, want = len(queries), k + 1  # its own vector may be among them
        lifted = np.column_stack([queries, np.zeros(n)])
        reach = (queries**2).sum(1) + self.top
        slack = 1e-9 * (1 + np.sqrt(reach))
        score = np.full((n, want), -np.inf)
        item = np.full((n, want), -1)
        limit = np.full(n, np.inf)

        def leaf(at: np.ndarray, q: np.ndarray) -> None:
            s = np.concatenate([score[q], queries[q] @ self.vectors[at].T], axis=1)
            i = np.concatenate([item[q], np.broadcast_to(at, (len(q), len(at)))], axis=1)
            pick = np.argpartition(-s, want - 1, axis=1)[:, :want]
            least = np.take_along_axis(s, pick, 1).min(1, keepdims=True)
            tied = np.flatnonzero(((s >= least).sum(1) > want) & np.isfinite(least[:, 0]))
            if len(tied):  # of equal scores the smaller ids stay
                pick[tied] = np.lexsort((i[tied], -s[tied]), axis=1)[:, :want]
            score[q], item[q] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
            worst = score[q].min(1)
            limit[q] = np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(reach[q] - 2 * worst, 0)) + slack[q])

        def walk(node: tuple, q: np.ndarray) -> None:
            if not len(q):
                return
            if len(node) == 1:
                leaf(node[0], q)
                return
            point, *sides = node
            d = np.sqrt(((lifted[q] - point) ** 2).sum(1))
            gap = [np.maximum(np.maximum(lo - d, d - hi), 0) * factor for lo, hi, _ in sides]
            first = gap[1] < gap[0]
            for near, far in ((0, 1), (1, 0)):
                some = first if near else ~first
                for side in (near, far):
                    some_q, g = q[some], gap[side][some]
                    walk(sides[side][2], some_q[g <= limit[some_q]])

        if len(self.vectors):
            walk(self.root, np.arange(n))
        row, col = np.nonzero(item >= 0)
        found = item[row, col]
        size = np.diff(self.off)[found]
        row, found = np.repeat(row, size), np.repeat(found, size)
        ids = self.ids[np.repeat(self.off[item[item >= 0]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        ok = ids != own[row]
        row, found, ids = row[ok], found[ok], ids[ok]
        exact = (queries[row] * self.vectors[found]).sum(1)
        order = np.lexsort((ids, -exact, row))
        row, ids, exact = row[order], ids[order], exact[order]
        head = np.searchsorted(row, np.arange(n))
        best = np.arange(len(row)) - head[row] < k
        return row[best], ids[best], exact[best]


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: float = 1.0,
    shard_rows: int = 16384,
    block_rows: int = 2048,
) -> DataFrame:
    """Each query's k rows with the largest inner product, in double precision, ties to the smaller id.

    Queries are the rows where `is_query` holds; candidates all rows but those with the query's id. Rows with a
    null id, and vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do
    vectors that haven't the commonest length (of equals the shorter). Returns query_id, rank (from 1), id_col,
    score; all candidates if there are fewer than k, no rows for a query without one. A query id that stands in
    several rows is searched with the vector that is first in order. Other columns don't take part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.count_if("q").alias("asks"))
    common = sizes.orderBy(F.desc("c"), "n").first()
    size, total, asks = (common["n"], common["c"], common["asks"]) if common else (0, 0, 0)
    shards, parts = -(-max(total, 1) // shard_rows), -(-max(asks, 1) // block_rows)
    rows = rows.where(F.size("v") == size)

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, size))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(frame["id"].to_numpy(), matrix(frame["v"]), k + 1)
        return pd.DataFrame({"shard": frame["shard"].iloc[:1].astype(np.int64), "tree": pd.Series([pickle.dumps(tree)], dtype=object, index=frame.index[:1])})

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps((frame["id"].to_numpy(), matrix(frame["v"])))
        return pd.DataFrame({"part": frame["part"].iloc[:1].astype(np.int64), "asked": pd.Series([blob], dtype=object, index=frame.index[:1])})

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree = None, None
        for frame in frames:
            for blob, asked in zip(frame["tree"], frame["asked"], strict=True):
                if blob != held:
                    held, tree = blob, pickle.loads(blob)
                ids, vectors = pickle.loads(asked)
                row, found, score = tree.search(vectors, ids, k, factor)
                yield pd.DataFrame({"query_id": ids[row], "id": found, "score": score})

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")

    trees = rows.withColumn("shard", dealt(shards)).groupBy("shard").applyInPandas(grow, "shard long, tree binary")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("part", dealt(parts))
    asked = asked.groupBy("part").applyInPandas(gather, "part long, asked binary")
    pairs = asked.select("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")).join(trees, "shard")
    found = pairs.select("tree", "asked").mapInPandas(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # A repeated candidate row stands once in the result: rows, not ids, are counted as candidates.
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
