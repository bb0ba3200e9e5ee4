"""Exact top-k by inner product with kd-trees per shard.

Each shard's vectors form a kd-tree of median splits with tight bounding boxes, built once. A query
walks it best first: a heap of nodes by the largest inner product that their box allows. It ends
when that bound falls below the k-th score. That score is propagated: a query starts in its own
shard, and meets others with what it found there, if their boxes reach it at all.

How much is pruned depends on the data alone. Where vectors form groups most shards and leaves are
left out; independent random directions in many dimensions fill every box, and all is visited.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from lakeloom.llm import _vectors
from lakeloom.llm._vectors import Shard, Space, merge

STEPS = 256
#: Sums of integers up to this size are exact in doubles.
EXACT = float(1 << 53)
#: Queries whose bounds of all nodes are computed together.
TOGETHER = 1024


def quantise(vectors: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * vectors)


def _exactly(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores of values too large for doubles, cut to 64 bits."""
    p, q = points.astype(object), query.astype(object)
    whole = [[int(x) for x in row] for row in p]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(row, q)))) for row in whole], np.int64)


class Quantised(Space):
    score_type, zeros = "bigint", True

    def prepare(self, vectors: np.ndarray) -> np.ndarray:
        return quantise(vectors)

    def bounds(self, lo: np.ndarray, hi: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each box."""
        return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T

    def reach(self, lo, hi, queries, kth):
        most = np.maximum(np.abs(lo), np.abs(hi)).max(initial=0) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
        if most >= EXACT:
            return np.ones((len(queries), len(lo)), bool)
        return self.bounds(lo, hi, queries) >= kth[:, None]

    def search(self, shard: Shard, query_ids, queries, kths, near, k):
        ids, points = shard.ids, shard.points
        if np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * points.shape[1] >= EXACT:
            for qid, q in zip(query_ids, queries):
                other = ids != qid
                none = (ids[:0], np.zeros(0, np.int64), np.zeros(0, bool))
                yield *merge(*none, ids[other], _exactly(points[other], q), k)[:2], int(other.sum())
            return
        for at in range(0, len(queries), TOGETHER):
            upper = self.bounds(shard.lo, shard.hi, queries[at : at + TOGETHER])
            for i, limit in enumerate(upper, at):
                yield self._walk(shard, query_ids[i], queries[i], kths[i], near[i], limit, k)

    def _walk(self, shard: Shard, qid, q, kth, near, limit, k):
        best, scores = near[0], near[1].astype(np.float64)
        own, seen = np.zeros(len(best), bool), 0
        heap = [(-limit[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            s, e, left, right = shard.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if limit[child] >= kth:
                        heapq.heappush(heap, (-limit[child], child))
                continue
            seen += int(e - s)
            got = shard.points[s:e] @ q
            good = (got >= kth) & (shard.ids[s:e] != qid)
            if good.any():
                best, scores, own = merge(best, scores, own, shard.ids[s:e][good], got[good], k)
                if len(best) == k:
                    kth = max(kth, scores[-1])
        return best[own], scores[own].astype(np.int64), seen


def top_k(table: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (integer inner product of floor(256 x)), exact.

    Queries: rows whose key is divisible by ``every``; candidates: all others' rows. Ties go to
    the smaller key. Vectors null or with null or non-finite components take no part; rows equal
    in key and vector count once. Scores beyond 64 bits are cut to that range. Shards and batches
    of queries have bounded size.
    """
    return _vectors.search(table, Quantised(), every, k, key, vector)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
