"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Inner product becomes distance by one more component: with M the largest norm, candidates become
(x, sqrt(M^2 - |x|^2)) and queries (q M / |q|, 0); the nearest is then the one of largest inner
product. DIMS Gaussian (2-stable) projections turn a distance d into d^2 times a chi-square
variable. Projections are dealt to shards and indexed in each by a kd-tree.

A query takes rows in the order of their projected distance: leaves are opened by the distance of
their boxes, and a row is verified with the exact measure once no unopened leaf can hold a nearer
projection. With D the projected distance of the next row and d_k the k-th verified distance, the
search stops when the chi-square distribution of DIMS degrees gives D^2 / d_k^2 at least
CONFIDENCE: any row nearer than d_k would by then have been seen with that probability. So each
true neighbour is found with at least that probability, whatever the data. d_k is propagated from
the query's own shard to others, and those whose box is beyond the stop aren't visited.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import _vectors
from lakeloom.llm._vectors import Shard, Space, merge

DIMS, CONFIDENCE, SEED = 16, 0.93, 11
#: Queries whose box distances are computed together, and rows first verified (then twice as many).
TOGETHER, FIRST = 128, 64


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_at(p: float, degrees: int) -> float:
    """The value that a chi-square variable stays below with probability ``p``."""
    if degrees < 2 or degrees % 2:
        raise ValueError("the number of projections must be even")
    lo, hi = 0.0, 1000.0 + 10 * degrees
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, degrees) < p else (lo, mid)
    return hi


class Projected(Space):
    score_type, zeros = "double", False

    def __init__(self, norm: float, stop: float, dims: int = DIMS):
        self.norm, self.stop, self.dims = norm, stop, dims

    def matrix(self, d: int) -> np.ndarray:
        return np.random.default_rng(SEED).normal(size=(d + 1, self.dims))

    def rows(self, points):
        last = np.sqrt(np.maximum(0, self.norm**2 - (points**2).sum(axis=1)))
        return np.column_stack([points, last]) @ self.matrix(points.shape[1])

    def queries(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and coordinates in index space."""
        length = np.sqrt((queries**2).sum(axis=1))
        return length, queries * (self.norm / length)[:, None] @ self.matrix(queries.shape[1])[:-1]

    def limits(self, kth, length):
        """Squared projected distance at which the test stops; infinite without a k-th score."""
        return self.stop * np.maximum(0, 2 * self.norm * (self.norm - kth / length))

    @staticmethod
    def gaps(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance of each query (row) to each box (column)."""
        out = np.zeros((len(at), len(lo)))
        for j in range(lo.shape[1]):
            x = at[:, j, None]
            out += np.maximum(np.maximum(lo[:, j] - x, x - hi[:, j]), 0) ** 2
        return out

    def reach(self, lo, hi, queries, kth):
        length, at = self.queries(queries)
        return self.gaps(lo, hi, at) < self.limits(kth, length)[:, None]

    def search(self, shard: Shard, query_ids, queries, kths, near, k):
        length, low = self.queries(queries)
        leaves = np.flatnonzero(shard.nodes[:, 2] < 0)
        squares = (shard.coords**2).sum(axis=1)
        # rows are first scored in single precision; slack is the most that this can be off
        small = 1e-15 < self.norm < 1e15 and 1e-15 < length.min() and length.max() < 1e15
        kind = np.float32 if small else np.float64
        slack = length * self.norm * (queries.shape[1] + 8) * float(np.finfo(kind).eps)
        rough = shard.points.astype(kind)
        for at in range(0, len(queries), TOGETHER):
            some = low[at : at + TOGETHER]
            far = self.gaps(shard.lo[leaves], shard.hi[leaves], some)
            # where most leaves will be opened, all projected distances come from one product
            most = (far < self.limits(kths[at : at + TOGETHER], length[at : at + TOGETHER])[:, None]).mean() > 0.5
            every = squares - 2 * some @ shard.coords.T + (some**2).sum(axis=1)[:, None] if most else [None] * len(some)
            for i, (own, d) in enumerate(zip(far, every), at):
                yield self._incremental(shard, rough, slack[i], leaves, own, d, query_ids[i], queries[i], low[i], length[i], kths[i], near[i], k)

    def _incremental(self, shard: Shard, rough, slack, leaves, far, every, qid, q, low, length, kth, near, k):
        best, scores = near
        mine, seen = np.zeros(len(best), bool), 0
        limit = self.limits(kth, length)
        order, single = np.argsort(far), q.astype(rough.dtype)
        waiting, at, many, opened, wave = np.zeros(0, np.int64), np.zeros(0), FIRST, 0, 1
        while True:
            # open leaves by the distance of their boxes, more each time
            fresh = order[opened : opened + wave]
            fresh = fresh[far[fresh] < limit]
            opened, wave = opened + wave, 2 * wave
            if len(fresh):
                spans = shard.nodes[leaves[fresh], :2]
                rows = np.concatenate([np.arange(s, e) for s, e in spans])
                d = ((shard.coords[rows] - low) ** 2).sum(axis=1) if every is None else every[rows]
                waiting, at = np.concatenate([waiting, rows]), np.concatenate([at, d])
            beyond = far[order[opened]] if opened < len(order) else np.inf
            # rows that no unopened leaf can come before, nearest projections first
            ready = np.flatnonzero(at < min(beyond, limit))
            if len(ready):
                ready = ready[np.argsort(at[ready])]
                done = 0
                while done < len(ready) and at[ready[done]] < limit:
                    some = ready[done : done + many]
                    some = some[at[some] < limit]
                    done, many = done + len(some), 2 * many
                    rows = waiting[some]
                    seen += len(rows)
                    rows = rows[(rough[rows] @ single >= kth - slack) & (shard.ids[rows] != qid)]
                    if len(rows):
                        # a row's sum doesn't depend on the rows beside it, so equal vectors tie
                        got = (shard.points[rows] * q).sum(axis=1)
                        best, scores, mine = merge(best, scores, mine, shard.ids[rows], got, k)
                        if len(best) == k and scores[-1] > kth:
                            kth = scores[-1]
                            limit = self.limits(kth, length)
                rest = np.ones(len(at), bool)
                rest[ready] = False
                waiting, at = waiting[rest], at[rest]
            if beyond >= limit:
                return best[mine], scores[mine], seen


def space_of(table: DataFrame, vector: str = "embedding", confidence: float = CONFIDENCE, dims: int = DIMS) -> Projected:
    """The projection for a table: its largest norm is needed (one scan)."""
    rows = table.filter(_vectors.valid(table, vector, True))
    norm = rows.agg(F.max(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    return Projected(math.sqrt(norm or 1.0) * (1 + 1e-12), chi_square_at(confidence, dims), dims)


def nearest(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE, dims: int = DIMS) -> DataFrame:
    """query_id, rank, vec_id and score (inner product in doubles) of the nearest found.

    Queries: rows whose key is divisible by ``every``; candidates: all others' rows; ties go to
    the smaller key. Every vector is indexed; null, zero, null-holding and non-finite ones take no
    part, rows equal in key and vector count once. ``dims`` must be even. The expected recall is
    ``confidence`` at least; at most k rows come back where fewer candidates exist.
    """
    return _vectors.search(table, space_of(table, vector, confidence, dims), every, k, key, vector)


def verified(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE, dims: int = DIMS) -> DataFrame:
    """One row: queries, shards visited a query, and rows verified a query."""
    return _vectors.verified(table, space_of(table, vector, confidence, dims), every, k, key, vector)
