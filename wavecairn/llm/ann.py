"""Approximate nearest neighbours by collision counting over sorted projections (query-aware hashing)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecairn.llm.blocks import best, search_blocks, usable


class SortedProjections:
    """``m`` single random projections of a block, each as a sorted array with the rows in that order."""

    def __init__(self, data: np.ndarray, m: int, seed: int):
        self.direction = np.random.default_rng(seed).standard_normal((data.shape[1], m))
        values = data @ self.direction
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(values.T, self.order, axis=1))

    def windows(self, queries: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the query-centred windows: arrays (query, radius, projection) of first and past-last places."""
        centre = queries @ self.direction
        low, high = (np.empty((len(queries), len(radii), len(self.order)), dtype=np.int64) for _ in range(2))
        for m, values in enumerate(self.values):
            at = centre[:, m][:, None]
            low[:, :, m] = np.searchsorted(values, at - radii[None, :], side="left")
            high[:, :, m] = np.searchsorted(values, at + radii[None, :], side="right")
        return low, high


def nearest_in_block(
    qid: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, m: int = 64, threshold: float = 0.75,
    fraction: float = 0.1, per_neighbour: int = 30, growth: float = 1.25, seed: int = 17,
) -> tuple:
    """The k nearest verified rows of a block for every query, as (query ids, ids, distances).

    A row collides with a query in a projection while their difference lies in the window. Windows grow by
    virtual rehashing (radius times ``growth``), only the new ends of each are counted. A row that reaches
    ``threshold * m`` collisions is verified with its exact distance. The search of a query ends when
    ``per_neighbour * k + fraction * rows`` are verified, or when the windows hold all rows.
    """
    x, q = data.astype(np.float64), queries.astype(np.float64)
    index = SortedProjections(x, m, seed)
    spread = float(np.abs(index.values - np.median(index.values, axis=1, keepdims=True)).mean()) or 1.0
    farthest = float(max(np.abs(index.values).max(initial=0.0), np.abs(q @ index.direction).max(initial=0.0))) * 2 + spread
    radii = [spread * 0.6]
    while radii[-1] < farthest:
        radii.append(radii[-1] * growth)
    radii.append(np.inf)
    low, high = index.windows(q, np.array(radii))
    need, enough = max(1, int(np.ceil(threshold * m))), per_neighbour * k + int(np.ceil(fraction * len(x)))
    out_q, out_v, out_s = [], [], []
    for r in range(len(q)):
        counts = np.zeros(len(x), dtype=np.int64)
        old_low = old_high = None
        verified = np.empty(0, dtype=np.int64)
        for level in range(len(radii)):
            lo, hi = low[r, level], high[r, level]
            if old_low is None:
                new = [index.order[j, a:b] for j, (a, b) in enumerate(zip(lo, hi)) if b > a]
            else:
                new = [index.order[j, a:b] for j, (a, b) in enumerate(zip(lo, old_low)) if b > a]
                new += [index.order[j, a:b] for j, (a, b) in enumerate(zip(old_high, hi)) if b > a]
            if new:
                counts += np.bincount(np.concatenate(new), minlength=len(x))
            old_low, old_high = lo, hi
            verified = np.flatnonzero(counts >= need)
            if len(verified) >= enough:
                break
        verified = verified[ids[verified] != qid[r]]
        distance = np.sqrt(((x[verified] - q[r]) ** 2).sum(axis=1))
        order = np.lexsort((ids[verified], distance))[:k]
        out_q.append(np.full(len(order), qid[r]))
        out_v.append(ids[verified][order])
        out_s.append(distance[order])
    return tuple(np.concatenate(v) if v else np.empty(0) for v in (out_q, out_v, out_s))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row by Euclidean distance.

    ``vectors`` has vec_id and embedding. Vectors that are null, empty, all zero or hold null or non-finite
    components take no part, nor do null vec_ids. Candidates are all rows with another vec_id than the
    query's, all of them if fewer than k; equal distances go to the smaller vec_id, repeated ids count as
    separate candidates. Every row is in the index; each pair of blocks is one bounded task.
    """
    rows = vectors.where(usable(F.col("embedding"), zero=False) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("vector"))
    found = search_blocks(rows, is_query, lambda a, b, c, d: nearest_in_block(a, b, c, d, k, **options), "double")
    return best(found, k, largest=False)
