"""Exact top-k inner products with segment statistics as bounds, from coarse to fine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecairn.llm.blocks import best, search_blocks, usable


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, times the root of the segment length, side by side.

    With these, |x - y|^2 is at least the squared distance of the statistics (sums over segments of
    length * ((mean - mean)^2 + (deviation - deviation)^2)). Vectors are filled up with zeros.
    """
    width = -(-x.shape[1] // segments)
    full = np.zeros((len(x), width * segments))
    full[:, : x.shape[1]] = x
    parts = full.reshape(len(x), segments, width)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(width)


def top_products(qid: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, levels: tuple[int, ...] = (1, 4, 16)) -> tuple:
    """The k largest integer inner products of every query with the rows of a block other than itself.

    The inner product is (|q|^2 + |x|^2 - |q - x|^2) / 2, so a lower bound of the distance is an upper bound
    of the score. Levels are refined only for rows whose bound reaches the k-th best exact score so far;
    rows that could tie stay. All survivors of the last level are computed in integers: machine words while
    no sum can leave them, else Python's.
    """
    q, x = queries.astype(np.float64), data.astype(np.float64)
    largest = max(np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0))
    exactly = (lambda m: m.astype(np.int64)) if largest * largest * x.shape[1] < 1 << 62 else (lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape))
    queries, data = exactly(q), exactly(x)
    levels = levels if largest < 1e100 else ()  # squares that leave the doubles bound nothing
    q2, x2 = ((m * m).sum(axis=1) if levels else np.zeros(len(m)) for m in (q, x))
    stats = [(segment_statistics(q, s), segment_statistics(x, s)) for s in levels]
    squares = [((a * a).sum(axis=1), (b * b).sum(axis=1)) for a, b in stats]
    out_q, out_v, out_s = [], [], []
    for r in range(len(q)):
        alive = np.flatnonzero(ids != qid[r])
        exact: dict[str, np.ndarray] = {}
        least = -np.inf
        slack = 1e-9 * (q2[r] + x2.max(initial=0.0)) + 1e-6
        for (a, b), (a2, b2) in zip(stats, squares):
            if len(alive) <= 2 * k:
                break
            distance = np.maximum(a2[r] + b2[alive] - 2 * (b[alive] @ a[r]), 0.0)
            bound = (q2[r] + x2[alive] - distance) / 2
            probe = alive[np.argpartition(-bound, k - 1)[:k]]
            reached = np.sort(data[probe] @ queries[r])[0]
            least = max(least, float(reached))
            alive = alive[bound >= least - slack]
        exact = data[alive] @ queries[r]
        order = np.lexsort((ids[alive], -exact))[:k]
        out_q.append(np.full(len(order), qid[r]))
        out_v.append(ids[alive][order])
        out_s.append(exact[order])
    found = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_q, out_v, out_s)]
    if any(abs(int(v)) >= 1 << 63 for v in found[2]) if found[2].dtype == object else False:
        raise OverflowError("a score among the largest does not fit a long")
    return found[0], found[1], found[2].astype(np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of floor(scale * x) for every query row.

    ``vectors`` has vec_id and embedding. Vectors that are null, empty or hold null or non-finite components
    take no part. Scores are exact whatever the size of the components; one of the k largest that does not
    fit a long is an error. Only vectors of one length meet. Candidates are all rows with another vec_id than the query's, all
    of them if fewer than k; repeated ids count as separate candidates. Null vec_ids take no part.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    whole = lambda m: np.floor(m * scale)
    found = search_blocks(rows, is_query, lambda a, b, c, d: top_products(a, whole(b), c, whole(d), k), "bigint")
    return best(found, k, largest=True)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
