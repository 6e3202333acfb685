"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.session import cut_lineage


#: Links that a task of a round gets at least, so that a few links do not become a file for each shuffle partition.
TASK_ROWS = 20_000
#: Links that are finished in one task, as arrays of 16 MB; more take rounds of joins.
LOCAL_ROWS = 1_000_000
#: Links that are finished on the driver where tasks run without Python: 1.6 MB.
DRIVER_ROWS = 100_000
#: Links whose cycles a task takes out at once.
FOREST_ROWS = 200_000


def settle(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of all pairs (i, j): the larger root goes below the smaller one, until none differ."""
    while len(i):
        a, b = parent[i], parent[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _roots(pairs: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(u, v): all nodes of some links and the smallest node that each is joined with."""
    u, v = (np.concatenate([np.empty(0, np.int64), *(p.column(k).to_numpy() for p in pairs)]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    settle(parent, place[: len(u)], place[len(u) :])
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[parent])], names=["u", "v"])


def _joined(links: DataFrame, rows: int | None) -> DataFrame:
    """(u, v): each node and the smallest one that it is joined with by the links of a task, ``rows`` links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if rows and sum(b.num_rows for b in held) >= rows:
                yield _roots(held)
                held = []
        if held:
            yield _roots(held)

    return links.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame, rounds: int = 64, native: bool = False) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is the smallest node in it.

    Each round is one minimum per node, combined before the shuffle, and one join of the edges with it:
    a node with very many edges is a skewed join side that Spark splits, never one group in memory. Rounds
    end when nothing changes, after about the logarithm of the longest path. Self-links keep a node.
    The number of tasks follows the counted links, up to the session's shuffle partitions.
    Before that, each task replaces its links by a star for each of their trees; at most ``LOCAL_ROWS``
    links that are left are finished by one task, so that only many links take rounds. With ``native``
    no task runs Python: at most ``DRIVER_ROWS`` links are finished on the driver instead.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    left = links.count()
    tasks = -(-left // TASK_ROWS) or 1
    named = [F.col("u").alias("node"), F.col("v").alias("component")]
    if native and left <= DRIVER_ROWS:
        stars = pa.Table.from_batches([_roots(links.select("u", "v").toArrow().to_batches())])
        return cut_lineage(links.sparkSession.createDataFrame(stars).coalesce(1)).select(*named)
    if not native:
        links = cut_lineage(_joined(links.coalesce(tasks), FOREST_ROWS))
        left = links.count()
        if left <= LOCAL_ROWS:
            return cut_lineage(_joined(links.coalesce(1), None)).select(*named)
        tasks = -(-left // TASK_ROWS)

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        """Large star: every larger neighbour moves to the smallest one; small star: every smaller one does."""
        view = pairs.select("u", "v")
        if both:
            view = view.unionByName(view.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = view.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = view.join(least, "u")
        if both:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            # A node keeps its own link to the root.
            own = least.select("u", F.col("m").alias("v"))
            return moved.unionByName(own).coalesce(tasks).distinct().coalesce(tasks)
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)

    for _ in range(rounds):
        nxt = cut_lineage(star(cut_lineage(star(links, True)), False))
        # Done when each node has one link, to a node that has none: stars only.
        links, away = nxt, nxt.where("u <> v")
        several = away.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        middle = away.select(F.col("v").alias("u")).distinct().join(away.select("u"), "u", "left_semi")
        if not several.limit(1).unionByName(middle.limit(1)).count():
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    raise RuntimeError("components did not settle")
