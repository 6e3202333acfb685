"""Vectors in bounded blocks: every block of queries meets every block of vectors once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool = True) -> Column:
    """Not null, not empty, all components finite; with ``zero`` false also not all zero."""
    x = vector.cast("array<double>")
    good = vector.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(good if zero else good & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(table: pa.Table, name: str = "vector") -> np.ndarray:
    lists = table.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def search_blocks(
    vectors: DataFrame, is_query: Column, search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], score: str,
    rows: int = 4096, queries: int = 2048,
) -> DataFrame:
    """``search(query ids, query matrix, ids, matrix)`` on each pair of blocks: rows (query_id, vec_id, score).

    ``vectors`` has vec_id and vector; only vectors of one length meet. Blocks are dealt evenly by position
    in the scan, so neither equal vectors nor equal ids gather, and a task holds one block of each kind.
    """
    counted = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    data_blocks, query_blocks = max(1, -(-counted["n"] // rows)), max(1, -(-counted["q"] // queries))
    placed = vectors.withColumns({"dim": F.size("vector"), "_at": F.monotonically_increasing_id()})
    block = lambda n: F.pmod(F.col("_at"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = placed.select("dim", block(data_blocks).alias("b"), "vec_id", "vector").withColumn("q", every(query_blocks))
    right = placed.where(is_query).select("dim", F.pmod(F.xxhash64("_at"), F.lit(query_blocks)).cast("int").alias("q"), "vec_id", "vector").withColumn("b", every(data_blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score == "double" else pa.int64())])

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return schema.empty_table()
        q, v, s = search(asked.column("vec_id").to_numpy(), matrix(asked), data.column("vec_id").to_numpy(), matrix(data))
        return pa.table([pa.array(q), pa.array(v), pa.array(s)], schema=schema)

    return left.groupBy("dim", "b", "q").cogroup(right.groupBy("dim", "b", "q")).applyInArrow(run, f"query_id bigint, vec_id bigint, score {score}")


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best of every query, ties to the smaller vec_id."""
    order = F.desc("score") if largest else F.asc("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
