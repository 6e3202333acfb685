"""Ordered look-back over long sequences without one task per recording.

The sequence is cut into segments of the ordering column; windows run inside a segment and a small
table with one row per segment carries the last value across segment borders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(
    df: DataFrame, by: list[str], order: str, value: Column, span: float, output: str,
    inclusive: bool = False, ties: list[str] | None = None,
) -> DataFrame:
    """Last non-null ``value`` of the rows before the current one (or up to it)."""
    rows = df.withColumn("_seg", F.floor(F.col(order) / span).cast("bigint")).withColumn("_val", value)
    tie = ties or []
    spec = Window.partitionBy(*by, "_seg").orderBy(order, *tie).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    position = F.struct(order, *tie)
    summary = rows.where(F.col("_val").isNotNull()).groupBy(*by, "_seg").agg(F.max_by("_val", position).alias("_end"))
    all_segments = rows.groupBy(*by, "_seg").agg(F.lit(1).alias("_one")).drop("_one")
    over = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        all_segments.join(summary, [*by, "_seg"], "left")
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(over))
        .select(*by, "_seg", "_carry")
    )
    return (
        rows.withColumn("_local", F.last("_val", ignorenulls=True).over(spec))
        .join(carried, [*by, "_seg"])
        .withColumn(output, F.coalesce("_local", "_carry"))
        .drop("_seg", "_val", "_local", "_carry")
    )


def islands(
    df: DataFrame, by: list[str], order: str, joins: Callable[[Column, Column], Column], span: float,
    output: str = "island", ties: list[str] | None = None,
) -> DataFrame:
    """Label runs: a row belongs to the run of its predecessor when ``joins(previous, current)``.

    The label is the ordering value of the run's first row.
    """
    seen = last_before(df, by, order, F.col(order), span, "_prev", ties=ties)
    starts = F.when(F.col("_prev").isNull() | ~joins(F.col("_prev"), F.col(order)), F.col(order))
    return last_before(seen, by, order, starts, span, output, inclusive=True, ties=ties).drop("_prev")


def nearest(
    keys: DataFrame, points: DataFrame, by: list[str], key_time: str, point_time: str, span: float, id_column: str
) -> DataFrame:
    """For every key the nearest point in time; on a tie the earlier one. As-of from both sides:
    keys and points are merged into one sequence and looked through forwards and backwards."""
    merged = keys.select(*by, F.col(key_time).cast("double").alias("_t"), id_column, F.lit(None).cast("double").alias("_p"))
    merged = merged.unionByName(
        points.select(
            *by, F.col(point_time).cast("double").alias("_t"),
            F.lit(None).cast(keys.schema[id_column].dataType).alias(id_column),
            F.col(point_time).cast("double").alias("_p"),
        )
    )
    # Points sort before keys of the same instant in both directions.
    merged = merged.withColumn("_is_key", F.col("_p").isNull().cast("int"))
    back = last_before(merged, by, "_t", F.col("_p"), span, "_before", ties=["_is_key"])
    both = last_before(
        back.withColumn("_neg", -F.col("_t")), by, "_neg", F.col("_p"), span, "_after", ties=["_is_key"]
    )
    gap_before, gap_after = F.col("_t") - F.col("_before"), F.col("_after") - F.col("_t")
    pick = F.when(
        F.col("_after").isNull() | (gap_before <= gap_after), F.col("_before")
    ).otherwise(F.col("_after"))
    return both.where(F.col("_p").isNull()).select(*by, id_column, F.col("_t").alias(key_time), pick.alias("nearest_time"))
