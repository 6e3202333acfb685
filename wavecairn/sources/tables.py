"""Graph and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.session import shared_folder

REC = ["recording_id"]


def both_directions(edges: DataFrame) -> DataFrame:
    """Every undirected edge as two rows, as graph-learning readers expect."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.withColumn("_e", F.explode(ends)).select(*[F.col(f"_e.{c}").alias(c) if c in ("src", "dst") else c for c in edges.columns])


def write_graph(edges: DataFrame, path: str | None = None) -> DataFrame:
    """Store edges in both directions, range-partitioned by recording and window.

    A range, not a folder per recording: a long recording spreads over many files, and reloading
    one window reads only the files whose statistics match.
    """
    spark = edges.sparkSession
    path = path or f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    both_directions(edges).repartitionByRange(*REC, "w").sortWithinPartitions(*REC, "w", "src").write.parquet(path)
    return spark.read.parquet(path)


def write_nodes(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """Store nodes with their feature arrays and flags, laid out as the edges are."""
    spark = nodes.sparkSession
    path = path or f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    nodes.repartitionByRange(*REC, "w").sortWithinPartitions(*REC, "w", "ch_index").write.parquet(path)
    return spark.read.parquet(path)


def read_windows(stored: DataFrame, first: int, last: int) -> DataFrame:
    """Nodes or edges of the windows ``first`` to ``last``: the range reaches the file statistics. Edges come once."""
    rows = stored.where(F.col("w").between(first, last))
    return rows.where(F.col("src") < F.col("dst")) if "src" in stored.columns else rows


def read_window(stored: DataFrame, w: int) -> DataFrame:
    """One window of a stored graph, each undirected edge once."""
    return stored.where((F.col("w") == w) & (F.col("src") < F.col("dst")))


def report_json(events: DataFrame, audit: DataFrame, context: DataFrame, roles: DataFrame, summary: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One JSON document per recording (and montage, when it is a column).

    Events, audit rows and channels of one recording are report-sized: they are what one file of
    the report holds.
    """
    by = [*REC, *(extra or [])]

    def nest(table: DataFrame, name: str, order: list[str]) -> DataFrame:
        fields = [*order, *[c for c in table.columns if c not in by and c not in order]]
        return table.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    maps = audit.withColumn("detail", F.map_entries("detail"))
    out = context.select(*by, F.struct("tier", "time_s", "label", "duration_s").alias("event")).join(
        audit.select(*by).distinct(), by, "right"
    )
    for table, name, order in ((events, "events", ["rank"]), (maps, "audit", ["step"]), (roles, "channels", ["ch_index"])):
        out = out.join(nest(table, name, order), by, "left")
    out = out.join(summary.select(*by, "summary"), by, "left")
    names = [c for c in out.columns if c not in by]
    return out.select(*by, F.to_json(F.struct(*by, *names)).alias("report"))


def comparison_json(summary: DataFrame) -> DataFrame:
    """One JSON document per recording: its rows of ``montage_summary`` under ``rows``, by montage reference.

    A recording that was run under one reference only has a document with one row. Missing numbers are
    left out of a row, as a correlation without any defined step.
    """
    fields = [F.col("montage").alias("montage_reference"), *[c for c in summary.columns if c not in (*REC, "montage")]]
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    return summary.groupBy(*REC).agg(rows.alias("rows")).select(*REC, F.to_json(F.struct(*REC, "rows")).alias("report"))


def read_comparison(spark, path: str, summary: DataFrame) -> DataFrame:
    """The rows of stored comparison documents again, with the columns of ``summary``."""
    fields = ", ".join(f"{'montage_reference' if n == 'montage' else n}: {t}" for n, t in summary.dtypes if n not in REC)
    found = spark.read.text(path).select(F.from_json("value", f"recording_id string, rows array<struct<{fields}>>").alias("d"))
    return found.select("d.recording_id", F.explode("d.rows").alias("r")).select(*REC, "r.*").withColumnRenamed("montage_reference", "montage")


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines; the key columns stay inside the documents, so no folder per recording is made."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_events_csv(events: DataFrame, path: str) -> None:
    flat = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in events.dtypes]
    events.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """Montage listings or source summaries, one text per recording."""
    texts.select("recording_id", column).write.mode("overwrite").json(path)
