"""Checks of the sources: recordings written as EDF+ files out of the given tables and read again."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import sql as S
from checks.fixtures import ship_day, supplier_cells, supplier_waves, table
from checks.registry import check, final, shape
from wavecairn.operators.framing import CHANNEL, crop_places, per_block
from wavecairn.session import shared_folder
from wavecairn.sources.edf import read_edf
from wavecairn.sources.edf_sink import write_edf

K = "recording_id channel ch_index#"
RECORD = 100
START = dt.datetime(2024, 5, 6, 7, 8, 9)

MARKED = """
mk_cells AS (SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS i, count(*) AS v FROM lineitem GROUP BY ALL),
mk AS (SELECT g.recording_id, 'MKR1+' AS channel, 7 AS ch_index, r.range AS i, coalesce(c.v, 0) AS v
  FROM (SELECT DISTINCT recording_id FROM s) g CROSS JOIN range(2500) r LEFT JOIN mk_cells c ON c.recording_id = g.recording_id AND c.i = r.range),
nt AS (SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, min(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS onset,
    'возврат ' || count(*) AS description FROM lineitem WHERE l_returnflag = 'R'
  GROUP BY l_suppkey, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 100)"""


def recordings(spark, sf):
    """Folder with a file per supplier: a signal per line number, a marker channel of line counts, an annotation a record."""
    s = supplier_waves(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("recording_id"), ship_day().alias("i"), "l_returnflag")
    marks = supplier_cells(spark, lines.where("i IS NOT NULL").select(
        "recording_id", F.lit("MKR1+").alias("channel"), F.lit(7).alias("ch_index"), "i", F.lit(1.0).alias("q")))
    notes = lines.where("l_returnflag = 'R'").groupBy("recording_id", F.floor(F.col("i") / RECORD)).agg(
        F.min("i").cast("double").alias("onset"), F.concat(F.lit("возврат "), F.count("*").cast("string")).alias("description"))
    folder = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    write_edf(s.unionByName(marks), folder, RECORD, float(RECORD), START, notes)
    return folder


_SUMS = f"{K} n# total: weighted: low: high:"
_SUMS_SQL = "SELECT recording_id, channel, ch_index, count(*) AS n, sum(v) AS total, sum(v * i) AS weighted, min(v) AS low, max(v) AS high FROM {0} GROUP BY ALL"


def _sums(blocks):
    """Sums of each array, and of them those of each channel: no sample becomes a row."""

    def kernel(v, row):
        at = np.arange(row["i0"], row["i0"] + len(v))
        return {k: np.array([x]) for k, x in (("n", len(v)), ("total", v.sum()), ("weighted", (v * at).sum()), ("low", v.min()), ("high", v.max()))}

    outputs = [("n", T.LongType()), *[(c, T.DoubleType()) for c in ("total", "weighted", "low", "high")]]
    parts = per_block(blocks.where(F.size("v") > 0), kernel, outputs)
    return shape(parts.groupBy(*CHANNEL).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("weighted").alias("weighted"), F.min("low").alias("low"), F.max("high").alias("high")), _SUMS)


@check("a1_edf_scan", S.query(S.supplier_days(), f"o AS ({_SUMS_SQL.format('s')})", select=final(_SUMS, "o")))
def a1(spark, sf):
    return _sums(read_edf(spark, recordings(spark, sf)))


@check("a2_edf_markers", S.query(S.supplier_days(), MARKED, f"o AS ({_SUMS_SQL.format('mk')})", select=final(_SUMS, "o")))
def a2(spark, sf):
    return _sums(read_edf(spark, recordings(spark, sf), kind="marker"))


@check("a3_edf_header", S.query(S.supplier_days(), "o AS (SELECT recording_id, 1.0 AS sfreq, '2024-05-06 07:08:09' AS start, 2500 AS n_samples, 2500.0 AS duration_s, count(DISTINCT channel) + 1 AS n_channels FROM s GROUP BY ALL)",
                                select=final("recording_id sfreq: start n_samples# duration_s: n_channels#", "o")))
def a3(spark, sf):
    head = read_edf(spark, recordings(spark, sf), "header")
    return shape(head.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "recording_id sfreq: start n_samples# duration_s: n_channels#")


@check("a4_edf_annotations", S.query(S.supplier_days(), MARKED, select=final("recording_id onset: description", "nt")))
def a4(spark, sf):
    return shape(read_edf(spark, recordings(spark, sf), "annotations"), "recording_id onset: description")


@check("a5_pushed_range", S.query(S.supplier_days(), f"c AS (SELECT * FROM s WHERE i >= 512 AND i < 777 AND channel <> 'L1' AND recording_id IN ('1', '3', '7')), o AS ({_SUMS_SQL.format('c')})", select=final(_SUMS, "o")))
def a5_range(spark, sf):
    """Recordings become files, the overlap with a range runs of records; what is read beyond the range is cut off."""
    near = read_edf(spark, recordings(spark, sf), read_bytes=1 << 13).where("recording_id IN ('1', '3', '7') AND i0 < 777 AND i1 > 512 AND channel <> 'L1'")
    return _sums(crop_places(near.drop("i1"), 512, 777))


@check("a8_edf_channels", S.query(S.supplier_days(), """
o AS (SELECT DISTINCT recording_id, channel, ch_index, 'signal' AS kind, 'V' AS unit FROM s UNION ALL SELECT DISTINCT recording_id, 'MKR1+', NULL, 'marker', 'V' FROM s),
p AS (SELECT recording_id, channel, kind, unit, row_number() OVER (PARTITION BY recording_id ORDER BY ch_index NULLS LAST) - 1 AS ch_index FROM o)""", select=final(f"{K} kind unit", "p")))
def a8(spark, sf):
    return shape(read_edf(spark, recordings(spark, sf), "channels"), f"{K} kind unit")
