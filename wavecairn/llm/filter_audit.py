"""Audit of filters and their interactions, by an incremental streaming query with retractions.

The documents' files are a stream of micro-batches. A document's mask has a bit for each filter it fails. The
masks of A to D follow from its text. For E, keyed state holds the least doc_id of every text seen so far and
the rows that have it; when a smaller one arrives, their former masks are retracted and masks with E put in
their place. What the query writes are changes (doc_id, part, mask, change); their sums are the counters.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavecairn.llm.common import WORD, map_rows
from wavecairn.session import cut_lineage, shared_folder

FILTERS = "ABCDE"
SHARED = 1 << FILTERS.index("E")
#: State of a bucket of texts, row by row: hashes of the text, its least doc_id, and for each part how many rows have both.
STATE = "h1 array<bigint>, h2 array<bigint>, doc_id array<bigint>, part array<string>, mask array<int>, change array<bigint>"
HELD = ["h1", "h2", "doc_id", "part", "mask", "change"]
CHANGE = "doc_id bigint, part string, mask int, change bigint"
#: Rows that need no state are dealt to so many keys below zero.
BYPASS = 512


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0)).cast("int")


def _routed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows to the bucket of their text; those that a smaller doc_id of the same batch beats pass by.

    Such a row has its final mask and needs no state, nor does one without doc_id. Of a text that very many
    documents share, a batch so sends few rows to the bucket.
    """
    for batch in batches:
        t = batch.to_pandas(integer_object_nulls=False, types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        least = t.groupby(["h1", "h2"])["doc_id"].transform("min")
        beaten = (t["doc_id"] > least).fillna(False).to_numpy(dtype=bool)
        by = beaten | t["doc_id"].isna().to_numpy(dtype=bool)
        t["mask"] = t["mask"] | np.where(beaten, SHARED, 0)
        t["key"] = np.where(by, -1 - np.arange(len(t)) % BYPASS, t["h1"].to_numpy(dtype=np.int64) % buckets)
        yield pa.RecordBatch.from_pandas(t[_ROUTED.names], schema=_ROUTED, preserve_index=False)


_ROUTED = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())])


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All rows of a bucket as changes; rows of the state that a smaller doc_id beats now are retracted."""
    if key[0] < 0:
        for frame in frames:
            yield frame[["doc_id", "part", "mask"]].astype({"doc_id": "Int64"}).assign(change=np.int64(1))
        return
    new = pd.concat(list(frames), ignore_index=True).assign(change=np.int64(1), old=False)
    old = pd.DataFrame(dict(zip(HELD, state.get)) if state.exists else {c: [] for c in HELD}).assign(old=True)
    kinds = {"h1": "int64", "h2": "int64", "doc_id": "int64", "mask": "int32", "change": "int64", "old": bool}
    rows = pd.concat([old[[*HELD, "old"]].astype(kinds), new[[*HELD, "old"]].astype(kinds)], ignore_index=True)
    beaten = rows["doc_id"] > rows.groupby(["h1", "h2"])["doc_id"].transform("min")
    shared = rows.assign(mask=rows["mask"] | SHARED)
    given, gone = ~rows["old"], rows["old"] & beaten
    out = pd.concat([rows[given & ~beaten], shared[given & beaten], rows[gone].assign(change=-rows["change"][gone]), shared[gone]])
    held = rows[~beaten].groupby(["h1", "h2", "doc_id", "part", "mask"], as_index=False)["change"].sum()
    state.update(tuple(held[c].tolist() for c in HELD))
    yield out[["doc_id", "part", "mask", "change"]].astype({"doc_id": "Int64"})


def stream_changes(spark: SparkSession, path: str, folder: str, batches: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """Changes (doc_id, part, mask, change) of all files at ``path``, in about ``batches`` micro-batches.

    Texts are keyed by their hash, in buckets of about ``bucket_rows`` rows of the whole input, so that one call
    handles many texts and none grows with the input. Checkpoint, state and output lie in ``folder``, which all
    executors share: a stopped query goes on there. The session chooses the state store.
    """
    given = spark.read.parquet(path)
    files = given.inputFiles()
    reader = spark.readStream.schema(given.select("doc_id", "text", "source").schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
    parent, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a stream reads folders
        source = reader.option("pathGlobFilter", name).parquet(parent)
    else:
        source = reader.parquet(path)
    text = F.coalesce("text", F.lit(""))
    masks = source.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    buckets = max(1, math.ceil(given.count() / bucket_rows))
    routed = masks.mapInArrow(lambda b: _routed(b, buckets), "key bigint, h1 bigint, h2 bigint, doc_id bigint, part string, mask int")
    changes = routed.groupBy("key").applyInPandasWithState(_changes, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)
    query = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(CHANGE).parquet(f"{folder}/changes")


def counters(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows of each mask, and how many of them are labelled quality 1 and toxic 1."""
    net = changes.groupBy("doc_id", "part", "mask").agg(F.sum("change").alias("n")).where("n <> 0")
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("bigint"), F.lit(0))).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("d")).agg(flag("quality"), flag("toxic"))
    weighed = net.join(marks, F.col("doc_id") == F.col("d"), "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias({"quality": "good"}.get(c, c))
    return weighed.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality"), total("toxic"))


REPORT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def report(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; a part is a row of 32 numbers until then."""
    cells = counts.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(1 << len(FILTERS))]).alias(c) for c in ("n", "good", "toxic")])
    orders = [list(p) for p in permutations(range(len(FILTERS)))]
    masks = np.arange(1 << len(FILTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, good, toxic = (np.array(row[c], dtype=np.int64) for c in ("n", "good", "toxic"))
                rows, shapley = [], dict.fromkeys(range(len(FILTERS)), 0)
                for order in orders:
                    before = 0
                    for step, f in enumerate(order):
                        bit = 1 << f
                        fails, gone = masks & bit > 0, masks & before > 0
                        here = fails & ~gone
                        shapley[f] += int(n[here].sum())
                        rows.append(["".join(FILTERS[k] for k in order), step + 1, f, *[int(x) for x in (
                            n[~fails & ~gone].sum(), n[here].sum(), n[fails & gone].sum(), n[masks == bit].sum(), good[here].sum(), toxic[here].sum())]])
                        before |= bit
                yield pa.RecordBatch.from_pydict({
                    "part": [row["part"]] * len(rows), "filter_order": [r[0] for r in rows], "step": pa.array([r[1] for r in rows], pa.int32()),
                    **{c: [r[k] for r in rows] for k, c in enumerate(REPORT[:-1], 3)}, "shapley": [shapley[r[2]] for r in rows]})

    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in REPORT))


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = 3) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``path`` holds Parquet files with doc_id, text and source; other columns are not read. Filters fail a text
    with under 200 words (A), fewer than half of them distinct (B), more than 2 % capitals (C), one of
    ``#$%&*|`` (D), or equal to the text of a smaller doc_id (E). A null text is empty, a null source the part
    "". A null doc_id is not smaller than any and has no smaller one; rows that repeat a doc_id and text count
    as often as they stand there. Several labels of a doc_id count as one: good or toxic if any of them is.
    No rows give no parts.
    """
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    return report(cut_lineage(counters(stream_changes(spark, path, folder, batches), labels)))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
counted AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY text) AS smallest
  FROM docs),
marks AS (
  SELECT doc_id AS d, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * capitals > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > smallest THEN 16 ELSE 0 END AS mask
  FROM counted LEFT JOIN marks ON doc_id = d),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
filters(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
grown(filter_order, used, step, before, bit) AS (
  SELECT '', 0, 0, 0, 0
  UNION ALL
  SELECT filter_order || f, used | b, step + 1, used, b FROM grown, filters WHERE used & b = 0),
orders AS (SELECT filter_order FROM grown WHERE step = 5),
steps AS (SELECT o.filter_order, g.step, g.before, g.bit FROM orders o JOIN grown g ON g.step > 0 AND starts_with(o.filter_order, g.filter_order)),
found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
