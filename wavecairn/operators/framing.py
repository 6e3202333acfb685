"""Window grids: samples to windows (native) and samples to packed blocks (for array kernels)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHANNEL = ["recording_id", "channel", "ch_index"]
#: Rows that a kernel's task holds before it hands them on.
OUTPUT_ROWS = 100_000


def assign_windows(samples: DataFrame, window: int, step: int, n_samples: Column) -> DataFrame:
    """One row per sample and complete window ``w`` that holds it; ``w`` starts at sample w*step."""
    first = F.greatest(F.lit(0), F.floor((F.col("i") - window + step) / step))
    last = F.least(F.floor(F.col("i") / step), F.floor((n_samples - window) / step))
    return (
        samples.withColumn("_first", first.cast("bigint"))
        .withColumn("_last", last.cast("bigint"))
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("w", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def tumbling(samples: DataFrame, window: int, n_samples: Column) -> DataFrame:
    """Non-overlapping complete windows: no row is repeated."""
    return samples.withColumn("w", F.floor(F.col("i") / window).cast("bigint")).where(
        (F.col("w") + 1) * window <= n_samples
    )


def block_length(window: int, step: int, target: int = 8192) -> int:
    """Block size in samples: a multiple of the step, at least one window, near ``target``."""
    return step * max(-(-window // step), target // step, 1)


def is_packed(samples: DataFrame) -> bool:
    """Arrays ``v`` from sample ``i0`` on (as the sources give them), not single samples ``i``, ``v``."""
    return "i0" in samples.columns


def is_whole(samples: DataFrame) -> bool:
    """Arrays that each hold a whole channel. The adapter says so in the metadata of ``i0``; a computed ``i0`` loses it."""
    return is_packed(samples) and bool(samples.schema["i0"].metadata.get("whole"))


def whole(i0: Column) -> Column:
    return i0.alias("i0", metadata={"whole": True})


def in_parts(samples: DataFrame) -> DataFrame:
    """The same arrays without the word that each is a whole channel, as before a union with parts of channels."""
    return samples.withColumn("i0", F.col("i0").alias("i0", metadata={"whole": False})) if is_whole(samples) else samples


def spans(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First and last sample of every channel (lo, hi); arrays are measured, not opened."""
    keys = keys or CHANNEL
    last = F.col("i0") + F.size("v") - 1 if is_packed(samples) else F.col("i")
    return samples.groupBy(*keys).agg(F.min("i0" if is_packed(samples) else "i").alias("lo"), F.max(last).alias("hi"))


def _routed(samples: DataFrame, block: int, before: int, after: int, keys: list[str]) -> DataFrame:
    """Samples or slices of arrays, sent to every block that owns them or has them in its halo: keys, block, at, part."""
    own = F.floor(F.col("i") / block)
    if is_packed(samples):
        end = F.col("i0") + F.size("v")
        low, high = F.greatest(F.lit(0), F.floor((F.col("i0") - after) / block)), F.floor((end - 1 + before) / block)
        sent = samples.where(F.size("v") > 0).select(*keys, "i0", "v", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))).alias("block"))
        at = F.greatest(F.col("i0"), F.col("block") * block - before)
        stop = F.least(F.col("i0") + F.size("v"), (F.col("block") + 1) * block + after)
        part = F.slice("v", (at - F.col("i0") + 1).cast("int"), (stop - at).cast("int"))
        return _dealt(sent.where(stop > at).select(*keys, "block", at.alias("at"), part.alias("part")), keys)
    offset = F.col("i") - own * block
    first = F.when((offset < after) & (own > 0), own - 1).otherwise(own) if after else own
    last = F.when(offset >= block - before, own + 1).otherwise(own) if before else own
    home = F.explode(F.sequence(first, last)) if before or after else own
    return _dealt(samples.select(*keys, home.alias("block"), F.col("i").alias("at"), F.col("v").alias("part")), keys)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One exchange by channel and block. A channel is never null; said here, no join infers it on one side only."""
    for k in [*keys, "block"]:
        rows = rows.where(F.col(k).isNotNull())
    return rows.repartition(*keys, "block")


def _cut(samples: DataFrame, block: int, before: int, after: int, keys: list[str]) -> DataFrame:
    """Blocks of arrays that each hold a whole channel: cut in place, nothing is shuffled."""
    end = F.col("i0") + F.size("v")

    def part(b: Column) -> Column:
        first = F.greatest(F.col("i0"), b * block - before)
        last = F.least(end, (b + 1) * block + after)
        values = F.slice("v", (first - F.col("i0") + 1).cast("int"), (last - first).cast("int"))
        return F.struct(b.alias("block"), first.alias("i0"), (b * block).alias("own0"), values.alias("v"))

    known = samples.where(F.size("v") > 0)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    blocks = F.sequence(F.floor(F.col("i0") / block).cast("bigint"), F.floor((end - 1) / block).cast("bigint"))
    return known.select(*keys, F.explode(F.transform(blocks, part)).alias("_b")).select(*keys, "_b.block", "_b.i0", "_b.own0", "_b.v")


def pack_blocks(
    samples: DataFrame, block: int, before: int = 0, after: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """Arrays of consecutive samples per channel: ``block`` own samples plus a halo on either side.

    ``samples`` are single samples (i, v) or arrays (i0, v), which are cut at the borders and sent as slices: no
    sample becomes a row. One shuffle by (channel, block): only halo samples are sent twice, and a group never
    holds more than block + before + after samples, however long the recording is. The directory of blocks, from
    the first to the last sample of each channel, is read off the same shuffle. A block that it names exists
    even if no sample fell into it, and absent samples are missing values: a gap in the rows gives the same
    arrays as missing values in its place.
    Returns keys, block, i0 (index of the first element), own0 (first own sample) and v. ``i0`` is after
    ``own0`` where a recording (or what is left of it after a crop) begins inside the block.
    """
    if max(before, after) > block:
        raise ValueError("the halo must not be longer than a block")
    keys = keys or CHANNEL
    if is_whole(samples):
        return _cut(samples, block, before, after, keys)
    routed = _routed(samples, block, before, after, keys)
    sliced = is_packed(samples)
    kind = samples.schema["v"].dataType.elementType if sliced else samples.schema["v"].dataType
    # Rows are shuffled as they are and collected once; a map-side collect would not shrink them.
    packed = routed.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_parts"))
    # Both sides name the same columns of the same exchange, so Spark runs it once.
    if sliced:
        known = routed.groupBy(*keys).agg(F.min("at").alias("_lo"), F.max(F.col("at") + F.size("part") - 1).alias("_hi"))
    else:
        known = routed.groupBy(*keys).agg(F.min(F.struct("at", "part"))["at"].alias("_lo"), F.max(F.struct("at", "part"))["at"].alias("_hi"))
    blocks = known.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor(F.col("_hi") / block))).alias("block"))
    placed = packed.join(blocks, [*keys, "block"], "right")
    first = F.greatest(F.col("_lo"), F.col("block") * block - before)
    last = F.least(F.col("_hi"), (F.col("block") + 1) * block - 1 + after)
    missing = F.lit(None).cast(kind)
    parts = F.coalesce("_parts", F.array().cast(packed.schema["_parts"].dataType))
    if sliced:
        # What is missing before each slice, and the slice: arrays of arrays, so no value is taken out of its array.
        last_end = lambda k: F.coalesce(F.get("_parts", k - 1)["at"] + F.size(F.get("_parts", k - 1)["part"]), F.col("i0"))
        pieces = F.transform("_parts", lambda p, k: F.array(F.array_repeat(missing, (p["at"] - last_end(k)).cast("int")), p["part"]))
        whole = F.flatten(F.flatten(pieces))
        values = F.concat("_v", F.array_repeat(missing, F.col("_n") - F.size("_v")))
        filled = placed.select(*keys, "block", first.alias("i0"), (last - first + 1).cast("int").alias("_n"), parts.alias("_parts"))
        return filled.withColumn("_v", whole).select(*keys, "block", "i0", (F.col("block") * block).alias("own0"), values.alias("v"))
    absent = F.array_except(F.sequence(first, last), F.col("_parts")["at"])
    full = F.sort_array(F.concat("_parts", F.transform(absent, lambda k: F.struct(k.alias("at"), missing.alias("part")))))
    whole = F.when(F.size("_parts") == last - first + 1, F.col("_parts")).otherwise(full)
    return placed.withColumn("_parts", parts).select(*keys, "block", first.alias("i0"), (F.col("block") * block).alias("own0"), whole["part"].alias("v"))


def per_block(
    blocks: DataFrame,
    kernel: Callable[[np.ndarray, dict], dict[str, np.ndarray]],
    outputs: list[tuple[str, T.DataType]],
    keys: list[str] | None = None,
    nested: bool = False,
) -> DataFrame:
    """Run a vectorised kernel on the array ``v`` of every row; it returns equally long columns.

    The kernel gets the samples (missing as NaN) and the other columns of the row as a dict; ``known`` in it tells
    which samples are not NULL, where any is. Masked elements of its columns become NULL. With ``nested`` its
    columns stay arrays, one row for a block, whose ``outputs`` are the types of their elements.
    """
    keys = keys or CHANNEL
    fields = [T.StructField(n, T.ArrayType(t) if nested else t) for n, t in outputs]
    schema = T.StructType([blocks.schema[k] for k in keys] + fields)
    arrow = to_arrow_schema(schema)
    names = [n for n, _ in outputs]

    def whole(results: list[dict], name: str) -> np.ndarray:
        parts = [r[name] for r in results]
        return (np.ma if any(isinstance(p, np.ma.MaskedArray) for p in parts) else np).concatenate(parts)

    def batch_of(batch: pa.RecordBatch, results: list[dict], rows: list[int], counts: list[int]) -> pa.RecordBatch:
        take = pa.array(rows if nested else np.repeat(rows, counts))
        columns = [batch.column(batch.schema.get_field_index(k)).take(take) for k in keys]
        for name in names:
            parts = whole(results, name)
            field = arrow.field(name).type
            if nested:
                offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(parts).cast(field.value_type)))
            elif parts.ndim == 2:
                offs = np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(parts.ravel())).cast(field))
            else:
                columns.append(pa.array(parts).cast(field))
        columns = [c.cast(arrow.field(k).type) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            known = column.values.is_valid().to_numpy(zero_copy_only=False) if column.values.null_count else None
            offsets = column.offsets.to_numpy()
            extras = {f: batch.column(k).to_pylist() for k, f in enumerate(batch.schema.names) if f != "v"}
            results, rows, counts, held = [], [], [], 0
            for r in range(batch.num_rows):
                row = {f: values[r] for f, values in extras.items()}
                span = slice(offsets[r], offsets[r + 1])
                row["known"] = None if known is None else known[span]
                result = kernel(flat[span], row)
                count = len(result[names[0]])
                if count:
                    results.append(result)
                    rows.append(r)
                    counts.append(count)
                    held += count
                if held >= OUTPUT_ROWS:
                    yield batch_of(batch, results, rows, counts)
                    results, rows, counts, held = [], [], [], 0
            if results:
                yield batch_of(batch, results, rows, counts)

    return blocks.mapInArrow(run, schema)


def crop(samples: DataFrame, sfreq: float, tmin: float = 0.0, tmax: float | None = None) -> DataFrame:
    """Samples (or arrays of them) with tmin <= t <= tmax; a limit past the end keeps everything."""
    if is_packed(samples):
        return crop_places(samples, math.ceil(tmin * sfreq), None if tmax is None else math.floor(tmax * sfreq) + 1)
    out = samples.where(F.col("i") >= math.ceil(tmin * sfreq))
    return out if tmax is None else out.where(F.col("i") <= math.floor(tmax * sfreq))


def crop_places(samples: DataFrame, begin: int, end: int | None = None) -> DataFrame:
    """Arrays of the places ``begin`` to ``end`` - 1; whole channels are whole channels of what is left."""
    low, high = F.greatest(F.col("i0"), F.lit(begin).cast("bigint")), F.col("i0") + F.size("v")
    high = high if end is None else F.least(high, F.lit(end).cast("bigint"))
    part = F.slice("v", (low - F.col("i0") + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int"))
    cut = samples.withColumns({"v": part, "i0": low}).where(F.size("v") > 0)
    return cut.withColumn("i0", whole(F.col("i0"))) if is_whole(samples) else cut


def without_places(samples: DataFrame, begin: int, end: int) -> DataFrame:
    """Arrays without the places ``begin`` to ``end`` - 1: up to two parts of each, out of one pass."""
    stop = F.col("i0") + F.size("v")

    def part(low: Column, high: Column) -> Column:
        values = F.slice("v", (low - F.col("i0") + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int"))
        return F.struct(low.alias("i0"), values.alias("v"))

    parts = F.array(part(F.col("i0"), F.least(stop, F.lit(begin).cast("bigint"))), part(F.greatest(F.col("i0"), F.lit(end).cast("bigint")), stop))
    rest = [c for c in samples.columns if c not in ("i0", "v")]
    cut = samples.select(*rest, F.explode(parts).alias("_p")).select(*rest, F.col("_p.i0").alias("i0", metadata={"whole": False}), F.col("_p.v").alias("v"))
    return cut.where(F.size("v") > 0)


def in_intervals(rows: DataFrame, at: Column, intervals: list[tuple[str, float, float]]) -> DataFrame:
    """One row per half-open interval [lo, hi) that holds ``at``; its name is in ``phase``.

    The intervals are parameters, so membership is one expression and needs no join.
    """
    hits = F.array(*[F.when((at >= lo) & (at < hi), F.lit(name)) for name, lo, hi in intervals])
    return rows.withColumn("phase", F.explode(F.array_compact(hits)))


def unpack_blocks(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Packed blocks without halo back to one row per sample."""
    keys = keys or CHANNEL
    return blocks.select(*keys, "i0", F.posexplode("v").alias("_k", "v")).select(
        *keys, (F.col("i0") + F.col("_k")).alias("i"), "v"
    )
