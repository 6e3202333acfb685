"""Exact medians on groups of any size, robust z scores, consensus means and thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavecairn.functions.arrays import sorted_median
from wavecairn.session import cut_lineage

# A group of more rows than this gets its exact median by rank selection in the counts of its values, in repeated
# narrowing; where all groups are smaller, they are aggregated in one piece.
SMALL_GROUP_ROWS = 500_000
_PIVOTS = 64


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows in the biggest group: one counting job with map-side combine, one number returned."""
    row = df.groupBy(*by).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def _split_by_size(df: DataFrame, by: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups of at most ``limit`` rows, and rows of the larger groups, from one written table."""
    written = cut_lineage(df)
    large = cut_lineage(written.groupBy(*by).count().where(F.col("count") > limit).select(*by))
    return written.join(large, by, "left_anti"), written.join(large, by, "left_semi")


def group_medians(
    df: DataFrame,
    by: list[str],
    columns: list[str],
    max_group_rows: int | None = None,
    extra: list[Column] | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated medians per group, NULLs skipped; ``extra`` are further aggregates.

    ``max_group_rows`` is the caller's bound (known from recording lengths); when it is absent the
    groups are counted. Groups of at most ``small_rows`` use the built-in median; a larger group is
    never gathered in one task, whatever the others do.
    """
    limit = SMALL_GROUP_ROWS if small_rows is None else small_rows
    if max_group_rows is None:
        max_group_rows = largest_group(df, by)
    if max_group_rows <= limit:
        return _built_in_medians(df, by, columns, extra)
    short, long = _split_by_size(df, by, limit)
    medians = _selected_medians(long, by, columns, limit)
    if extra:
        medians = long.groupBy(*by).agg(*extra).join(medians, by, "left")
    return _built_in_medians(short, by, columns, extra).unionByName(medians)


def _built_in_medians(df: DataFrame, by: list[str], columns: list[str], extra: list[Column] | None) -> DataFrame:
    return df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns], *(extra or []))


def _value_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """_g (the group, null or not), _c (column), _x, k: how often each value stands in a group; rows are read and summed once."""
    group, value = F.struct(*by).alias("_g"), lambda c: F.col(c).cast("double")
    if len(columns) == 1:
        long = df.select(group, F.lit(columns[0]).alias("_c"), value(columns[0]).alias("_x"))
    else:
        long = df.select(group, F.explode(F.create_map(*[p for c in columns for p in (F.lit(c), value(c))])).alias("_c", "_x"))
    return cut_lineage(long.groupBy("_g", "_c", "_x").agg(F.count(F.lit(1)).alias("k")))


def _selected_medians(df: DataFrame, by: list[str], columns: list[str], limit: int) -> DataFrame:
    """Exact medians of groups that no task gathers, out of the counts of their values."""
    counts = _value_counts(df, by, columns)
    return _in_columns(counts, _medians_of_counts(counts, limit), columns, {"median": "{}"})


def _in_columns(counts: DataFrame, found: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    """A row for each group, with the numbers of its columns beside each other; a group of NULLs has none."""
    cells = [F.max(F.when(F.col("_c") == c, F.col(n))).alias(name.format(c)) for c in columns for n, name in names.items()]
    wide = counts.select("_g").distinct().join(found.groupBy("_g").agg(*cells), "_g", "left")
    return wide.select("_g.*", *[name.format(c) for c in columns for name in names.values()])


def _medians_of_counts(counts: DataFrame, limit: int) -> DataFrame:
    """_g, _c, median: rank selection in (_g, _c, _x, k), NULLs skipped. A group of more than ``limit`` values is cut by pivots, the counts
    between them say where the middle ranks lie, and it narrows until few values are left."""
    keys, counts = ["_g", "_c"], counts.where("_x IS NOT NULL")
    state = cut_lineage(counts.groupBy(*keys).agg(
        F.sum("k").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("distinct")).withColumn("below", F.lit(0).cast("bigint")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    while True:
        open_groups = state.where(F.col("distinct") > limit)
        if open_groups.isEmpty():
            break
        inside = counts.join(open_groups, keys).where(F.col("_x").between(F.col("lo"), F.col("hi")))
        pivots = inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_x", [k / _PIVOTS for k in range(1, _PIVOTS)], 20 * _PIVOTS)).alias("p"))
        # Each pivot is a part of its own, as is what lies between two: parts with values get fewer, whatever the values are.
        under = F.size(F.filter("p", lambda v: v < F.col("_x")))
        part = under * 2 + F.array_contains("p", F.col("_x")).cast("int")
        parts = inside.join(pivots, keys).groupBy(*keys, "n", "below", part.alias("part")).agg(
            F.sum("k").alias("k"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("distinct"))
        upto = F.col("below") + F.sum("k").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        middle = parts.withColumn("upto", upto).where((F.col("upto") > low) & (F.col("upto") - F.col("k") <= high))
        narrowed = middle.groupBy(*keys, "n").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("distinct").alias("distinct"), F.min(F.col("upto") - F.col("k")).alias("below"))
        kept = state.where(F.col("distinct") <= limit)
        state, former = cut_lineage(kept.unionByName(narrowed.select(*state.columns))), state
        if not state.join(former.select(*keys, F.col("distinct").alias("_d")), keys).where(F.col("_d") > limit).where(F.col("distinct") < F.col("_d")).limit(1).count():
            break  # a handful of values is above a limit below it
    values = counts.join(state, keys).where(F.col("_x").between(F.col("lo"), F.col("hi")))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    picked = values.withColumn("upto", upto).groupBy(*keys).agg(
        F.min(F.when(F.col("upto") > low, F.col("_x"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("_x"))).alias("b"))
    return picked.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) / 2).alias("median"))


def scale_of(mad: Column, std: Column, eps: float, fallback: str) -> Column:
    """``mad`` is already multiplied by 1.4826; fallback: unit, floor, plus or largest."""
    if fallback == "largest":
        return F.greatest(mad, std, F.lit(eps))
    last = {
        "unit": F.when(std > eps, std).otherwise(1.0),
        "floor": F.greatest(std, F.lit(eps)),
        "plus": std + F.lit(eps),
    }[fallback]
    return F.when(mad > eps, mad).otherwise(last)


def robust_stats(
    df: DataFrame,
    by: list[str],
    columns: list[str],
    baseline: Column | None = None,
    eps: float = 1e-12,
    fallback: str = "unit",
    max_group_rows: int | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Per group: ``<c>_center`` and ``<c>_scale`` from the baseline rows (all rows by default)."""
    base = df if baseline is None else df.where(baseline)
    base = base.select(*by, *columns)
    limit = SMALL_GROUP_ROWS if small_rows is None else small_rows
    if max_group_rows is None:
        max_group_rows = largest_group(base, by)
    if max_group_rows <= limit:
        return _collected_stats(base, by, columns, eps, fallback)
    return _selected_stats(base, by, columns, eps, fallback, limit)


def _selected_stats(base: DataFrame, by: list[str], columns: list[str], eps: float, fallback: str, limit: int) -> DataFrame:
    """Groups of any size: rank selection for the median, then for the distances from it, both out of the counts of values."""
    keys, counts = ["_g", "_c"], _value_counts(base, by, columns)
    centred = counts.join(cut_lineage(_medians_of_counts(counts, limit)), keys).withColumn("off", F.col("_x") - F.col("median"))
    # Moments of the distances from the median: those of a constant group are 0 exactly.
    mean = centred.groupBy(*keys, "median").agg((F.sum(F.col("off") * F.col("k")) / F.sum("k")).alias("mean"))
    away = F.col("off") - F.col("mean")
    std = centred.drop("median").join(mean, keys).groupBy(*keys, "median").agg(F.sqrt(F.sum(away * away * F.col("k")) / F.sum("k")).alias("std"))
    distances = cut_lineage(centred.groupBy(*keys, F.abs("off").alias("_x")).agg(F.sum("k").alias("k")))
    mad = _medians_of_counts(distances, limit).withColumnRenamed("median", "mad")
    flat = _in_columns(counts, std.join(mad, keys), columns, {"median": "{}_center", "std": "_{}_std", "mad": "_{}_mad"})
    scales = [scale_of(F.lit(1.4826) * F.col(f"_{c}_mad"), F.col(f"_{c}_std"), eps, fallback).alias(f"{c}_scale") for c in columns]
    return flat.select(*by, *[f"{c}_center" for c in columns], *scales)


def _distance_to(center: Column):
    return lambda x: F.abs(x - center)


def _collected_stats(base: DataFrame, by: list[str], columns: list[str], eps: float, fallback: str) -> DataFrame:
    """Groups of checked size: one shuffle, one aggregate; both medians come from the sorted values."""
    gathered = base.repartition(*by).groupBy(*by).agg(
        *[F.sort_array(F.collect_list(c)).alias(f"_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )
    centred = gathered.select(*by, *[f"_{c}" for c in columns], *[f"{c}_std" for c in columns],
                              *[sorted_median(F.col(f"_{c}")).alias(f"{c}_center") for c in columns])
    spread = centred.select(
        *by, *[f"{c}_{s}" for c in columns for s in ("std", "center")],
        *[F.sort_array(F.transform(f"_{c}", _distance_to(F.col(f"{c}_center")))).alias(f"_{c}") for c in columns],
    )
    return spread.select(
        *by, *[f"{c}_center" for c in columns],
        *[scale_of(F.lit(1.4826) * sorted_median(F.col(f"_{c}")), F.col(f"{c}_std"), eps, fallback).alias(f"{c}_scale")
          for c in columns],
    )


def robust_z(
    df: DataFrame,
    by: list[str],
    columns: list[str],
    baseline: Column | None = None,
    two_sided: bool | set[str] = False,
    clip: tuple[float, float] | None = (0.0, 25.0),
    eps: float = 1e-12,
    fallback: str = "unit",
    missing: float | None = None,
    max_group_rows: int | None = None,
    small_rows: int | None = None,
    suffix: str = "_z",
) -> DataFrame:
    """Add ``<c>_z``: (x - median) / scale per group, optionally absolute (all or the named
    columns), clipped, NULL-filled."""
    stats = robust_stats(df, by, columns, baseline, eps, fallback, max_group_rows, small_rows)

    def z(c: str) -> Column:
        score = (F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale")
        score = F.abs(score) if two_sided is True or (two_sided and c in two_sided) else score
        if missing is not None:
            score = F.coalesce(F.nanvl(score, F.lit(missing)), F.lit(missing))
        return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), score)) if clip else score

    joined = df.join(stats, by)
    return joined.select(*df.columns, *[z(c).alias(f"{c}{suffix}") for c in columns])


def _middle(ordered: np.ndarray) -> float:
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if n else np.nan


def _z_of(x: np.ndarray, base: np.ndarray, clip: tuple[float, float] | None, eps: float, fallback: str) -> np.ndarray:
    """``robust_z`` of one group in Spark's order of numbers: NaN is the largest, and sorts last."""
    center = _middle(np.sort(base))
    mad = 1.4826 * _middle(np.sort(np.abs(base - center)))
    std = base.std() if len(base) else np.nan
    above = lambda a: not a <= eps
    last = {"unit": std if above(std) else 1.0, "floor": np.maximum(std, eps), "plus": std + eps}
    scale = np.maximum(np.maximum(mad, std), eps) if fallback == "largest" else mad if above(mad) else last[fallback]
    score = (x - center) / scale
    return np.maximum(clip[0], np.fmin(clip[1], score)) if clip else score


def nested_z(df: DataFrame, columns: list[str], baseline: str | None = None, clip: tuple[float, float] | None = (0.0, 25.0), eps: float = 1e-12, fallback: str = "unit", suffix: str = "_z") -> DataFrame:
    """``robust_z`` where a row holds a whole group as arrays ``columns``: adds ``<c>_z`` arrays, nothing is shuffled.

    ``baseline`` names an array of booleans. NULL elements count in no statistic.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}{suffix}", T.ArrayType(T.DoubleType())) for c in columns]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        with np.errstate(all="ignore"):
            for batch in batches:
                lists = lambda name: batch.column(batch.schema.get_field_index(name))
                added = []
                for c in columns:
                    held = lists(c)
                    values = held.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
                    counted = held.values.is_valid().to_numpy(zero_copy_only=False)
                    if baseline is not None:
                        counted = counted & lists(baseline).values.to_numpy(zero_copy_only=False).astype(bool)
                    offs, out = held.offsets.to_numpy(), np.empty(len(values))
                    for a, b in zip(offs[:-1], offs[1:]):
                        out[a:b] = _z_of(values[a:b], values[a:b][counted[a:b]], clip, eps, fallback)
                    added.append(pa.ListArray.from_arrays(held.offsets, pa.array(out)))
                arrays = [*batch.columns, *added]
                yield pa.RecordBatch.from_arrays([x.cast(arrow.field(k).type) for k, x in enumerate(arrays)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Windows of one group of ``nested_consensus``.
CHUNK = 512


def nested_consensus(scores: DataFrame, fraction: float, column: str = "score") -> DataFrame:
    """``channel_consensus`` by recording and window of rows with arrays ``w`` (consecutive numbers) and ``column``.

    Slices of up to ``CHUNK`` windows are shuffled, one for each channel; a group holds them for the channels of one recording.
    """
    first = F.element_at("w", 1)
    chunks = F.sequence(F.floor(first / CHUNK), F.floor(F.element_at("w", -1) / CHUNK))

    def part(k: Column) -> Column:
        low = F.greatest(first, k * CHUNK)
        high = F.least(F.element_at("w", -1) + 1, (k + 1) * CHUNK)
        return F.struct(k.alias("chunk"), low.alias("low"), F.slice(column, (low - first + 1).cast("int"), (high - low).cast("int")).alias("x"))

    sent = scores.where(F.size("w") > 0).select("recording_id", F.explode(F.transform(chunks, part)).alias("p"))
    held = sent.select("recording_id", "p.*").where(F.col("recording_id").isNotNull()).groupBy("recording_id", "chunk").agg(F.collect_list(F.struct("low", "x")).alias("m"))
    schema = T.StructType([T.StructField("recording_id", T.StringType()), T.StructField("w", T.LongType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            chunk = batch.column(batch.schema.get_field_index("chunk")).to_numpy(zero_copy_only=False)
            slices = batch.column(batch.schema.get_field_index("m"))
            rows, low, x = slices.offsets.to_numpy(), slices.values.field("low").to_numpy(), slices.values.field("x")
            values, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            which, windows, means = [], [], []
            for k in range(batch.num_rows):
                a, b = rows[k], rows[k + 1]
                matrix, there = np.full((b - a, CHUNK), -np.inf), np.zeros((b - a, CHUNK), bool)
                for r in range(a, b):
                    span = slice(low[r] - chunk[k] * CHUNK, low[r] - chunk[k] * CHUNK + at[r + 1] - at[r])
                    matrix[r - a, span], there[r - a, span] = values[at[r] : at[r + 1]], True
                n = there.sum(axis=0)
                used = np.flatnonzero(n)
                # Largest first; NaN is the largest.
                ranked = -np.sort(np.where(np.isnan(matrix), -np.inf, -matrix), axis=0)[:, used]
                nan = np.isnan(matrix)[:, used].any(axis=0)
                keep = np.minimum(n[used], np.maximum(1.0, np.ceil(n[used] * float(fraction))))
                taken = np.arange(b - a)[:, None] < keep
                mean = np.where(taken, ranked, 0.0).sum(axis=0) / keep
                which.append(np.full(len(used), k))
                windows.append(chunk[k] * CHUNK + used)
                means.append(np.where(nan, np.nan, mean))
            ids = batch.column(batch.schema.get_field_index("recording_id")).take(pa.array(np.concatenate(which)))
            columns = [ids, pa.array(np.concatenate(windows)), pa.array(np.concatenate(means))]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(k).type) for k, c in enumerate(columns)], schema=arrow)

    return held.mapInArrow(run, schema)


def channel_consensus(scores: DataFrame, fraction: float, by: list[str] | None = None, column: str = "score") -> DataFrame:
    """Mean of the max(1, ceil(n * fraction)) highest channel scores of every window."""
    by = by or ["recording_id", "w"]
    spec = Window.partitionBy(*by)
    ranked = scores.select(
        *by, column,
        F.row_number().over(spec.orderBy(F.desc(column))).alias("_r"),
        F.count("*").over(spec).alias("_n"),
    )
    keep = F.greatest(F.lit(1.0), F.ceil(F.col("_n") * F.lit(fraction).cast("double")))
    return ranked.where(F.col("_r") <= keep).groupBy(*by).agg(F.avg(column).alias("score"))


def review_of(columns: list[str]) -> Column:
    """``review_score`` where the methods' scores are columns of one row."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)


def review_score(method_scores: DataFrame) -> DataFrame:
    """Mean over the channel-level methods of a window: which contacts to look at first."""
    return method_scores.groupBy("recording_id", "channel", "ch_index", "w").agg(F.avg("score").alias("review"))


def global_threshold(
    scores: DataFrame,
    threshold_mad: float,
    by: list[str] | None = None,
    fallback: str = "floor",
    max_group_rows: int | None = None,
) -> DataFrame:
    """One row per recording: score_center, score_scale and threshold."""
    by = by or ["recording_id"]
    stats = robust_stats(scores, by, ["score"], eps=1e-12, fallback=fallback, max_group_rows=max_group_rows)
    return stats.withColumn("threshold", F.col("score_center") + threshold_mad * F.col("score_scale"))


def relax_threshold(scores: DataFrame, thresholds: DataFrame, tries: int, by: list[str] | None = None) -> DataFrame:
    """First threshold of the bounded relaxation that any window passes, else the last one tried.

    All tries are counted in one aggregate; ``attempts`` lists the tries that were made.
    """
    by = by or ["recording_id"]
    steps = [F.col("threshold")]
    for _ in range(1, tries):
        steps.append(F.greatest(F.col("score_center") + 3.0 * F.col("score_scale"), steps[-1] - F.col("score_scale")))
    limits = thresholds
    for k, step in enumerate(steps):
        limits = limits.withColumn(f"_t{k}", step)
    counted = scores.join(limits, by).groupBy(*by).agg(
        *[F.sum((F.col("score") >= F.col(f"_t{k}")).cast("bigint")).alias(f"_n{k}") for k in range(tries)]
    )
    joined = limits.join(counted, by)
    used = F.coalesce(*[F.when(F.col(f"_n{k}") > 0, k) for k in range(tries)], F.lit(tries - 1))
    attempts = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("iteration"), F.col(f"_t{k}").alias("threshold"),
                F.col(f"_n{k}").alias("candidate_windows"),
            )
            for k in range(tries)
        ]
    )
    return (
        joined.withColumn("attempts", F.slice(attempts, F.lit(1), used + 1))
        .withColumn("used_threshold", F.element_at("attempts", -1)["threshold"])
        .select(*by, "score_center", "score_scale", "threshold", "used_threshold", "attempts")
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; NULL when either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
