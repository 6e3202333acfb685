"""Data quality, filling and display decimation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.functions.arrays import finite
from wavecairn.operators.framing import CHANNEL, is_packed
from wavecairn.operators.robust import group_medians, scale_of


def clean(samples: DataFrame) -> DataFrame:
    if is_packed(samples):
        return samples.withColumn("v", F.transform("v", finite))
    return samples.withColumn("v", finite(F.col("v")))


def quality(samples: DataFrame) -> DataFrame:
    """Finite fraction over the whole matrix of a recording: absent rows inside its span are missing, too."""
    channels = samples.groupBy(*CHANNEL).agg(
        F.count(finite(F.col("v"))).alias("present"), F.min("i").alias("first"), F.max("i").alias("last")
    )
    cells = F.count(F.lit(1)) * (F.max("last") - F.min("first") + 1)
    return channels.groupBy("recording_id").agg((F.sum("present") / cells).alias("quality"))


def accept_quality(samples: DataFrame, minimum: float, strict: bool = False) -> DataFrame:
    """(recording_id, quality, ok); strict mode fails the job on the first rejected recording."""
    rated = quality(samples).withColumn("ok", F.col("quality") >= minimum)
    if strict:
        problem = F.concat(F.lit("usable sample fraction below the minimum: "), F.col("recording_id"))
        rated = rated.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(problem).cast("boolean")))
    return rated


def guard_report(recordings: DataFrame, window: int, min_quality: float) -> DataFrame:
    """Which recordings can be analysed, as columns instead of errors."""
    return recordings.select(
        "recording_id", "quality", (F.col("n_samples") >= window).alias("long_enough"),
        (F.col("quality") >= min_quality).alias("good_enough"), "unique_names",
    )


def channel_fills(samples: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Replacement value for every channel that misses samples: its median, 0 if it has none.

    Medians are taken over the incomplete channels alone.
    """
    value = finite(F.col("v"))
    if is_packed(samples):  # only channels with gaps are opened
        known = F.size(F.filter("v", lambda x: finite(x).isNotNull()))
        gaps = samples.groupBy(*CHANNEL).agg((F.max(F.col("i0") + F.size("v")) - F.min("i0") - F.sum(known)).alias("missing")).where("missing > 0")
        opened = samples.join(gaps.select(*CHANNEL), CHANNEL, "left_semi").select(*CHANNEL, F.explode("v").alias("v"))
        return _fills(gaps, opened, max_group_rows)
    gaps = samples.groupBy(*CHANNEL).agg(
        (F.max("i") - F.min("i") + 1 - F.count(value)).alias("missing"), F.count(value).alias("present")
    ).where("missing > 0")
    return _fills(gaps, samples.join(gaps.select(*CHANNEL), CHANNEL, "left_semi"), max_group_rows)


def _fills(gaps: DataFrame, samples: DataFrame, max_group_rows: int | None) -> DataFrame:
    wanted = samples.select(*CHANNEL, finite(F.col("v")).alias("fill"))
    medians = group_medians(wanted, CHANNEL, ["fill"], max_group_rows)
    return gaps.select(*CHANNEL).join(medians, CHANNEL, "left").withColumn("fill", F.coalesce("fill", F.lit(0.0)))


def fill_recording(samples: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Missing samples take the channel median over the recording."""
    fills = channel_fills(samples, max_group_rows)
    return (
        clean(samples)
        .join(fills, CHANNEL, "left")
        .withColumn("v", F.coalesce("v", "fill"))
        .drop("fill")
        .select(*samples.columns)
    )


def fill_window(windowed: DataFrame) -> DataFrame:
    """Missing samples take the channel median inside their window; adds the missing fraction.

    A group is one window of one channel, so its size is the window length.
    """
    by = [*CHANNEL, "w"]
    value = finite(F.col("v"))
    stats = windowed.groupBy(*by).agg(
        F.median(value).alias("_median"), F.avg(value.isNull().cast("double")).alias("bad_fraction")
    )
    return windowed.join(stats, by).select(
        *by, "i", F.coalesce(value, "_median", F.lit(0.0)).alias("v"), "bad_fraction"
    )


def detrend_windows(windowed: DataFrame) -> DataFrame:
    """Subtract the least-squares line of every window; residual in ``r``."""
    by = [*CHANNEL, "w"]
    lines = windowed.groupBy(*by).agg(
        F.regr_slope("v", F.col("i").cast("double")).alias("_b"),
        F.regr_intercept("v", F.col("i").cast("double")).alias("_a"),
    )
    return windowed.join(lines, by).select(*by, "i", "v", (F.col("v") - F.col("_a") - F.col("_b") * F.col("i")).alias("r"))


def overview_series(samples: DataFrame, n_samples: int, max_points: int = 12000, spacing: float = 8.0) -> DataFrame:
    """Every k-th sample, robustly normalised per channel, clipped to +-3.5 and offset per channel."""
    stride = max(1, -(-n_samples // max_points))
    shown = clean(samples).where(F.col("i") % stride == 0)
    bound = -(-n_samples // stride)
    first = group_medians(shown, CHANNEL, ["v"], bound, [F.stddev_pop("v").alias("_std")]).withColumnRenamed("v", "_center")
    shifted = shown.join(first, CHANNEL).withColumn("_dev", F.abs(F.col("v") - F.col("_center")))
    second = group_medians(shifted, CHANNEL, ["_dev"], bound).withColumnRenamed("_dev", "_mad")
    rank = shown.groupBy("recording_id").agg(F.max("ch_index").alias("_last"))
    scale = scale_of(F.lit(1.4826) * F.col("_mad"), F.col("_std"), 0.0, "unit")
    y = F.greatest(F.lit(-3.5), F.least(F.lit(3.5), (F.col("v") - F.col("_center")) / scale))
    return (
        shifted.join(second, CHANNEL)
        .join(rank, "recording_id")
        .select(*CHANNEL, "i", (y + (F.col("_last") - F.col("ch_index")) * spacing).alias("y"))
    )


def centred_overview(samples: DataFrame, rms: DataFrame, n_samples: int) -> DataFrame:
    """Variant scaling: centre by the channel median, divide by the channel median of window RMS."""
    center = group_medians(clean(samples), CHANNEL, ["v"], n_samples).withColumnRenamed("v", "_center")
    level = group_medians(rms, CHANNEL, ["rms"], n_samples).withColumnRenamed("rms", "_level")
    return (
        clean(samples).join(center, CHANNEL).join(level, CHANNEL)
        .select(*CHANNEL, "i", ((F.col("v") - F.col("_center")) / F.when(F.col("_level") > 1e-12, F.col("_level")).otherwise(1.0)).alias("y"))
    )
