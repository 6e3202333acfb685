"""Overlapping windows from panes: each sample is summed once, and only panes are repeated.

The borders of all windows cut the time axis into panes. With a step that divides the window, a pane is a step;
else a step is two panes, cut where a window ends. Every window is a whole number of panes, and the sums of a
pane merge, so a sample takes part in one grouped aggregate instead of window / step rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecairn.operators.framing import CHANNEL, is_packed, is_whole, per_block, unpack_blocks

#: What a pane holds of its samples; NULL samples count for the places only.
SUMS = ("n", "total", "squares", "places", "place_squares", "moment", "low", "high", "first_i", "last_i", "first", "last")


def pane_of(i: Column, window: int, step: int) -> Column:
    """Number of the pane that holds sample ``i``."""
    whole, rest = F.floor(i / step), window % step
    return whole if not rest else 2 * whole + F.when(i - whole * step >= rest, 1).otherwise(0)


def pane_start(pane: Column, window: int, step: int) -> Column:
    """First place of a pane."""
    rest = window % step
    return pane * step if not rest else F.floor(pane / 2) * step + F.pmod(pane, F.lit(2)) * rest


def pane_sums(samples: DataFrame, window: int, step: int, by: list[str] | None = None, value: Column | None = None) -> DataFrame:
    """One row per ``by`` and pane with the sums ``SUMS`` of ``value`` (v); places are counted from the pane's start.

    Unused sums are pruned from the plan. The sums combine before the shuffle.
    """
    by = by or CHANNEL
    v = F.col("v") if value is None else value
    rows = samples.select(*by, "i", v.alias("_v"), pane_of(F.col("i"), window, step).cast("bigint").alias("pane"))
    rows = rows.withColumn("_p", F.when(F.col("_v").isNotNull(), F.col("i") - pane_start(F.col("pane"), window, step)))
    known = F.when(F.col("_v").isNotNull(), F.col("i"))
    return rows.groupBy(*by, "pane").agg(
        F.count("_v").alias("n"), F.sum("_v").alias("total"), F.sum(F.col("_v") * F.col("_v")).alias("squares"),
        F.sum("_p").alias("places"), F.sum(F.col("_p") * F.col("_p")).alias("place_squares"), F.sum(F.col("_p") * F.col("_v")).alias("moment"),
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.min("i").alias("first_i"), F.max("i").alias("last_i"),
        F.min_by("_v", known).alias("first"), F.max_by("_v", known).alias("last"),
    )


def windows_of(pane: Column, window: int, step: int) -> tuple[Column, Column]:
    """First and last window that hold a pane, before any clipping."""
    reach = window // step
    if not window % step:
        return pane - reach + 1, pane
    whole, part = F.floor(pane / 2), F.pmod(pane, F.lit(2))
    return whole - reach + part, whole


def merge_panes(panes: DataFrame, window: int, step: int, n_samples: Column, by: list[str] | None = None) -> DataFrame:
    """One row per ``by`` and complete window ``w`` with the merged ``SUMS``; places count from the window's start.

    ``n_samples`` is the recording's length, as a literal or a column of ``panes``.
    """
    by = by or CHANNEL
    low, high = windows_of(F.col("pane"), window, step)
    low, high = F.greatest(F.lit(0), low), F.least(high, F.floor((n_samples - window) / step))
    tall = panes.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint")}).where("_low <= _high")
    tall = tall.withColumn("w", F.explode(F.sequence("_low", "_high")))
    shift = pane_start(F.col("pane"), window, step) - F.col("w") * step
    known = F.when(F.col("n") > 0, F.col("pane"))
    return tall.groupBy(*by, "w").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.sum(F.col("places") + shift * F.col("n")).alias("places"),
        F.sum(F.col("place_squares") + 2 * shift * F.col("places") + shift * shift * F.col("n")).alias("place_squares"),
        F.sum(F.col("moment") + shift * F.col("total")).alias("moment"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_i").alias("first_i"), F.max("last_i").alias("last_i"),
        F.min_by("first", known).alias("first"), F.max_by("last", known).alias("last"),
    )


def window_sums(
    samples: DataFrame, window: int, step: int, n_samples: Column, by: list[str] | None = None, value: Column | None = None, only: tuple[str, ...] = SUMS,
) -> DataFrame:
    """``pane_sums`` and ``merge_panes`` in one; ``n_samples`` must be a literal here.

    Arrays that hold whole channels are summed where they are, and only the sums named in ``only`` are made.
    Other arrays are opened.
    """
    if is_packed(samples):
        if is_whole(samples) and value is None:
            return _sums_in_place(samples, window, step, by or CHANNEL, only).where(F.col("w") <= F.floor((n_samples - window) / step))
        samples = unpack_blocks(samples, by)
    return merge_panes(pane_sums(samples, window, step, by, value), window, step, n_samples, by)


def nested_sums(samples: DataFrame, window: int, step: int, n_samples: int, only: tuple[str, ...]) -> DataFrame:
    """``window_sums`` of arrays that hold whole channels, as arrays: one row a channel."""
    return _sums_in_place(samples, window, step, CHANNEL, only, (n_samples - window) // step)


def _sums_in_place(samples: DataFrame, window: int, step: int, by: list[str], only: tuple[str, ...], upto: int | None = None) -> DataFrame:
    """Sums of every window from 0 on that holds a place of the array; a place outside the array counts as absent."""
    kinds = {n: T.LongType() if n in ("n", "places", "place_squares", "first_i", "last_i") else T.DoubleType() for n in only}
    place = np.arange(window)

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        if not len(values):
            return {"w": np.empty(0, dtype=np.int64), **{n: np.empty(0) for n in only}}
        i0, last = row["i0"], row["i0"] + len(values) - 1
        w = np.arange(max(0, -(-(i0 - window + 1) // step)), (last // step if upto is None else min(upto, last // step)) + 1)
        if not len(w):
            return {"w": w, **{n: np.empty(0) for n in only}}
        return {"w": w, **({n: f() for n, f in _window_kernels(values, row["known"], i0, last, w * step, window, place).items() if n in only})}

    return per_block(samples, kernel, [("w", T.LongType()), *kinds.items()], by, nested=upto is not None)


def _window_kernels(values: np.ndarray, known: np.ndarray | None, i0: int, last: int, starts: np.ndarray, window: int, place: np.ndarray) -> dict:
    """What makes each sum of the windows at ``starts``. Missing and absent places are NULL: they count in no sum."""
    pad = (max(0, i0 - int(starts[0])), max(0, int(starts[-1]) + window - 1 - last))
    skip = max(0, int(starts[0]) - i0)
    stride = int(starts[1] - starts[0]) if len(starts) > 1 else 1
    here = np.pad(np.ones(len(values), bool) if known is None else known, pad)[skip:]
    x = np.pad(values, pad)[skip:]
    x = np.where(here, x, 0.0)
    frames = lambda a: np.lib.stride_tricks.sliding_window_view(a, window)[::stride][: len(starts)]
    weighted = lambda a, by: np.correlate(a, by.astype(float), "valid")[::stride][: len(starts)]
    seen = frames(here)
    n = seen.sum(axis=1)
    hide = lambda a: np.ma.masked_array(a, n == 0) if not n.all() else a
    rows = np.arange(len(n))
    return {
        "n": lambda: n, "total": lambda: hide(frames(x).sum(axis=1)), "squares": lambda: hide(frames(x * x).sum(axis=1)),
        "places": lambda: hide(weighted(here.astype(float), place)), "place_squares": lambda: hide(weighted(here.astype(float), place * place)), "moment": lambda: hide(weighted(x, place)),
        "low": lambda: hide(np.fmin.reduce(frames(np.where(here, x, np.nan)), axis=1)), "high": lambda: hide(frames(np.where(here, x, -np.inf)).max(axis=1)),
        "first_i": lambda: np.maximum(starts, i0), "last_i": lambda: np.minimum(starts + window - 1, last),
        "first": lambda: hide(frames(x)[rows, seen.argmax(axis=1)]), "last": lambda: hide(frames(x)[rows, window - 1 - seen[:, ::-1].argmax(axis=1)]),
    }


def mean() -> Column:
    return F.try_divide(F.col("total"), F.col("n"))


def variance() -> Column:
    """Population variance of a window; rounding never makes it negative."""
    return F.greatest(F.lit(0.0), F.try_divide(F.col("squares"), F.col("n")) - mean() * mean())


def energy() -> Column:
    """Mean of the squared samples."""
    return F.try_divide(F.col("squares"), F.col("n"))


def slope() -> Column:
    """Slope of the least-squares line per sample; NULL for fewer than two samples."""
    across = F.col("n") * F.col("moment") - F.col("places") * F.col("total")
    return F.try_divide(across, F.col("n") * F.col("place_squares") - F.col("places") * F.col("places"))


def residual_rms() -> Column:
    """Root mean square about the least-squares line."""
    spread = F.try_divide(F.col("place_squares"), F.col("n")) - F.try_divide(F.col("places"), F.col("n")) * F.try_divide(F.col("places"), F.col("n"))
    return F.sqrt(F.greatest(F.lit(0.0), variance() - F.coalesce(slope() * slope() * spread, F.lit(0.0))))
