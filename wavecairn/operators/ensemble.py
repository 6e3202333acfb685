"""Waveform methods of the ensemble: warping distance, fluctuation exponent, wavelet energies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wavecairn.functions.arrays import array_sum, let
from wavecairn.functions.wavelets import decompose_rows


def dtw_rows(waves: np.ndarray, templates: np.ndarray, radius: int) -> np.ndarray:
    """Banded warping distance of every row to its template; cells advance for all rows at once."""
    rows, length = waves.shape
    previous = np.full((rows, length + 1), np.inf)
    previous[:, 0] = 0.0
    for i in range(1, length + 1):
        current = np.full((rows, length + 1), np.inf)
        lo, hi = max(1, i - radius), min(length, i + radius)
        cost = (waves[:, i - 1 : i] - templates[:, lo - 1 : hi]) ** 2
        reach = np.minimum(previous[:, lo : hi + 1], previous[:, lo - 1 : hi])
        for j in range(lo, hi + 1):
            current[:, j] = cost[:, j - lo] + np.minimum(reach[:, j - lo], current[:, j - 1])
        previous = current
    return np.sqrt(previous[:, length] / length)


def dtw_distance(wave: Column, template: Column, radius: int = 8) -> Column:
    """Column form for equally long arrays."""

    @pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        waves, templates = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        # Column-major so that one cell of all rows is contiguous.
        return pd.Series(dtw_rows(np.asfortranarray(waves), np.asfortranarray(templates), radius))

    return distance(wave, template)


def dfa_exponent(wave: Column, points: int, scales: tuple[int, ...] = (4, 8, 16, 32)) -> Column:
    """Slope of log fluctuation over log box size; NULL with fewer than two usable scales.

    The detrended residual of a box follows from three sums over the box.
    """
    running = F.slice(
        F.aggregate(wave, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))),
        2, points,
    )
    usable = [s for s in scales if points // s >= 2]
    if len(usable) < 2:
        return F.lit(None).cast("double")

    def fluctuation(profile: Column, scale: int) -> Column:
        boxes, centre, spread = points // scale, (scale - 1) / 2.0, scale * (scale * scale - 1) / 12.0

        def residual(part: Column) -> Column:
            moments = F.aggregate(
                F.zip_with(part, F.sequence(F.lit(0), F.lit(scale - 1)), lambda y, k: F.struct(y.alias("y"), (k - F.lit(centre)).alias("x"))),
                F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("xy")),
                lambda acc, p: F.struct((acc["s"] + p["y"]).alias("s"), (acc["xy"] + p["y"] * p["x"]).alias("xy")),
            )

            def squares(m: Column) -> Column:
                off = lambda y, k: y - m["s"] / float(scale) - m["xy"] / spread * (k - F.lit(centre))
                return array_sum(F.transform(part, off), lambda r: r * r)

            return let(moments, squares)

        def box(b: Column) -> Column:
            return let(F.slice(profile, b * scale + 1, F.lit(scale)), residual)

        return F.sqrt(array_sum(F.sequence(F.lit(0), F.lit(boxes - 1)), box) / float(boxes * scale))

    def point(profile: Column, scale: int) -> Column:
        return let(
            fluctuation(profile, scale),
            lambda f: F.when(f > 1e-12, F.struct(F.lit(float(np.log(scale))).alias("x"), F.ln(f).alias("y"))),
        )

    def slope(fits: Column) -> Column:
        n = F.size(fits)
        means = F.struct((array_sum(fits["x"]) / n).alias("x"), (array_sum(fits["y"]) / n).alias("y"))

        def ratio(m: Column) -> Column:
            up = array_sum(fits, lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"]))
            return F.try_divide(up, array_sum(fits, lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"])))

        return F.when(n >= 2, let(means, ratio))

    return let(running, lambda profile: let(F.array_compact(F.array(*[point(profile, s) for s in usable])), slope))


def _stack(waves: pd.Series) -> np.ndarray:
    """Equally long arrays as a matrix; missing samples take the median of their row, or 0."""
    return _filled_rows(np.stack(waves.to_numpy()).astype(float))


def _filled_rows(rows: np.ndarray) -> np.ndarray:
    gaps = ~np.isfinite(rows)
    for k in np.flatnonzero(gaps.any(axis=1)):
        rows[k, gaps[k]] = 0.0 if gaps[k].all() else np.median(rows[k, ~gaps[k]])
    return rows


def _log_energies(bands: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.log1p(np.mean(b * b, axis=1)) for b in bands], axis=1)


def _standardised(bands: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([(b - b.mean(axis=1, keepdims=True)) / (b.std(axis=1, keepdims=True) + 1e-12) for b in bands], axis=1)


def standardised_bands(rows: np.ndarray, wavelet: str, level: int) -> np.ndarray:
    """The vectors ``x`` of ``wavelet_representation`` for a matrix of waves, where a task holds them."""
    return _standardised(decompose_rows(_filled_rows(rows.astype(float)), wavelet, level))


def dwt_energies(waves: DataFrame, wavelet: str, level: int, column: str = "wave") -> DataFrame:
    """``detail_energies``: log energy of the detail bands, coarse to fine.

    All waves of a batch are filtered at once; the column form of the transform
    (``functions.wavelets.with_dwt``) gives the same bands but interprets every tap.
    """

    @pandas_udf("array<double>")
    def energies(series: pd.Series) -> pd.Series:
        if not len(series):
            return pd.Series([], dtype=object)
        return pd.Series(list(_log_energies(decompose_rows(_stack(series), wavelet, level)[1:])))

    return waves.withColumn("detail_energies", energies(F.col(column)))


def wavelet_representation(waves: DataFrame, wavelet: str, level: int, column: str = "wave") -> DataFrame:
    """Per window: ``energies`` of all bands (A first), ``stats`` (mean, deviation, RMS, line
    length) and the vector ``x`` of independently standardised bands."""

    @pandas_udf("energies array<double>, stats array<double>, x array<double>")
    def represent(series: pd.Series) -> pd.DataFrame:
        if not len(series):
            return pd.DataFrame({"energies": [], "stats": [], "x": []})
        rows = _stack(series)
        bands = decompose_rows(rows, wavelet, level)
        stats = [rows.mean(axis=1), rows.std(axis=1), np.sqrt(np.mean(rows * rows, axis=1)), np.abs(np.diff(rows, axis=1)).mean(axis=1)]
        return pd.DataFrame({
            "energies": list(_log_energies(bands)), "stats": list(np.stack(stats, axis=1)), "x": list(_standardised(bands)),
        })

    kept = waves.columns
    return waves.withColumn("_w", represent(F.col(column))).select(*kept, "_w.energies", "_w.stats", "_w.x")
