"""Discrete wavelet transform on array columns, symmetric half-point extension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecairn.functions.arrays import array_mean, array_std, array_sum, let

# Daubechies decomposition low-pass taps.
LOW_TAPS = {
    "db1": [0.7071067811865476, 0.7071067811865476],
    "db2": [-0.12940952255126037, 0.2241438680420134, 0.8365163037378079, 0.48296291314453416],
    "db4": [
        -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
        -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
    ],
}


def taps(wavelet: str) -> tuple[list[float], list[float]]:
    """Decomposition low and high pass; the high pass is the alternating flip of the low pass."""
    low = LOW_TAPS[wavelet]
    high = [(-1) ** (k + 1) * value for k, value in enumerate(reversed(low))]
    return low, high


def max_level(n: Column, filter_length: int, requested: int) -> Column:
    """min(requested, floor(log2(n / (filter_length - 1)))), never below 0."""
    return F.least(
        F.lit(requested), F.greatest(F.lit(0), F.floor(F.log2(n / F.lit(float(filter_length - 1)))).cast("int"))
    )


def usable_level(n: int, wavelet: str, requested: int) -> int:
    level = min(requested, int(np.floor(np.log2(n / (len(LOW_TAPS[wavelet]) - 1)))))
    if level < 1:
        raise ValueError(f"{n} samples are too few for {wavelet}")
    return level


def _filter_pair(values: Column, wavelet: str) -> Column:
    """One decomposition step: array of (low, high) structs."""
    low, high = taps(wavelet)
    width = len(low)
    n = F.size(values)
    extended = F.concat(
        F.reverse(F.slice(values, F.lit(1), F.lit(width - 1))),
        values,
        F.reverse(F.slice(values, n - width + 2, F.lit(width - 1))),
    )

    def over(padded: Column) -> Column:
        def at(k: Column) -> Column:
            picks = [F.get(padded, 2 * k + (width - j)) for j in range(width)]
            pair = [sum((p * t for p, t in zip(picks[1:], f[1:])), picks[0] * f[0]) for f in (low, high)]
            return F.struct(pair[0].alias("low"), pair[1].alias("high"))

        return F.transform(F.sequence(F.lit(0), F.floor((n + width - 1) / 2).cast("int") - 1), at)

    return let(extended, over)


def with_dwt(df: DataFrame, column: str, wavelet: str, level: int) -> DataFrame:
    """Add ``band_a<level>``, ``band_d<level>`` .. ``band_d1``; arrays are NULL-free inputs."""
    out = df.withColumn("_approx", F.col(column))
    for step in range(1, level + 1):
        out = out.withColumn("_pair", _filter_pair(F.col("_approx"), wavelet))
        out = out.withColumn(f"band_d{step}", F.col("_pair.high")).withColumn("_approx", F.col("_pair.low"))
    return out.withColumnRenamed("_approx", f"band_a{level}").drop("_pair")


def band_names(level: int) -> list[str]:
    return [f"band_a{level}"] + [f"band_d{d}" for d in range(level, 0, -1)]


def log_energy(band: Column) -> Column:
    return F.log1p(array_sum(band, lambda x: x * x) / F.size(band))


def standardised(band: Column) -> Column:
    stats = F.struct(array_mean(band).alias("mean"), array_std(band).alias("std"))
    return let(stats, lambda s: F.transform(band, lambda x: (x - s["mean"]) / (s["std"] + F.lit(1e-12))))


def band_low_hz(label: Column, sfreq: Column) -> Column:
    level = F.substring(label, 2, 10).cast("int")
    return F.when(label.startswith("A"), 0.0).otherwise(sfreq / F.pow(F.lit(2.0), level + 1))


def band_high_hz(label: Column, sfreq: Column) -> Column:
    level = F.substring(label, 2, 10).cast("int")
    return sfreq / F.pow(F.lit(2.0), F.when(label.startswith("A"), level + 1).otherwise(level))


def decompose_rows(rows: np.ndarray, wavelet: str, level: int) -> list[np.ndarray]:
    """The same transform for a matrix of equally long rows: [a_level, d_level, .., d1]."""
    low, high = (np.asarray(t) for t in taps(wavelet))
    width, details = len(low), []
    for _ in range(level):
        n = rows.shape[1]
        padded = np.pad(rows, ((0, 0), (width - 1, width - 1)), mode="symmetric")
        frames = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[:, 1::2][:, : (n + width - 1) // 2]
        details.append(frames @ high[::-1])
        rows = frames @ low[::-1]
    return [rows, *reversed(details)]


def rebuild_rows(bands: list[np.ndarray], wavelet: str, n: int) -> np.ndarray:
    """Inverse of ``decompose_rows`` for rows of length ``n``."""
    low, high = taps(wavelet)
    rebuild_low, rebuild_high = np.asarray(low[::-1]), np.asarray(high[::-1])
    width, approx = len(low), bands[0]
    for detail in bands[1:]:
        approx = approx[:, : detail.shape[1]]
        length = 2 * detail.shape[1] - width + 2
        total = np.zeros((approx.shape[0], 2 * detail.shape[1] + width))
        for j in range(width):
            total[:, j : j + 2 * detail.shape[1] : 2] += rebuild_low[j] * approx + rebuild_high[j] * detail
        approx = total[:, width - 2 : width - 2 + length]
    return approx[:, :n]
