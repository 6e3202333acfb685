"""Filtering, phase, wavelet power and spectra as vectorised kernels on packed blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecairn.functions.wavelets import LOW_TAPS, decompose_rows, rebuild_rows, usable_level
from wavecairn.operators import panes
from wavecairn.operators.framing import CHANNEL, pack_blocks, per_block

REC = ["recording_id"]
# Canonical rhythm bands in Hz.
RHYTHMS = {
    "delta": (0.5, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 80.0),
}


def butterworth_response(low: float, high: float, sfreq: float, n: int, order: int = 4) -> np.ndarray:
    """First n samples of the band-pass impulse response, by bilinear transform and partial fractions."""
    edge = 2 * sfreq * np.tan(np.pi * np.array([low, high]) / sfreq)
    width, centre = edge[1] - edge[0], np.sqrt(edge[0] * edge[1])
    prototype = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    analog = np.concatenate([half + root, half - root])
    rate = 2 * sfreq
    poles = (rate + analog) / (rate - analog)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    gain = np.real(width**order * rate**order / np.prod(rate - analog))
    residues = np.array([
        gain * np.prod(p - zeros) / np.prod(p - np.delete(poles, k)) for k, p in enumerate(poles)
    ])
    steps = np.arange(n - 1)
    tail = np.real((residues[:, None] * poles[:, None] ** steps).sum(axis=0))
    return np.concatenate([[gain], tail])


def zero_phase(values: np.ndarray, low: float, high: float, sfreq: float, order: int = 4) -> np.ndarray:
    """Forward-backward band-pass along the last axis with odd edge extension.

    The pass band excludes 0 Hz, so a constant past contributes nothing and every pass is a plain
    convolution of the signal minus its first value.
    """
    n = values.shape[-1]
    pad = min(3 * (2 * order + 1), n - 1)
    head = 2 * values[..., :1] - values[..., pad:0:-1]
    tail = 2 * values[..., -1:] - values[..., -2 : -pad - 2 : -1]
    extended = np.concatenate([head, values, tail], axis=-1)
    length = extended.shape[-1]
    size = 1 << int(np.ceil(np.log2(2 * length)))
    response = np.fft.rfft(butterworth_response(low, high, sfreq, length, order), size)
    for _ in range(2):
        spectrum = np.fft.rfft(extended - extended[..., :1], size)
        extended = np.fft.irfft(spectrum * response, size)[..., :length][..., ::-1]
    return extended[..., pad : pad + n]


def analytic_phase(values: np.ndarray) -> np.ndarray:
    """Angle of the analytic signal along the last axis."""
    n = values.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.angle(np.fft.ifft(np.fft.fft(values) * gain))


def _own(row: dict, block: int) -> tuple[slice, int]:
    """The block's own samples as a slice of its array, and the index of the first; a block may begin late."""
    first = max(row["own0"], row["i0"])
    return slice(first - row["i0"], row["own0"] + block - row["i0"]), first


def _one_block(row: dict, block: int) -> None:
    """Segments are transformed as a whole: one that reaches a second block is an error, never cut."""
    if row["block"]:
        raise ValueError(f"a segment has more than {block} samples")


def _known(values: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(values), values, 0.0)


def bandpass_context(context: DataFrame, low: float, high: float, sfreq: float, block: int) -> DataFrame:
    """Zero-phase band-pass of short contexts (``event_context``), each filtered as a whole.

    ``block`` bounds the context length in samples; a longer one is an error.
    """
    extra = [c for c in ("time_s", "context_s") if c in context.columns]
    keys = [*CHANNEL, *extra]

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        _one_block(row, block)
        return {"i": row["i0"] + np.arange(len(values)), "v": zero_phase(_known(values), low, high, sfreq)}

    packed = pack_blocks(context, block, keys=keys)
    return per_block(packed, kernel, [("i", T.LongType()), ("v", T.DoubleType())], keys)


def band_energy_context(context: DataFrame, low: float, high: float, sfreq: float, block: int, window: int, step: int) -> DataFrame:
    """Mean squared band-passed signal per complete window ``w`` of short contexts, in one pass.

    The filter and the windows are one kernel on a context's array: no filtered sample leaves the task.
    """
    keys = [*CHANNEL, "time_s", "context_s"]

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        _one_block(row, block)
        first = -(-row["i0"] // step)
        filtered = zero_phase(_known(values), low, high, sfreq)[first * step - row["i0"] :]
        if len(filtered) < window:
            return {"w": np.empty(0, dtype=np.int64), "energy": np.empty(0)}
        frames = np.lib.stride_tricks.sliding_window_view(filtered, window)[::step]
        return {"w": first + np.arange(len(frames)), "energy": np.mean(frames * frames, axis=1)}

    return per_block(pack_blocks(context, block, keys=keys), kernel, [("w", T.LongType()), ("energy", T.DoubleType())], keys)


def bandpass(samples: DataFrame, low: float, high: float, sfreq: float, block: int, margin: int) -> DataFrame:
    """Zero-phase band-pass of whole recordings, block by block with a margin on both sides."""

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        own, first = _own(row, block)
        kept = zero_phase(_known(values), low, high, sfreq)[own]
        return {"i": first + np.arange(len(kept)), "v": kept}

    packed = pack_blocks(samples, block, before=margin, after=margin)
    return per_block(packed, kernel, [("i", T.LongType()), ("v", T.DoubleType())])


def phase_series(samples: DataFrame, low: float, high: float, sfreq: float, block: int, margin: int) -> DataFrame:
    """Instantaneous phase of one band per channel and sample."""

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        own, first = _own(row, block)
        centred = _known(values - np.nanmedian(values) if np.isfinite(values).any() else values)
        kept = analytic_phase(zero_phase(centred, low, high, sfreq))[own]
        return {"i": first + np.arange(len(kept)), "phase": kept}

    packed = pack_blocks(samples, block, before=margin, after=margin)
    return per_block(packed, kernel, [("i", T.LongType()), ("phase", T.DoubleType())])


def order_from_phases(phases: DataFrame, window: int, step: int, n_samples, by: list[str] | None = None) -> DataFrame:
    """Window mean of the synchrony of all channels at every sample, from phases."""
    by = by or REC
    instant = phases.groupBy(*by, "i").agg(F.hypot(F.avg(F.cos("phase")), F.avg(F.sin("phase"))).alias("r"))
    return panes.window_sums(instant, window, step, n_samples, by, F.col("r")).select(*by, "w", panes.mean().alias("order"))


def kuramoto_order(
    samples: DataFrame, sfreq: float, window: int, step: int, n_samples, block: int, margin: int,
    bands: dict[str, tuple[float, float]] | None = None, tile: int = 64,
) -> DataFrame:
    """Phase synchrony per rhythm band and window.

    A task gets one time block of up to ``tile`` channels, filters and sums the unit phasors, so
    only one complex value per band and sample is shuffled instead of one per channel.
    """
    usable = {n: b for n, b in (bands or RHYTHMS).items() if b[1] < sfreq / 2}
    if not usable:
        raise ValueError("sampling rate too low for every band")
    packed = pack_blocks(samples, block, before=margin, after=margin).withColumn(
        "_tile", F.floor(F.col("ch_index") / tile)
    )

    def phasors(group: pd.DataFrame) -> pd.DataFrame:
        first, rows = group.iloc[0], []
        # Channels may begin or end differently: one common span, missing samples outside.
        begins, ends = group["i0"].min(), max(i + len(v) for i, v in zip(group["i0"], group["v"]))
        matrix = np.full((len(group), ends - begins), np.nan)
        for line, i, v in zip(matrix, group["i0"], group["v"]):
            line[i - begins : i - begins + len(v)] = np.asarray(v, dtype=float)
        centre = np.array([np.nanmedian(r) if np.isfinite(r).any() else 0.0 for r in matrix])
        matrix = _known(matrix - centre[:, None])
        own, start = _own({"own0": int(first["own0"]), "i0": int(begins)}, block)
        for name, (low, high) in usable.items():
            phase = analytic_phase(zero_phase(matrix, low, high, sfreq))[:, own]
            rows.append((first["recording_id"], name, start, np.cos(phase).sum(axis=0),
                         np.sin(phase).sum(axis=0), len(matrix)))
        return pd.DataFrame(rows, columns=["recording_id", "band", "own0", "re", "im", "n"])

    sums = packed.groupBy("recording_id", "_tile", "block").applyInPandas(
        phasors, "recording_id string, band string, own0 bigint, re array<double>, im array<double>, n bigint"
    )
    instant = (
        sums.select(*REC, "band", "own0", "n", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
        .groupBy(*REC, "band", (F.col("own0") + F.col("k")).alias("i"))
        .agg((F.hypot(F.sum("c.re"), F.sum("c.im")) / F.sum("n")).alias("r"))
    )
    by = [*REC, "band"]
    return panes.window_sums(instant, window, step, n_samples, by, F.col("r")).select(*by, "w", panes.mean().alias("order"))


def cwt_frequencies(low: float, high: float, sfreq: float, voices: int = 12) -> np.ndarray:
    if not 0 < low < high < sfreq / 2:
        raise ValueError("0 < minimum < maximum < Nyquist is required")
    count = max(16, int(np.ceil(np.log2(high / low) * voices)) + 1)
    return np.geomspace(high, low, count)


def cwt_power(
    segments: DataFrame, low: float, high: float, sfreq: float, block: int,
    bandwidth: float = 1.0, centre: float = 0.5, voices: int = 12,
) -> DataFrame:
    """Complex Morlet power of segments of any length, block by block with a margin of the longest wavelet's support.

    The sampled wavelet ends at 8 scales, so a sample's power depends on the samples within that margin only:
    the blocks give what the whole segment would. ``block`` grows to the margin where it is shorter.
    """
    frequencies = cwt_frequencies(low, high, sfreq, voices)
    scales = centre * sfreq / frequencies
    margin = math.ceil(8 * scales.max())
    block = max(block, margin)

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        own, first = _own(row, block)
        values, n = _known(values), len(values)
        size = 1 << int(np.ceil(np.log2(2 * n)))
        spectrum = np.fft.fft(values, size)
        lag = np.fft.fftfreq(size, 1.0 / size)
        power = np.empty((len(scales), n))
        for k, scale in enumerate(scales):
            u = lag / scale
            wave = np.exp(2j * np.pi * centre * u - u * u / bandwidth) / np.sqrt(np.pi * bandwidth)
            power[k] = np.abs(np.fft.ifft(spectrum * np.fft.fft(np.where(np.abs(u) <= 8, wave, 0)))[:n]) ** 2 / scale
        power = power[:, own]
        index = first + np.arange(power.shape[1])
        return {"frequency": np.repeat(frequencies, len(index)), "i": np.tile(index, len(scales)), "power": power.ravel()}

    fields = [("frequency", T.DoubleType()), ("i", T.LongType()), ("power", T.DoubleType())]
    return per_block(pack_blocks(segments, block, before=margin, after=margin), kernel, fields)


def dwt_components(segments: DataFrame, wavelet: str, level: int, block: int) -> DataFrame:
    """Full-length reconstruction of every band alone; the components add up to the segment.

    Segments of any length, with samples numbered from 0: blocks of whole 2^level samples have a margin of the
    support of decomposition and reconstruction, so their own samples come out as in the whole segment, whose
    ends alone are extended. ``block`` grows to such a margin where it is shorter.
    """
    grain = 1 << level
    margin = grain * math.ceil(2 * (len(LOW_TAPS[wavelet]) - 1) * (grain - 1) / grain)
    # A longer segment has the full level: a shorter one is a single block.
    block = grain * math.ceil(max(block, margin, (len(LOW_TAPS[wavelet]) - 1) * grain) / grain)

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        if row["i0"] % grain:
            raise ValueError("samples of a segment must be numbered from 0")
        own, first = _own(row, block)
        n = len(values)
        alone = row["own0"] == 0 and n <= block
        used = usable_level(n, wavelet, level) if alone else level
        bands = decompose_rows(_known(values)[None, :], wavelet, used)
        labels = [f"A{used}"] + [f"D{k}" for k in range(used, 0, -1)]
        parts = [
            rebuild_rows([b if j == k else np.zeros_like(b) for j, b in enumerate(bands)], wavelet, n)[0][own]
            for k in range(len(bands))
        ]
        index = first + np.arange(len(parts[0]))
        return {"band": np.repeat(labels, len(index)), "i": np.tile(index, len(parts)), "v": np.concatenate(parts)}

    fields = [("band", T.StringType()), ("i", T.LongType()), ("v", T.DoubleType())]
    return per_block(pack_blocks(segments, block, before=margin, after=margin), kernel, fields)


def welch_psd(
    samples: DataFrame, sfreq: float, segment: int, step: int, low: float = 0.5, high: float = 250.0,
    target: int = 16384,
) -> DataFrame:
    """Power spectral density per channel: mean over Hamming-windowed segments, linear trend kept,
    segment mean removed. Segment spectra are summed inside a block before the shuffle."""
    from wavecairn.operators.features import _frames, window_blocks

    frequency = np.fft.rfftfreq(segment, 1.0 / sfreq)
    kept = (frequency >= low) & (frequency <= min(high, sfreq / 2))

    def kernel(values: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        frames, _ = _frames(_known(values), row, segment, step)
        taper = np.hamming(segment + 1)[:-1]
        spectrum = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
        density = spectrum / (sfreq * (taper @ taper))
        density[:, 1 : (segment + 1) // 2] *= 2
        total = density.sum(axis=0)[kept]
        return {"bin": np.flatnonzero(kept), "total": total, "n": np.full(len(total), float(len(frames)))}

    fields = [("bin", T.IntegerType()), ("total", T.DoubleType()), ("n", T.DoubleType())]
    sums = per_block(window_blocks(samples, segment, step, target), kernel, fields)
    return sums.groupBy(*CHANNEL, "bin").agg((F.sum("total") / F.sum("n")).alias("psd")).select(
        *CHANNEL, (F.col("bin") * F.lit(sfreq / segment)).alias("frequency"), "psd"
    )
