"""Operator parameters with their guards; every length is in seconds unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class DetectorConfig:
    window_seconds: float = 2.0
    step_seconds: float = 0.25
    channel_fraction: float = 0.1
    threshold_mad: float = 6.0
    merge_gap_seconds: float = 0.5
    min_involved_channels: int = 2
    min_quality: float = 0.8
    max_iterations: int = 3

    def __post_init__(self) -> None:
        _require(0 < self.step_seconds <= self.window_seconds, "0 < step_seconds <= window_seconds is required")
        _require(0 < self.channel_fraction <= 1, "channel_fraction lies in (0, 1]")
        _require(self.threshold_mad > 0, "threshold_mad is positive")
        _require(self.max_iterations >= 1, "max_iterations is at least 1")

    def samples(self, sfreq: float) -> tuple[int, int]:
        """Window and step in samples (half-to-even rounding), checked for the given rate."""
        _require(sfreq > 0, "sampling rate is positive")
        window, step = round(self.window_seconds * sfreq), max(1, round(self.step_seconds * sfreq))
        _require(window >= 4, "a window holds at least 4 samples")
        return window, step


@dataclass(frozen=True)
class EnsembleConfig:
    window_seconds: float = 4.0
    step_seconds: float = 0.5
    channel_fraction: float = 0.1
    threshold_mad: float = 6.0
    merge_gap_seconds: float = 1.0
    wave_points: int = 64
    dtw_radius: int = 8
    wavelet: str = "db4"
    max_level: int = 4

    def __post_init__(self) -> None:
        _require(0 < self.step_seconds <= self.window_seconds, "0 < step_seconds <= window_seconds is required")
        _require(0 < self.channel_fraction <= 1, "channel_fraction lies in (0, 1]")
        _require(self.threshold_mad > 0, "threshold_mad is positive")
        _require(self.wave_points >= 32, "wave_points is at least 32")
        _require(1 <= self.dtw_radius < self.wave_points, "dtw_radius lies in [1, wave_points)")

    def samples(self, sfreq: float) -> tuple[int, int]:
        _require(sfreq > 0, "sampling rate is positive")
        window, step = round(self.window_seconds * sfreq), round(self.step_seconds * sfreq)
        _require(window >= 2 and step >= 1, "window or step is shorter than the sampling interval")
        return window, step


@dataclass(frozen=True)
class RecruitmentConfig:
    baseline_seconds: float = 30.0
    analysis_seconds: float = 8.0
    z_threshold: float = 6.0
    window_seconds: float = 0.25
    step_seconds: float = 0.05
    low_hz: float = 13.0
    high_hz: float = 80.0
    roi_slack_seconds: float = 0.25
    first_slack_seconds: float = 0.05

    def band(self, sfreq: float) -> tuple[float, float]:
        high = min(self.high_hz, sfreq / 2 * 0.95)
        _require(high > self.low_hz, "sampling rate too low for the requested band")
        return self.low_hz, high


@dataclass(frozen=True)
class GraphConfig:
    correlation_threshold: float = 0.5
    top_k: int = 4
    steps: int = 6
    alpha: float = 0.5


@dataclass(frozen=True)
class ReservoirConfig:
    n_reservoir: int = 400
    spectral_radius: float = 0.95
    input_scaling: float = 1.0
    leak_rate: float = 0.3
    sparsity: float = 0.1
    bias_scaling: float = 0.2
    ridge_alpha: float = 1e-2
    washout: int = 100
    output_feedback_lag: int = 6
    seed: int = 7

    def __post_init__(self) -> None:
        _require(self.n_reservoir >= 4, "n_reservoir is at least 4")
        _require(0 < self.spectral_radius <= 3, "spectral_radius lies in (0, 3]")
        _require(0 < self.leak_rate <= 1, "leak_rate lies in (0, 1]")
        _require(0 < self.sparsity <= 1, "sparsity lies in (0, 1]")
        _require(self.ridge_alpha >= 0, "ridge_alpha is not negative")
        _require(self.washout >= 0, "washout is not negative")
        _require(self.output_feedback_lag >= 0, "output_feedback_lag is not negative")
