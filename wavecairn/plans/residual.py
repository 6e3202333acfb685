"""Forecast-residual detector around resolved events."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.config import ReservoirConfig
from wavecairn.operators import residual as R
from wavecairn.session import cut_lineage

REC = ["recording_id"]


class Residual(NamedTuple):
    verdicts: DataFrame
    scores: DataFrame
    channel_z: DataFrame
    rmse: DataFrame
    predicted: DataFrame


def residual_detect(
    samples: DataFrame, context: DataFrame, inputs: DataFrame, outputs: DataFrame, sfreq: float,
    config: ReservoirConfig = ReservoirConfig(), baseline: float = 60.0, analysis: float = 20.0, smoothing: int = 5,
) -> Residual:
    """``inputs``: marker channels per recording; ``outputs``: recording_id, channel, position
    (``select_outputs``). Every recording with an event is one independent model."""
    longest = int((baseline + analysis) * sfreq) + 2
    window = R.model_window(samples, context, sfreq, baseline, analysis)
    design = R.design_matrix(window, inputs, outputs, config.output_feedback_lag)
    states = cut_lineage(R.reservoir_states(design, config))
    weights = R.ridge_fit(R.training(states, config.washout), config.ridge_alpha)
    predicted = cut_lineage(R.predict(states, weights).drop("f"))
    scores = R.residual_score(predicted, config.washout, longest)
    verdicts = R.describe_residual(R.residual_verdict(scores, config.washout, smoothing))
    return Residual(
        verdicts, scores, R.channel_residual_z(predicted, config.washout, longest),
        R.training_rmse(predicted, config.washout), predicted,
    )
