"""Spark operators that find and explain extreme events in multichannel sampled signals."""

from wavecairn.config import (
    DetectorConfig,
    EnsembleConfig,
    GraphConfig,
    RecruitmentConfig,
    ReservoirConfig,
)

__all__ = [
    "DetectorConfig",
    "EnsembleConfig",
    "GraphConfig",
    "RecruitmentConfig",
    "ReservoirConfig",
]
