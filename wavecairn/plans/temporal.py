"""Correlation graph of every tumbling window, with an event score and its channel correlates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecairn.functions.wavelets import usable_level
from wavecairn.operators import ensemble, events, graph
from wavecairn.operators.cleaning import clean
from wavecairn.operators.framing import CHANNEL, pack_blocks
from wavecairn.session import cut_lineage

REC = ["recording_id"]


class TemporalGraph(NamedTuple):
    features: DataFrame
    edges: DataFrame
    score: DataFrame
    known: DataFrame
    correlates: DataFrame


def window_waves(samples: DataFrame, window: int) -> DataFrame:
    """Complete tumbling windows: CHANNEL, w, wave."""
    blocks = pack_blocks(clean(samples), window).where(F.size("v") == window)
    return blocks.select(*CHANNEL, F.col("block").alias("w"), F.col("v").alias("wave"))


def window_vectors(samples: DataFrame, window: int, wavelet: str = "db4", max_level: int = 5) -> DataFrame:
    """Wavelet energies, statistics and standardised vectors of complete tumbling windows."""
    level = usable_level(window, wavelet, max_level)
    return ensemble.wavelet_representation(window_waves(samples, window), wavelet, level).drop("wave")


def temporal_graph(
    samples: DataFrame, window: int, n_channels: int, known_channels: Column, context: DataFrame, sfreq: float,
    wavelet: str = "db4", threshold: float = 0.65, top_k: int = 6, exclude: str | None = None,
) -> TemporalGraph:
    """One run over all windows of all recordings; windows are independent groups of channels.

    Energies are written once. The links take the waves, whose vectors are made where the channels of a window
    meet; ``features`` has the vectors too and makes them when asked for.
    """
    features = window_vectors(samples, window, wavelet)
    energies = cut_lineage(features.select(*CHANNEL, "w", "energies"))
    level = usable_level(window, wavelet, 5)
    waves = window_waves(samples, window).withColumnRenamed("wave", "x")
    edges = graph.correlation_graph(waves, [*REC, "w"], threshold, top_k, n_channels, lambda rows: ensemble.standardised_bands(rows, wavelet, level))
    score = cut_lineage(graph.detail_energy_score(energies, known_channels))
    at = context.select(*REC, F.floor(F.floor(F.col("time_s") * sfreq) / window).cast("bigint").alias("w"))
    edges = edges.join(at.withColumn("known_event", F.lit(True)), [*REC, "w"], "left").withColumn(
        "known_event", F.coalesce("known_event", F.lit(False))
    )
    known = events.score_at(score.withColumn("method", F.lit("event_score")), at)
    correlates = graph.extremes(graph.channel_score_corr(energies, score, exclude), "correlation")
    return TemporalGraph(features, edges, score, known, correlates)
