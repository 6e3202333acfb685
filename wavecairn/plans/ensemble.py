"""Five-method ensemble detector and its comparison with the targeted analysis."""

from __future__ import annotations

import math

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.config import EnsembleConfig, RecruitmentConfig
from wavecairn.functions.arrays import top_mean
from wavecairn.functions.wavelets import usable_level
from wavecairn.operators import ensemble, events, recruit, robust, spectral
from wavecairn.operators.features import DETECTOR_FEATURES, wave_template, window_blocks, window_profiles
from wavecairn.operators.framing import CHANNEL
from wavecairn.plans.analyse import band_z
from wavecairn.plans.detect import recordings_of, summarise
from wavecairn.session import cut_lineage

REC = ["recording_id"]


class Ensemble(NamedTuple):
    events: DataFrame
    scores: DataFrame
    thresholds: DataFrame
    method_z: DataFrame
    channel_scores: DataFrame
    recordings: DataFrame


def channel_methods(profiles: DataFrame, config: EnsembleConfig, max_windows: int | None) -> DataFrame:
    """time_domain, dtw, dfa and dwt score of every channel and window (columns)."""
    level = usable_level(config.wave_points, config.wavelet, config.max_level)
    templates = wave_template(profiles, max_windows)
    # One template per channel; Spark broadcasts it when the table on disk is small enough.
    rows = profiles.join(templates, ["recording_id", "channel"])
    rows = rows.withColumn("dtw", ensemble.dtw_distance(F.col("wave"), F.col("template"), config.dtw_radius))
    rows = rows.withColumn("dfa", ensemble.dfa_exponent(F.col("wave"), config.wave_points)).drop("template")
    rows = ensemble.dwt_energies(rows, config.wavelet, level)
    details = [f"e{k}" for k in range(level)]
    flat = cut_lineage(rows.select(
        *CHANNEL, "w", *DETECTOR_FEATURES, "dtw", "dfa", *[F.get("detail_energies", k).alias(e) for k, e in enumerate(details)]
    ))
    z = robust.robust_z(
        flat, CHANNEL, [*DETECTOR_FEATURES, "dtw", "dfa", *details], two_sided={"dfa"}, missing=0.0, max_group_rows=max_windows
    )
    strongest = F.greatest(*[f"{e}_z" for e in details]) if level > 1 else F.col("e0_z")
    return z.select(
        *CHANNEL, "w", top_mean(F.array(*[f"{f}_z" for f in DETECTOR_FEATURES]), 2).alias("time_domain"),
        F.col("dtw_z").alias("dtw"), F.col("dfa_z").alias("dfa"), strongest.alias("dwt"),
    )


def combine(method_scores: DataFrame, threshold_mad: float, max_windows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Method z, ensemble score (mean of the three strongest) and thresholds."""
    z = cut_lineage(
        robust.robust_z(method_scores, [*REC, "method"], ["score"], missing=0.0, max_group_rows=max_windows)
        .select(*REC, "w", "method", F.col("score_z").alias("z"))
    )
    scores = cut_lineage(z.groupBy(*REC, "w").agg(top_mean(F.collect_list("z"), 3).alias("score")))
    return z, scores, robust.global_threshold(scores, threshold_mad, fallback="largest", max_group_rows=max_windows)


def ensemble_detect(
    samples: DataFrame, sfreq: float, config: EnsembleConfig = EnsembleConfig(),
    bands: dict[str, tuple[float, float]] | None = None, block: int = 8192,
) -> Ensemble:
    """Samples in microvolts of recordings with one sampling rate."""
    window, step = config.samples(sfreq)
    recordings = cut_lineage(recordings_of(summarise(samples)).where(F.col("n_samples") >= window))
    longest = int(recordings.agg(F.max("n_samples")).first()[0] or 0)
    max_windows = max(0, (longest - window) // step + 1)
    margin = round(max(4.0, config.window_seconds) * sfreq)

    profiles = cut_lineage(window_profiles(window_blocks(samples, window, step, block), window, step, config.wave_points))
    methods = cut_lineage(channel_methods(profiles, config, max_windows))
    names = ["time_domain", "dtw", "dfa", "dwt"]
    tall = methods.select(*CHANNEL, "w", F.explode(F.create_map(*[p for m in names for p in (F.lit(m), F.col(m))])).alias("method", "score"))
    consensus = robust.channel_consensus(tall, config.channel_fraction, [*REC, "w", "method"])

    lengths = samples.join(recordings.select(*REC, "n_samples"), REC)
    order = spectral.kuramoto_order(lengths, sfreq, window, step, F.lit(longest), max(block, margin), margin, bands)
    # Windows past the end of shorter recordings are not complete.
    order = order.join(recordings.select(*REC, "n_samples"), REC).where(F.col("w") * step + window <= F.col("n_samples")).drop("n_samples")
    rhythm = robust.robust_z(order, [*REC, "band"], ["order"], two_sided=True, missing=0.0, max_group_rows=max_windows)
    synchrony = rhythm.groupBy(*REC, "w").agg(F.max("order_z").alias("score")).withColumn("method", F.lit("kuramoto"))

    z, scores, thresholds = combine(consensus.unionByName(synchrony), config.threshold_mad, max_windows)
    review = methods.select(*CHANNEL, "w", ((F.col("time_domain") + F.col("dtw") + F.col("dfa") + F.col("dwt")) / 4).alias("score"))
    found = events.ensemble_events(
        scores, thresholds, review, z, recordings.select(*REC, "n_channels"), config.channel_fraction,
        math.floor(config.merge_gap_seconds / config.step_seconds), step, window, sfreq, recordings.select(*REC, "n_samples"),
    )
    return Ensemble(found, scores, thresholds, z, review, recordings)


class Comparison(NamedTuple):
    ensemble: Ensemble
    comparable: DataFrame
    distance: DataFrame
    at_known: DataFrame
    roles: DataFrame
    share: DataFrame


def blind_vs_targeted(
    samples: DataFrame, context: DataFrame, sfreq: float, config: EnsembleConfig = EnsembleConfig(),
    recruiting: RecruitmentConfig = RecruitmentConfig(analysis_seconds=10.0), bands=None, block: int = 8192, reach: float = 300.0,
) -> Comparison:
    """What the blind ensemble says about a known event, next to the targeted band analysis."""
    _, step = config.samples(sfreq)
    blind = ensemble_detect(samples, sfreq, config, bands, block)
    score = blind.scores
    known = (
        score.join(context.select(*REC, "time_s"), REC)
        .withColumn("_gap", F.abs(F.col("w") * step / F.lit(float(sfreq)) - F.col("time_s")))
        .groupBy(*REC).agg(F.min_by("w", F.struct("_gap", "w")).alias("w"))
    )
    methods = blind.method_z.select(*REC, "w", "method", F.col("z").alias("score")).unionByName(
        score.select(*REC, "w", F.lit("ensemble (combined)").alias("method"), "score")
    )
    roles = recruit.assign_roles(recruit.recruitment(band_z(samples, context, sfreq, recruiting), recruiting.analysis_seconds))
    return Comparison(
        blind, events.comparable_windows(score, context, step, sfreq, reach=reach),
        events.distance_report(score, blind.events, context, step, sfreq), events.score_at(methods, known), roles,
        recruit.involved_share(roles),
    )
