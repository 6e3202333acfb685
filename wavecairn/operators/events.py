"""Event formation, ranking and event-time resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecairn.functions.names import CLUSTER_GAP_SECONDS, KEYWORDS, mentions
from wavecairn.operators.sequences import islands
from wavecairn.session import cut_lineage

REC = ["recording_id"]
SEGMENT_WINDOWS = 100_000
TIERS = {"explicit": 0, "annotation": 1, "blind": 2}


def merge_by_gap(flagged: DataFrame, step: int, sfreq: float, max_gap_seconds: float, by: list[str] | None = None) -> DataFrame:
    """Consecutive flagged windows join while their starts are at most ``max_gap_seconds`` apart."""
    close = lambda prev, cur: (cur - prev) * F.lit(step) / F.lit(float(sfreq)) <= max_gap_seconds
    return islands(flagged, by or REC, "w", close, SEGMENT_WINDOWS)


def merge_by_index(flagged: DataFrame, max_gap: int, by: list[str] | None = None) -> DataFrame:
    """Join while the window numbers differ by at most ``max_gap`` + 1."""
    return islands(flagged, by or REC, "w", lambda prev, cur: cur - prev <= max_gap + 1, SEGMENT_WINDOWS)


def _at_peaks(runs: DataFrame, channel_scores: DataFrame) -> DataFrame:
    """Channel scores ``_cs`` at the peaks of runs. Runs are few per recording: rows meet them by recording and window,
    arrays of a channel (w, consecutive, and score) by recording, and only the scores at the peaks leave them."""
    if not isinstance(channel_scores.schema["w"].dataType, T.ArrayType):
        at_peak = channel_scores.select(*REC, F.col("w").alias("peak_w"), "ch_index", "channel", F.col("score").alias("_cs"))
        return runs.join(at_peak, [*REC, "peak_w"])
    peaks = runs.groupBy(*REC).agg(F.collect_list(F.struct("first_w", "peak_w", "used_threshold")).alias("_p"))
    held = channel_scores.where(F.size("w") > 0).select(*REC, "ch_index", "channel", F.get("w", F.lit(0)).alias("_w0"), "score")
    found = F.transform("_p", lambda p: F.struct(
        p["first_w"].alias("first_w"), p["used_threshold"].alias("used_threshold"), F.get("score", (p["peak_w"] - F.col("_w0")).cast("int")).alias("_cs")))
    return held.join(peaks, REC).select(*REC, "ch_index", "channel", F.inline(found))


def verify_events(
    grouped: DataFrame, channel_scores: DataFrame, limits: DataFrame, n_channels: DataFrame,
    step: int, sfreq: float, window_seconds: float, min_involved: int,
) -> DataFrame:
    """One row per accepted run: peak = earliest best window, channels above max(3, threshold) there.

    ``channel_scores`` are rows, or arrays by channel.
    """
    runs = grouped.groupBy(*REC, "island").agg(
        F.min("w").alias("first_w"), F.max("w").alias("last_w"),
        F.max(F.struct("score", (-F.col("w")).alias("_neg"))).alias("_best"),
        F.count("*").alias("candidate_windows"),
    ).select(*REC, "first_w", "last_w", "candidate_windows", F.col("_best.score").alias("score"),
             (-F.col("_best._neg")).alias("peak_w"))
    runs = runs.join(limits.select(*REC, "used_threshold", "score_center", "score_scale"), REC)
    involved = (
        _at_peaks(runs, channel_scores)
        .where(F.col("_cs") >= F.greatest(F.lit(3.0), F.col("used_threshold")))
        .groupBy(*REC, "first_w")
        .agg(F.sort_array(F.collect_list(F.struct("ch_index", "channel")))["channel"].alias("involved_channels"))
    )
    strength = F.greatest(F.lit(0.0), (F.col("score") - F.col("score_center")) / F.col("score_scale"))
    seconds = lambda c: F.col(c) * step / F.lit(float(sfreq))
    empty = F.array().cast("array<string>")
    return (
        runs.join(involved, [*REC, "first_w"], "left")
        .join(n_channels.select(*REC, "n_channels"), REC)
        .withColumn("involved_channels", F.coalesce("involved_channels", empty))
        .withColumn("involved_count", F.size("involved_channels"))
        .where(F.col("involved_count") >= F.least(F.lit(min_involved), F.col("n_channels")))
        .select(
            *REC, seconds("first_w").alias("start_s"), (seconds("last_w") + window_seconds).alias("end_s"),
            seconds("peak_w").alias("peak_s"), "score",
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (strength - 3.0) / 7.0)).alias("confidence"),
            "involved_channels", strength.alias("robust_sigma"), "candidate_windows", "involved_count",
        )
    )


def ranked(events: DataFrame, column: str = "score") -> DataFrame:
    """Rank 1 is the best score; ties go to the earlier start. Events of one recording only."""
    spec = Window.partitionBy(*REC).orderBy(F.desc(column), "start_s")
    return events.withColumn("rank", F.row_number().over(spec))


def top_rows(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group in the given order; Spark prunes to k rows per group before
    the shuffle."""
    spec = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(spec)).where(F.col("rank") <= k)


def ensemble_events(
    scores: DataFrame, thresholds: DataFrame, channel_scores: DataFrame, method_z: DataFrame,
    n_channels: DataFrame, fraction: float, max_gap: int, step: int, window: int, sfreq: float,
    n_samples: DataFrame, top_methods: int = 3,
) -> DataFrame:
    """Runs of flagged windows with their peak over all covered windows, strongest channels and
    methods; a recording without any flagged window returns its maximum with detected = false."""
    rated = scores.join(thresholds.select(*REC, "threshold"), REC)
    flagged = rated.where(F.col("score") >= F.col("threshold"))
    # Windows inside a run but below the threshold cannot beat a flagged one, so the flagged windows
    # of the run decide its peak over all covered windows.
    best = F.max(F.struct("score", (-F.col("w")).alias("_neg")))
    found = merge_by_index(flagged.select(*REC, "w", "score"), max_gap).groupBy(*REC, "island").agg(
        F.min("w").alias("first_w"), F.max("w").alias("last_w"), best.alias("_best")
    ).drop("island").withColumn("detected", F.lit(True))
    whole = (
        rated.join(flagged.select(*REC).distinct(), REC, "left_anti")
        .groupBy(*REC).agg(best.alias("_best"))
        .withColumn("first_w", -F.col("_best._neg")).withColumn("last_w", F.col("first_w"))
        .withColumn("detected", F.lit(False))
    )
    rows = cut_lineage(found.unionByName(whole).select(
        *REC, "first_w", "last_w", "detected", F.col("_best.score").alias("peak_score"),
        (-F.col("_best._neg")).alias("peak_w"),
    ))
    spec = Window.partitionBy(*REC, "first_w")
    tops = (
        rows.select(*REC, "first_w", "peak_w").join(channel_scores.withColumnRenamed("w", "peak_w"), [*REC, "peak_w"])
        .join(n_channels, REC)
        .withColumn("_r", F.row_number().over(spec.orderBy(F.desc("score"), F.desc("ch_index"))))
        .where(F.col("_r") <= F.greatest(F.lit(1.0), F.ceil(F.col("n_channels") * F.lit(float(fraction)))))
        .groupBy(*REC, "first_w")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("_r", "channel")))["channel"], ", ").alias("top_channels"))
    )
    methods = (
        rows.select(*REC, "first_w", "peak_w").join(method_z.withColumnRenamed("w", "peak_w"), [*REC, "peak_w"])
        .withColumn("_r", F.row_number().over(spec.orderBy(F.desc("z"), F.desc("method"))))
        .where(F.col("_r") <= top_methods)
        .groupBy(*REC, "first_w")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("_r", "method")))["method"], ", ").alias("dominant_methods"))
    )
    rate = F.lit(float(sfreq))
    end = F.least(F.col("last_w") * step + window, F.col("n_samples")) / rate
    joined = (
        rows.join(tops, [*REC, "first_w"], "left").join(methods, [*REC, "first_w"], "left").join(n_samples, REC)
        .select(
            *REC, "detected", (F.col("first_w") * step / rate).alias("start_s"), end.alias("end_s"),
            (end - F.col("first_w") * step / rate).alias("duration_s"),
            (F.col("peak_w") * step / rate).alias("peak_time_s"), "peak_score", "dominant_methods", "top_channels", "peak_w",
        )
    )
    return ranked(joined, "peak_score")


def _annotation_runs(annotations: DataFrame, match: Column, gap: float, span: float | None) -> DataFrame:
    return islands(
        annotations.withColumn("_match", match), REC, "onset", lambda prev, cur: cur - prev <= gap,
        span or 1000.0 * gap, ties=["description"],
    )


def cluster_annotations(
    annotations: DataFrame, keywords=KEYWORDS, gap: float = CLUSTER_GAP_SECONDS,
    minimum_duration: float = 0.1, span: float | None = None,
) -> DataFrame:
    """First annotation cluster per recording that holds a keyword match; its earliest match gives
    time and label. Clusters break at gaps longer than ``gap`` seconds. Two sums, no lists: the
    members are rows of ``cluster_members``."""
    grouped = _annotation_runs(annotations, mentions(F.col("description"), keywords), gap, span)
    clusters = grouped.groupBy(*REC, "island").agg(
        F.min("onset").alias("_first"), F.max("onset").alias("_last"), F.count("*").alias("_n"),
        F.min(F.when(F.col("_match"), F.struct("onset", "description"))).alias("_anchor"),
    ).where(F.col("_anchor").isNotNull())
    first = clusters.groupBy(*REC).agg(F.min(F.struct("island", "_last", "_n", "_anchor")).alias("c"))
    return first.select(
        *REC, F.col("c._anchor.onset").alias("time_s"), F.col("c._anchor.description").alias("label"),
        F.greatest(F.col("c._last") - F.col("c.island"), F.lit(minimum_duration)).alias("duration_s"),
        F.col("c._n").alias("member_count"), F.col("c.island").alias("cluster_start"), F.col("c._last").alias("cluster_end"),
    )


def cluster_members(annotations: DataFrame, clusters: DataFrame) -> DataFrame:
    """The annotations of the chosen clusters, one row each."""
    bounds = clusters.select(*REC, "cluster_start", "cluster_end")
    return annotations.join(bounds, REC).where(F.col("onset").between(F.col("cluster_start"), F.col("cluster_end"))).drop(
        "cluster_start", "cluster_end"
    )


def select_event(events: DataFrame) -> DataFrame:
    """Widest, then longest, then strongest candidate of every recording."""
    duration = F.col("end_s") - F.col("start_s")
    best = F.max_by(
        F.struct("peak_s", duration.alias("d"), "involved_count", "score", "confidence"),
        F.struct("involved_count", duration.alias("d"), "score", (-F.col("peak_s")).alias("_tie")),
    )
    return events.groupBy(*REC).agg(best.alias("b")).select(
        *REC, F.col("b.peak_s").alias("time_s"),
        F.lit("data-detected extreme event (ranked by channel spread, then duration, then score)").alias("label"),
        F.greatest(F.col("b.d"), F.lit(0.1)).alias("duration_s"), F.col("b.involved_count").alias("involved_count"),
        F.col("b.score").alias("score"), F.col("b.confidence").alias("confidence"),
    )


def resolve_event(explicit: DataFrame, annotated: DataFrame, blind: DataFrame) -> DataFrame:
    """One event per recording: explicit before annotation before blind, the earliest of several of a tier."""
    columns = [*REC, "time_s", "label", "duration_s"]
    tiers = zip(TIERS.items(), (explicit, annotated, blind))
    parts = [
        t.select(*columns, F.lit(name).alias("tier"), F.lit(order).alias("_order")) for (name, order), t in tiers
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = union.groupBy(*REC).agg(F.min_by(F.struct("tier", *columns[1:]), F.struct("_order", "time_s", "label", "duration_s")).alias("e"))
    return first.select(*REC, "e.*")


def needs_blind(recordings: DataFrame, explicit: DataFrame, annotated: DataFrame) -> DataFrame:
    """Recordings that only the blind detector can resolve."""
    return recordings.join(explicit.select(*REC), REC, "left_anti").join(annotated.select(*REC), REC, "left_anti")


def distance_report(scores: DataFrame, events: DataFrame, context: DataFrame, step: int, sfreq: float) -> DataFrame:
    """Blind maximum against the known time, and how many candidates there are."""
    top = scores.groupBy(*REC).agg(F.max(F.struct("score", (-F.col("w")).alias("_neg"))).alias("b"))
    count = events.groupBy(*REC).agg(F.count("*").alias("candidates"))
    at = -F.col("b._neg") * step / F.lit(float(sfreq))
    return (
        top.join(context.select(*REC, "time_s"), REC).join(count, REC, "left")
        .select(*REC, at.alias("blind_time_s"), F.col("b.score").alias("blind_score"), "time_s",
                F.abs(at - F.col("time_s")).alias("distance_s"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    )


def score_at(scores: DataFrame, known: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Value, percentile and rank of the known window for every method.

    scores: recording_id, w, method, score; known: recording_id, w. One conditional aggregate.
    """
    here = scores.join(known.select(*REC, "w"), [*REC, "w"]).select(*REC, "method", F.col("score").alias("known_score"), F.col("w").alias("known_w"))
    joined = scores.join(here, [*REC, "method"])
    report = joined.groupBy(*REC, "method", "known_w", "known_score").agg(
        (100.0 * F.avg((F.col("score") <= F.col("known_score")).cast("double"))).alias("percentile"),
        (F.count_if(F.col("score") > F.col("known_score")) + 1).alias("rank"),
        F.count("*").alias("windows"),
    )
    if thresholds is not None:
        report = report.join(thresholds.select(*REC, "threshold"), REC).withColumn(
            "above", F.col("known_score") >= F.col("threshold")
        ).drop("threshold")
    return report


def comparable_windows(
    scores: DataFrame, context: DataFrame, step: int, sfreq: float, share: float = 0.8, reach: float = 300.0
) -> DataFrame:
    """Windows within ``share`` of the maximum: how many, over what span, all near the event or not."""
    limits = scores.groupBy(*REC).agg((share * F.max("score")).alias("limit"), F.count("*").alias("windows"))
    t = F.col("w") * step / F.lit(float(sfreq))
    return (
        scores.join(limits, REC).join(context.select(*REC, "time_s"), REC)
        .where(F.col("score") >= F.col("limit"))
        .groupBy(*REC)
        .agg(
            F.count("*").alias("comparable"), (100.0 * F.count("*") / F.first("windows")).alias("share_percent"),
            (F.max(t) - F.min(t)).alias("span_s"), F.min(t).alias("first_s"), F.max(t).alias("last_s"),
            F.bool_and(F.abs(t - F.col("time_s")) <= reach).alias("_near"),
        )
        .withColumn("concentrated", F.col("_near") & (F.col("span_s") <= reach))
        .drop("_near")
    )


def run_notes(recordings: DataFrame, events: DataFrame, context: DataFrame, montage: str) -> DataFrame:
    """One line per recording: candidates and how its event was resolved.

    ``context`` has tier, time_s, label and, for the blind tier, involved_count and score.
    """
    for name, kind in (("involved_count", "int"), ("score", "double")):
        if name not in context.columns:
            context = context.withColumn(name, F.lit(None).cast(kind))
    counts = events.groupBy(*REC).agg(F.count("*").alias("n"))
    note = (
        F.when(F.col("tier") == "explicit", F.format_string("clinical event at %.3fs", "time_s"))
        .when(F.col("tier") == "annotation", F.format_string("EDF-annotated event at %.3fs ('%s')", "time_s", "label"))
        .when(F.col("tier") == "blind",
              F.format_string("auto-detected event at %.3fs (%d channels, score=%.2f)", "time_s", "involved_count", "score"))
        .otherwise("no event context")
    )
    return recordings.select(*REC).join(counts, REC, "left").join(context, REC, "left").select(
        *REC,
        F.format_string(f"%s [{montage}]: %d candidate(s); %s", "recording_id", F.coalesce("n", F.lit(0)), note).alias("note"),
    )
