"""Event times in three tiers, the expensive one only where it is needed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.config import DetectorConfig
from wavecairn.operators import events
from wavecairn.plans.detect import Detection, detect
from wavecairn.session import cut_lineage

REC = ["recording_id"]


class Resolved(NamedTuple):
    context: DataFrame
    scanned: DataFrame
    blind: Detection | None


def of_recordings(samples: DataFrame, chosen: DataFrame, listed: int = 10_000) -> DataFrame:
    """The samples of the chosen recordings. Up to ``listed`` ids go into the scan as a predicate, which a source
    turns into files that are never opened; more are a semi join. The rows are the same."""
    ids = [r[0] for r in chosen.select(*REC).distinct().limit(listed + 1).collect()]
    if len(ids) <= listed:
        return samples.where(F.col("recording_id").isin(ids))
    return samples.join(chosen.select(*REC).distinct(), REC, "left_semi")


def resolve_lazily(
    samples: DataFrame, sfreq: float, recordings: DataFrame, annotations: DataFrame | None = None, explicit: DataFrame | None = None,
    detector: DetectorConfig = DetectorConfig(), strict: bool = False, listed: int = 10_000, **clustering,
) -> Resolved:
    """One event per recording of ``recordings``: explicit, else annotated, else found by the blind detector.

    Only recordings without an explicit or annotated event are scanned; if there are none, nothing is.
    ``recordings`` come from headers or any other list, never from the samples. ``clustering`` are further
    arguments of ``cluster_annotations``. Recordings in which the detector finds nothing have no row.
    """
    none = recordings.select(*REC, F.lit(None).cast("double").alias("time_s"), F.lit("").alias("label"), F.lit(None).cast("double").alias("duration_s")).limit(0)
    given = explicit if explicit is not None else none
    annotated = cut_lineage(events.cluster_annotations(annotations, **clustering)) if annotations is not None else none
    scanned = cut_lineage(events.needs_blind(recordings.select(*REC).distinct(), given, annotated))
    found = None
    if not scanned.isEmpty():
        found = detect(of_recordings(samples, scanned, listed), sfreq, detector, strict)
    blind = events.select_event(found.events) if found else none
    context = events.resolve_event(given, annotated, blind).join(recordings.select(*REC).distinct(), REC, "left_semi")
    return Resolved(cut_lineage(context), scanned, found)
