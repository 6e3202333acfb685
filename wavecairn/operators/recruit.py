"""Recruitment of channels after an event, from band-energy z scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecairn.config import RecruitmentConfig
from wavecairn.functions.names import REGION, in_region
from wavecairn.operators import panes
from wavecairn.operators.framing import CHANNEL, is_packed
from wavecairn.operators.robust import nested_z, robust_z
from wavecairn.session import cut_lineage

REC = ["recording_id"]


def event_context(samples: DataFrame, context: DataFrame, sfreq: float, baseline: float, analysis: float) -> DataFrame:
    """Samples (or arrays of them) of [t - baseline, t + analysis + 0.5], re-numbered from the context start.

    Adds time_s and context_s (start of the context). Recordings without an event drop out.
    """
    start = F.greatest(F.lit(0.0), F.col("time_s") - baseline)
    bounds = context.select(
        *REC, "time_s", start.alias("context_s"),
        F.floor(start * sfreq).cast("bigint").alias("_from"),
        F.ceil((F.col("time_s") + analysis + 0.5) * sfreq).cast("bigint").alias("_to"),
    )
    if is_packed(samples):
        begin, end = F.greatest("i0", "_from"), F.least(F.col("i0") + F.size("v"), F.col("_to"))
        part = F.slice("v", (begin - F.col("i0") + 1).cast("int"), (end - begin).cast("int"))
        return samples.join(bounds, REC).where(begin < end).select(*CHANNEL, (begin - F.col("_from")).alias("i0"), part.alias("v"), "time_s", "context_s")
    return (
        samples.join(bounds, REC)
        .where((F.col("i") >= F.col("_from")) & (F.col("i") < F.col("_to")))
        .select(*CHANNEL, (F.col("i") - F.col("_from")).alias("i"), "v", "time_s", "context_s")
    )


#: Why a channel has no recruitment result; "" is none.
NO_EVENT, OUTSIDE, SHORT, NOTHING_AFTER = "no event", "event outside the recording", "insufficient baseline", "no window after the event"


def context_status(
    spans: DataFrame, context: DataFrame, window: int, step: int, sfreq: float, baseline: float, analysis: float, least: int = 4
) -> DataFrame:
    """One row for every channel of ``spans`` (lo, hi): event time, windows before and after it, and what is wrong.

    Follows from lengths alone, before a sample is read: which windows of the context are complete in the
    channel, and which of their centres lie in the baseline or in the analysis span.
    """
    rate = F.lit(float(sfreq))
    start = F.greatest(F.lit(0.0), F.col("time_s") - baseline)
    begin, end = F.floor(start * rate), F.ceil((F.col("time_s") + analysis + 0.5) * rate)
    last_sample = F.least(F.col("hi"), end - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("lo") - begin) / step))
    last = F.floor((last_sample + 1 - begin - window) / step)
    # Centres start + (w * step + window / 2) / rate: before t, and from t to t + analysis.
    place = lambda t: ((t - start) * rate - window / 2) / step
    below = F.ceil(place(F.col("time_s"))) - 1
    upto = F.floor(place(F.col("time_s") + analysis))
    count = lambda a, b: F.when(F.col("time_s").isNotNull(), F.greatest(F.lit(0), b - a + 1)).cast("bigint")
    outside = (F.col("time_s") < 0) | (F.col("time_s") > F.col("hi") / rate)
    joined = spans.join(context.select(*REC, "time_s"), REC, "left").withColumns({
        "baseline_windows": F.coalesce(count(first, F.least(last, below)), F.lit(0)),
        "analysis_windows": F.coalesce(count(F.greatest(first, below + 1), F.least(last, upto)), F.lit(0)),
    })
    status = F.when(F.col("time_s").isNull(), NO_EVENT).when(outside, OUTSIDE).when(F.col("baseline_windows") < least, SHORT).when(F.col("analysis_windows") < 1, NOTHING_AFTER).otherwise("")
    return joined.select(*CHANNEL, "time_s", "baseline_windows", "analysis_windows", status.alias("status"))


def energy_z(filtered: DataFrame, window: int, step: int, sfreq: float, baseline: float, max_rows: int | None = None) -> DataFrame:
    """Window energies of a filtered context, standardised against the pre-event windows.

    Windows are labelled by their centre. Recordings with fewer than 4 baseline windows drop out.
    """
    keys = [*CHANNEL, "time_s", "context_s"]
    # The signal is read once; lengths come from its panes.
    sums = cut_lineage(panes.pane_sums(filtered, window, step, keys).select(*keys, "pane", "n", "squares", "last_i"))
    length = sums.groupBy(*REC).agg((F.max("last_i") + 1).alias("_n"))
    blank = [F.lit(None).cast("double").alias(c) for c in ("total", "places", "place_squares", "moment", "low", "high", "first_i", "first", "last")]
    merged = panes.merge_panes(sums.join(length, REC).select("*", *blank), window, step, F.col("_n"), keys)
    return standardise_energy(labelled(merged.select(*keys, "w", panes.energy().alias("energy")), window, step, sfreq), baseline, max_rows)


def labelled(energy: DataFrame, window: int, step: int, sfreq: float) -> DataFrame:
    """Window energies with the time of the window's centre, written once: its three readers follow."""
    return cut_lineage(energy.withColumn("t", F.col("context_s") + (F.col("w") * step + window / 2) / F.lit(float(sfreq))))


def standardise_energy(energy: DataFrame, baseline: float, max_rows: int | None = None) -> DataFrame:
    """Baseline z of window energies, clipped to [0, 50]."""
    before = (F.col("t") >= F.greatest(F.lit(0.0), F.col("time_s") - baseline)) & (F.col("t") < F.col("time_s"))
    enough = energy.where(before).groupBy(*CHANNEL).agg(F.count("*").alias("_k")).where("_k >= 4").select(*CHANNEL)
    usable = energy.join(enough, CHANNEL, "left_semi")
    z = robust_z(usable, CHANNEL, ["energy"], baseline=before, clip=(0.0, 50.0), eps=1e-20, fallback="floor",
                 max_group_rows=max_rows)
    return z.select(*CHANNEL, "w", "t", "time_s", F.col("energy_z").alias("z"))


def whole_energy_z(samples: DataFrame, window: int, step: int, n_samples: int, t: Callable[[Column], Column], time_s: float, baseline: float) -> DataFrame:
    """Window energies of arrays that hold whole channels, standardised against the windows before ``time_s``.

    ``t`` gives the time of a window number. A channel's windows stay one row of arrays up to the z scores.
    """
    sums = panes.nested_sums(samples, window, step, n_samples, ("n", "squares"))
    energy = F.transform(F.arrays_zip("n", "squares"), lambda s: F.try_divide(s["squares"], s["n"]))
    timed = sums.select(*CHANNEL, "w", energy.alias("energy"), F.transform("w", t).alias("t"), F.lit(time_s).alias("time_s"))
    before = F.transform("t", lambda x: (x >= F.greatest(F.lit(0.0), F.col("time_s") - baseline)) & (x < F.col("time_s")))
    usable = timed.withColumn("before", before).where(F.size(F.filter("before", lambda b: b)) >= 4)
    z = nested_z(usable, ["energy"], "before", (0.0, 50.0), 1e-20, "floor").withColumnRenamed("energy_z", "z")
    return z.select(*CHANNEL, "time_s", F.inline(F.arrays_zip("w", "t", "z"))).select(*CHANNEL, "w", "t", "time_s", "z")


def recruitment(z: DataFrame, analysis: float, threshold: float = 6.0) -> DataFrame:
    """Peak z after the event and latency of the first window at or above the threshold."""
    after = F.col("t").between(F.col("time_s"), F.col("time_s") + analysis)
    return z.where(after).groupBy(*CHANNEL).agg(
        F.first("time_s").alias("time_s"), F.max("z").alias("peak_z"),
        (F.min(F.when(F.col("z") >= threshold, F.col("t"))) - F.first("time_s")).alias("latency"),
    )


def assign_roles(recruited: DataFrame, config: RecruitmentConfig = RecruitmentConfig(), region=REGION) -> DataFrame:
    """Role of each channel: initiator, later or neither; order of recruitment per recording.

    Window partitions hold the channels of one recording.
    """
    rec = Window.partitionBy(*REC)
    first = F.min("latency").over(rec)
    candidate = in_region(F.col("channel"), region) & (F.col("latency") <= first + config.roi_slack_seconds)
    rows = recruited.withColumn("_first", first).withColumn("_region", F.coalesce(candidate, F.lit(False)))
    rows = rows.withColumn("_any", F.max("_region").over(rec))
    early = F.coalesce(F.col("latency") <= F.col("_first") + config.first_slack_seconds, F.lit(False))
    initiator = F.when(F.col("_any"), F.col("_region")).otherwise(early)
    later = F.col("latency").isNotNull() & ~initiator & ~early
    order = F.row_number().over(rec.orderBy(F.col("latency").asc_nulls_last(), "ch_index"))
    return rows.select(
        *CHANNEL, "time_s", "peak_z", "latency",
        F.when(initiator, "initiator").when(later, "later").alias("role"),
        F.when(F.col("latency").isNotNull(), order).alias("recruit_order"),
    )


def evolution_matrix(z: DataFrame, roles: DataFrame) -> DataFrame:
    """Long heat map of the involved channels in order of latency, with the colour cap."""
    involved = roles.where(F.col("latency").isNotNull()).select(*CHANNEL, F.col("recruit_order").alias("row"))
    cells = z.join(involved, CHANNEL).select(
        *CHANNEL, "row", "w", (F.col("t") - F.col("time_s")).alias("t_rel"), "z"
    )
    cap = cells.groupBy(*REC).agg(F.greatest(F.lit(6.0), F.percentile("z", F.lit(0.99))).alias("colour_cap"))
    return cells.join(cap, REC)


def select_outputs(roles: DataFrame, variance: DataFrame, limit: int = 12) -> DataFrame:
    """Channels to model: initiators and an even sample of later ones; else involved channels;
    else the most variable ones. ``variance`` is the ranked output of ``variance_rank``."""
    rec = Window.partitionBy(*REC)
    involved = roles.where(F.col("latency").isNotNull())
    kinds = involved.select(
        *CHANNEL, "role", "recruit_order",
        F.count_if(F.col("role") == "initiator").over(rec).alias("_ni"),
        F.count_if(F.col("role") == "later").over(rec).alias("_nl"),
        F.row_number().over(Window.partitionBy(*REC, "role").orderBy("recruit_order")).alias("_k"),
        F.row_number().over(Window.partitionBy(*REC, "role").orderBy("ch_index")).alias("_c"),
        F.row_number().over(rec.orderBy("recruit_order")).alias("_all"),
    )
    budget = F.lit(limit) - F.col("_ni")
    stride = F.greatest(F.lit(1), F.floor(F.col("_nl") / F.greatest(budget, F.lit(1)))).cast("int")
    taken = (F.col("role") == "later") & (budget > 0) & ((F.col("_k") - 1) % stride == 0)
    taken = taken & ((F.col("_k") - 1) / stride < budget)
    initiator = F.col("role") == "initiator"
    nothing = (F.col("_ni") == 0) & ((F.col("_nl") == 0) | (budget <= 0))
    position = F.when(initiator, F.col("_c")).when(taken, F.col("_ni") + (F.col("_k") - 1) / stride + 1)
    position = F.coalesce(position, F.when(nothing, F.col("_all")))
    spread = kinds.withColumn("position", position.cast("int")).where(
        F.col("position").isNotNull() & (F.col("position") <= limit)
    ).select(*CHANNEL, "position", F.lit("brain_process_initiators_plus_spread").alias("method"))
    fallback = (
        variance.where(F.col("rank") <= limit).join(involved.select(*REC).distinct(), REC, "left_anti")
        .withColumn("position", F.row_number().over(rec.orderBy("ch_index")))
        .select(*CHANNEL, "position", F.lit("highest_variance_fallback").alias("method"))
    )
    return spread.unionByName(fallback)


def involved_share(roles: DataFrame) -> DataFrame:
    return roles.groupBy(*REC).agg(
        F.count("latency").alias("involved"), F.count("*").alias("channels"),
        (100.0 * F.count("latency") / F.count("*")).alias("percent"),
    )


def describe_source(roles: DataFrame, recordings: DataFrame, shown: int = 15) -> DataFrame:
    """Plain-language summary per recording; ``recordings`` gives recording_id and time_s."""
    sorted_names = lambda cond: F.sort_array(
        F.collect_list(F.when(cond, F.struct("recruit_order", "channel")))
    )["channel"]
    by_index = F.sort_array(F.collect_list(F.when(F.col("role") == "initiator", F.struct("ch_index", "channel"))))
    facts = roles.where(F.col("latency").isNotNull()).groupBy(*REC).agg(
        sorted_names(F.lit(True)).alias("names"), by_index["channel"].alias("initiators"),
        sorted_names(F.col("role") == "later").alias("later"),
        F.min("latency").alias("a"), F.max("latency").alias("b"), F.count("*").alias("n"),
    )
    rows = recordings.select(*REC, "time_s").join(facts, REC, "left")
    source = F.when(F.size("initiators") > 0, F.array_join("initiators", ", ")).otherwise(F.col("names")[0])
    head = F.format_string(
        "Reference (peak) time: %.3f s from EDF start; all latencies below are measured relative to it.", "time_s"
    )
    likely = F.format_string(
        "Likely source: %s — first channel(s) to cross the 6-MAD recruitment threshold, at %.3f s (%+.3f s relative to the reference time).",
        source, F.col("time_s") + F.col("a"), F.col("a"),
    )
    span = F.format_string(
        "Involved channels: %d total, recruited between %+.3f s and %+.3f s relative to the reference time (%s last).",
        F.col("n"), F.col("a"), F.col("b"), F.element_at("names", -1),
    )
    rest = F.when(
        F.size("later") > 0,
        F.concat(
            F.lit("Later-recruited (spread beyond the source): "),
            F.array_join(F.slice("later", 1, shown), ", "),
            F.when(F.size("later") > shown, ", ...").otherwise(""),
        ),
    )
    nothing = F.format_string(
        "No channel crossed the recruitment threshold around %.3f s: no source could be located.", "time_s"
    )
    return rows.select(
        *REC, F.when(F.col("n").isNull(), nothing).otherwise(F.concat_ws("\n", head, likely, span, rest)).alias("summary")
    )
