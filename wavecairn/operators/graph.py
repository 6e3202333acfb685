"""Correlation graphs between channels and diffusion on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavecairn.functions.arrays import array_mean
from wavecairn.operators.robust import pearson
from wavecairn.operators.sequences import nearest
from wavecairn.session import cut_lineage

REC = ["recording_id"]
HUB = "PEAK"
# Channels per tile: a task holds two tiles of vectors, whatever the number of channels.
TILE = 128
# Correlations equal to this many digits count as tied; ties go to the lower channel index.
TIE_DIGITS = 9


def correlation_links(
    vectors: DataFrame, by: list[str], threshold: float, n_channels: int, strongest: int | None = None, tile: int = TILE,
    prepare: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Directed rows (channel, other, r) with abs(r) >= threshold; undefined correlations count as 0.

    ``vectors``: by + channel, ch_index, x (equally long arrays inside a group). Channels are cut
    into tiles and every pair of tiles is one matrix product. With ``strongest`` each tile keeps
    that many links per channel, which contains the overall strongest ones, so pairs that cannot
    survive pruning never leave the task. ``prepare`` makes the vectors out of the arrays ``x`` inside the task,
    so that the arrays are shuffled where they are smaller.
    """
    tiles = max(1, -(-n_channels // tile))
    own = F.floor(F.col("ch_index") / tile).cast("int")
    if tiles == 1:
        homes = F.array(F.struct(F.lit(0).alias("ta"), F.lit(0).alias("tb")))
    else:
        homes = F.transform(
            F.sequence(F.lit(0), F.lit(tiles - 1)),
            lambda q: F.struct(F.least(own, q).alias("ta"), F.greatest(own, q).alias("tb")),
        )
    placed = vectors.select(*by, "channel", "ch_index", "x", F.explode(homes).alias("_home")).select(
        *by, "channel", "ch_index", "x", "_home.ta", "_home.tb"
    )

    members = placed.groupBy(*by, "ta", "tb").agg(
        F.sort_array(F.collect_list(F.struct("ch_index", "channel", "x"))).alias("_m")
    )
    outputs = [("channel", T.StringType()), ("ch_index", T.IntegerType()), ("other", T.StringType()),
               ("other_index", T.IntegerType()), ("r", T.DoubleType())]
    schema = T.StructType([members.schema[k] for k in by] + [T.StructField(n, t) for n, t in outputs])
    arrow = to_arrow_schema(schema)

    def link(batches):
        for batch in batches:
            tall = batch.column(batch.schema.get_field_index("_m"))
            rows, index, name = tall.offsets.to_numpy(), tall.values.field("ch_index").to_numpy(), tall.values.field("channel")
            vectors, starts = tall.values.field("x").values.to_numpy(zero_copy_only=False), tall.values.field("x").offsets.to_numpy()
            ta, tb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("ta", "tb"))
            found = []
            # Prepared at once where all arrays of the batch are equally long, else group by group.
            lengths = np.diff(starts)
            ready = prepare(vectors[starts[0] : starts[-1]].reshape(len(lengths), -1)) if prepare and len(set(lengths)) == 1 else None
            for k in range(batch.num_rows):
                a, b = rows[k], rows[k + 1]
                if ready is None:
                    held = vectors[starts[a] : starts[b]].reshape(b - a, -1)
                    held = prepare(held) if prepare else held
                else:
                    held = ready[a - rows[0] : b - rows[0]]
                unit = _unit_rows(held)
                home = index[a:b] // tile
                left, right = np.flatnonzero(home == ta[k]), np.flatnonzero(home == tb[k])
                r = np.clip(unit[left] @ unit[right].T, -1.0, 1.0)
                sides = [(left, right, r)] if ta[k] == tb[k] else [(left, right, r), (right, left, r.T)]
                for p, q, m in sides:
                    i, j = _strong_pairs(m, index[a + p], index[a + q], threshold, strongest)
                    found.append((np.full(len(i), k), a + p[i], a + q[j], m[i, j]))
            which, one, two, value = (np.concatenate(c) for c in zip(*found))
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(which)) for c in by]
            columns += [name.take(pa.array(one)), pa.array(index[one]), name.take(pa.array(two)), pa.array(index[two]), pa.array(value)]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(n).type) for n, c in enumerate(columns)], schema=arrow)

    return members.mapInArrow(link, schema)


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    """Centred rows of length one; rows without variation become zero."""
    centred = rows - rows.mean(axis=1, keepdims=True)
    norm = np.sqrt((centred * centred).sum(axis=1, keepdims=True))
    return np.divide(centred, norm, out=np.zeros_like(centred), where=norm > 1e-12)


def _strong_pairs(r, index_a, index_b, threshold: float, strongest: int | None) -> tuple[np.ndarray, np.ndarray]:
    size = np.where(index_a[:, None] == index_b[None, :], -1.0, np.abs(r))
    keep = size >= threshold
    if strongest is not None and strongest < size.shape[1]:
        order = np.argsort(-size.round(TIE_DIGITS), axis=1, kind="stable")[:, :strongest]
        first = np.zeros(size.shape, dtype=bool)
        np.put_along_axis(first, order, True, axis=1)
        keep &= first
    return np.nonzero(keep)


def prune_edges(links: DataFrame, by: list[str], top_k: int) -> DataFrame:
    """Undirected edges: every channel names its ``top_k`` strongest links, either end suffices."""
    spec = Window.partitionBy(*by, "ch_index").orderBy(F.desc(F.round(F.abs("r"), TIE_DIGITS)), "other_index")
    named = links.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") <= top_k)
    forward = F.col("ch_index") < F.col("other_index")
    # r is averaged over the two directions only where both were named; they are equal.
    return named.select(
        *by,
        F.when(forward, F.col("channel")).otherwise(F.col("other")).alias("src"),
        F.when(forward, F.col("other")).otherwise(F.col("channel")).alias("dst"),
        F.least("ch_index", "other_index").alias("src_index"), F.greatest("ch_index", "other_index").alias("dst_index"),
        "r",
    ).groupBy(*by, "src", "dst", "src_index", "dst_index").agg(F.first("r").alias("weight"))


def correlation_graph(
    vectors: DataFrame, by: list[str], threshold: float, top_k: int, n_channels: int, prepare: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    return prune_edges(correlation_links(vectors, by, threshold, n_channels, top_k, prepare=prepare), by, top_k)


def series_vectors(z: DataFrame, by: list[str] | None = None, value: str = "z") -> DataFrame:
    """One array per channel of a bounded event context, ordered by window."""
    by = by or REC
    return z.groupBy(*by, "channel", "ch_index").agg(
        F.sort_array(F.collect_list(F.struct("w", F.col(value).alias("_v"))))["_v"].alias("x")
    )


def recruitment_edges(roles: DataFrame) -> DataFrame:
    """Hub to recruited channel, heavier for earlier recruitment."""
    return roles.where(F.col("latency").isNotNull()).select(
        *REC, F.lit(HUB).alias("src"), F.col("channel").alias("dst"), F.lit("recruitment").alias("kind"),
        (1.0 / (1.0 + F.col("latency"))).alias("weight"),
    )


def graph_nodes(roles: DataFrame) -> DataFrame:
    return roles.where(F.col("latency").isNotNull()).select(
        *REC, "channel", "ch_index", "latency", "peak_z", (F.coalesce(F.col("role"), F.lit("")) == "initiator").alias("is_initiator")
    )


def window_nodes(features: DataFrame, context: DataFrame, sfreq: float, window: int, known_channels: Column) -> DataFrame:
    """A node for each channel and tumbling window: its band energies and statistics as one array, and its flags.

    ``context`` has the known event of a recording; recordings without one have no known window.
    """
    at = context.select(*REC, F.floor(F.floor(F.col("time_s") * sfreq) / window).cast("bigint").alias("_at"))
    joined = features.join(at, REC, "left")
    return joined.select(
        *REC, "w", "channel", "ch_index", F.concat("energies", "stats").alias("features"),
        F.coalesce(known_channels, F.lit(False)).alias("known_channel"), F.coalesce(F.col("w") == F.col("_at"), F.lit(False)).alias("known_event"),
    )


def graph_counts(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or REC
    n = nodes.groupBy(*by).agg(F.count("*").alias("nodes"))
    return n.join(edges.groupBy(*by).agg(F.count("*").alias("edges")), by, "left").withColumn(
        "edges", F.coalesce("edges", F.lit(0))
    )


def detail_energy_score(features: DataFrame, chosen: Column, first: int = 2, count: int | None = None) -> DataFrame:
    """Mean detail log energy per window over the chosen channels; ``energies`` starts with A."""
    details = F.slice("energies", F.lit(first), F.lit(count) if count else F.size("energies") - (first - 1))
    per_channel = features.where(chosen).select(*REC, "w", array_mean(details).alias("e"))
    return per_channel.groupBy(*REC, "w").agg(F.avg("e").alias("score"))


def channel_score_corr(features: DataFrame, score: DataFrame, exclude: str | None = None) -> DataFrame:
    """Correlation over windows of each channel's mean detail energy with the event score."""
    details = array_mean(F.slice("energies", F.lit(2), F.size("energies") - 1))
    series = features.select(*REC, "w", "channel", "ch_index", details.alias("e"))
    if exclude:
        series = series.where(~F.trim("channel").rlike(exclude))
    return series.join(score, [*REC, "w"]).groupBy(*REC, "channel", "ch_index").agg(
        pearson(F.col("e"), F.col("score")).alias("correlation")
    )


def extremes(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k highest and k lowest channels of every recording."""
    rec = Window.partitionBy(*REC)
    ranked = rows.where(F.col(column).isNotNull()).select(
        "*", F.row_number().over(rec.orderBy(F.desc(column), "ch_index")).alias("top"),
        F.row_number().over(rec.orderBy(F.asc(column), F.desc("ch_index"))).alias("bottom"),
    )
    return ranked.where((F.col("top") <= k) | (F.col("bottom") <= k))


def transition_weights(edges: DataFrame, nodes: DataFrame, alpha: float | None = None) -> DataFrame:
    """Degree-normalised absolute weights in both directions; with ``alpha`` the rows of one
    diffusion step, self loops included. Isolated channels keep only the self loop."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = edges.select(*REC, F.abs("weight").alias("m"), F.explode(ends).alias("e")).select(*REC, "e.src", "e.dst", "m")
    total = F.sum("m").over(Window.partitionBy(*REC, "src"))
    rows = both.withColumn("p", F.try_divide(F.col("m"), total)).where(F.col("p").isNotNull()).select(*REC, "src", "dst", "p")
    if alpha is None:
        return rows
    loops = nodes.select(*REC, F.col("channel").alias("src"), F.col("channel").alias("dst"), F.lit(float(alpha)).alias("p"))
    return rows.withColumn("p", (1 - alpha) * F.col("p")).unionByName(loops)


def diffuse(nodes: DataFrame, edges: DataFrame, steps: int = 6, alpha: float = 0.5) -> DataFrame:
    """States of the linear diffusion seeded with peak z: recording_id, channel, step, h.

    One join and one sum per step; each row carries its history, so the chain is used once. The
    step weights are used in every round and are written out once.
    """
    moves = cut_lineage(transition_weights(edges, nodes, alpha))
    state = nodes.select(*REC, "channel", F.array(F.col("peak_z")).alias("h"))
    for _ in range(steps):
        source = state.select(*REC, F.col("channel").alias("dst"), "h")
        state = (
            moves.join(source, [*REC, "dst"])
            .groupBy(*REC, F.col("src").alias("channel"))
            .agg(
                F.sum(F.col("p") * F.element_at("h", -1)).alias("_next"),
                F.max(F.when(F.col("src") == F.col("dst"), F.col("h"))).alias("_past"),
            )
            .select(*REC, "channel", F.concat("_past", F.array("_next")).alias("h"))
        )
    return state.select(*REC, "channel", F.posexplode("h").alias("step", "h"))


def evaluate_diffusion(states: DataFrame, z: DataFrame, steps: int, analysis: float) -> DataFrame:
    """Per step, correlation over channels between the simulated state and the nearest measured window."""
    per_step = analysis / max(steps, 1)
    times = z.select(*REC, "t", "time_s").distinct()
    wanted = times.select(*REC, "time_s").distinct().select(
        *REC, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "time_s"
    ).withColumn("key_t", F.col("time_s") + F.col("step") * per_step)
    found = nearest(wanted, times, REC, "key_t", "t", 60.0, "step")
    measured = z.join(found.select(*REC, "step", F.col("nearest_time").alias("t")), [*REC, "t"])
    pairs = states.join(measured.select(*REC, "channel", "step", "z"), [*REC, "channel", "step"])
    flat = (F.stddev_pop("h") < 1e-12) | (F.stddev_pop("z") < 1e-12)
    return pairs.groupBy(*REC, "step").agg(
        F.when(~flat, pearson(F.col("h"), F.col("z"))).alias("correlation")
    ).withColumn("elapsed_s", F.col("step") * per_step)
