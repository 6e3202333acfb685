"""Arrays that hold whole channels give what single samples give, and no sample is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import recording_event, supplier_days, supplier_waves
from wavecairn.config import DetectorConfig
from wavecairn.operators import ensemble, events, features, graph, panes, robust
from wavecairn.operators import framing
from wavecairn.operators.framing import CHANNEL, crop, in_parts, is_whole, pack_blocks, unpack_blocks, whole
from wavecairn.plans.detect import detect
from wavecairn.plans.temporal import temporal_graph

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def same(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) > 0
    for c in b.columns:
        if a[c].dtype.kind in "fi":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9)
        else:
            assert (a[c] == b[c]).all()


@pytest.fixture(scope="module")
def uneven(spark):
    """Channels that begin late and end early, with NULL samples; one is all NULL."""
    rng = np.random.default_rng(3)
    rows = []
    for r in range(3):
        for c in range(4):
            v = [None if rng.random() < 0.15 or (r, c) == (1, 2) else float(x) for x in rng.normal(size=int(rng.integers(40, 130)))]
            rows.append((f"r{r}", f"c{c}", c, int(rng.integers(0, 60)), v))
    made = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, i0 bigint, v array<double>")
    return made.withColumn("i0", whole(F.col("i0"))).localCheckpoint()


@pytest.mark.parametrize("window, step", [(28, 7), (30, 7), (5, 9), (1, 1)])
def test_window_sums_in_place(spark, uneven, window, step):
    assert is_whole(uneven)
    got, want = (panes.window_sums(x, window, step, F.lit(150)) for x in (uneven, unpack_blocks(uneven)))
    same(got.select(*CHANNEL, "w", *panes.SUMS), want.select(*CHANNEL, "w", *panes.SUMS), [*CHANNEL, "w"])


def test_statistics_and_variance_in_place(spark, uneven):
    same(features.stat_features(uneven, 25, F.lit(150)), features.stat_features(unpack_blocks(uneven), 25, F.lit(150)), [*CHANNEL, "w"])
    same(features.variance_rank(uneven, 3), features.variance_rank(unpack_blocks(uneven), 3), CHANNEL)


def test_blocks_cut_in_place(spark, uneven):
    for block, before, after in ((16, 0, 0), (16, 5, 9), (500, 3, 3)):
        got, want = (pack_blocks(x, block, before, after) for x in (uneven, in_parts(uneven)))
        key = lambda df: {tuple(r[:4]): (r["i0"], r["own0"], r["v"]) for r in df.collect()}
        assert key(got) == key(want)
    cut = crop(uneven, 1.0, 33.0, 90.0)
    assert is_whole(cut)
    same(unpack_blocks(cut), crop(unpack_blocks(uneven), 1.0, 33.0, 90.0), [*CHANNEL, "i"])


def test_nested_scores_equal_the_grouped_ones(spark):
    rng = np.random.default_rng(5)
    rows = []
    for r in range(2):
        for c in range(7):
            first, n = int(rng.integers(0, 700)), int(rng.integers(30, 900))
            x = [float(v) for v in np.round(rng.normal(size=n), 2)]
            rows.append((f"r{r}", f"c{c}", c, list(range(first, first + n)), [float(c)] * n if c == 3 else x, [k % 3 > 0 for k in range(n)]))
    held = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, w array<bigint>, x array<double>, b array<boolean>").localCheckpoint()
    tall = held.select(*CHANNEL, F.inline(F.arrays_zip("w", "x", "b")))
    for clip, eps, fallback in (((0.0, 25.0), 1e-12, "unit"), ((0.0, 50.0), 1e-20, "floor"), (None, 1e-15, "plus"), (None, 1e-12, "largest")):
        got = robust.nested_z(held, ["x"], "b", clip, eps, fallback).select(*CHANNEL, F.inline(F.arrays_zip("w", "x_z")))
        want = robust.robust_z(tall, CHANNEL, ["x"], baseline=F.col("b"), clip=clip, eps=eps, fallback=fallback, max_group_rows=1000)
        same(got, want.select(*CHANNEL, "w", "x_z"), [*CHANNEL, "w"])
    for fraction in (0.1, 0.5, 1.0):
        got, want = robust.nested_consensus(held, fraction, "x"), robust.channel_consensus(tall, fraction, column="x")
        same(got, want, ["recording_id", "w"])


def test_detector_on_whole_channels(spark):
    config = DetectorConfig(window_seconds=28, step_seconds=7, channel_fraction=0.3, threshold_mad=4.0, merge_gap_seconds=7, min_involved_channels=2)
    got, want = (detect(x, 1.0, config) for x in (supplier_waves(spark, SF), in_parts(supplier_waves(spark, SF))))
    same(got.scores, want.scores, ["recording_id", "w"])
    same(got.features, want.features, [*CHANNEL, "w"])
    same(got.events.drop("involved_channels"), want.events.drop("involved_channels"), ["recording_id", "start_s"])


def test_peaks_meet_arrays(spark):
    """Scores at the peaks are the same out of rows and arrays, whatever window a channel begins with."""
    held = spark.createDataFrame(
        [("a", "c0", 0, [0, 1, 2], [1.0, 5.0, 2.0]), ("a", "c1", 1, [2, 3], [7.0, 8.0]), ("b", "c0", 0, [4], [9.0]), ("b", "c1", 1, [], [])],
        "recording_id string, channel string, ch_index int, w array<bigint>, score array<double>")
    runs = spark.createDataFrame([("a", 0, 1, 3.0), ("a", 2, 2, 3.0), ("b", 4, 4, 3.0)], "recording_id string, first_w bigint, peak_w bigint, used_threshold double")
    columns = ["recording_id", "first_w", "channel", "ch_index", "_cs", "used_threshold"]
    got = events._at_peaks(runs, held).where("_cs IS NOT NULL").select(*columns)
    want = events._at_peaks(runs, held.select(*CHANNEL, F.inline(F.arrays_zip("w", "score")))).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4


def test_links_out_of_waves(spark):
    """Vectors made where the channels of a window meet give the links of vectors made before; the vectors are neither written nor shuffled."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    rows = [("r", f"c{c}", c, w, [None if rng.random() < 0.02 else float(x) for x in base * (c % 3) + rng.normal(size=64)]) for c in range(6) for w in range(3)]
    waves = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, w bigint, wave array<double>").localCheckpoint()
    by = ["recording_id", "w"]
    want = graph.correlation_links(ensemble.wavelet_representation(waves, "db4", 3), by, 0.1, 6)
    got = graph.correlation_links(waves.withColumnRenamed("wave", "x"), by, 0.1, 6, prepare=lambda m: ensemble.standardised_bands(m, "db4", 3))
    same(got, want, [*by, "channel", "other"])
    found = temporal_graph(supplier_waves(spark, SF), 64, 7, F.col("channel").isin("L2"), recording_event(supplier_waves(spark, SF), 1200.0), 1.0)
    assert "energies" not in found.edges._jdf.queryExecution().executedPlan().toString()


def test_days_are_never_shuffled(spark):
    waves = supplier_waves(spark, SF)
    assert waves.count() == waves.select(*CHANNEL).distinct().count()
    same(supplier_days(spark, SF).groupBy(*CHANNEL).agg(F.count("*").alias("n")), waves.select(*CHANNEL, F.size("v").alias("n")), CHANNEL)
    # One exchange carries the lines; no join with a grid, no samples, no panes behind it.
    for df in (features.band_energy(waves, 28, 7, F.lit(2500)), features.stat_features(waves, 50, F.lit(2500)), features.window_blocks(waves, 28, 7), pack_blocks(waves, 64)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert exchanges(df) == 1 and "Join" not in plan


def test_a_gap_is_cut_out_of_each_array_in_one_pass(spark):
    """F32, F33, F35: what was read once is not read again for the places behind a gap, and no array goes into the directory of blocks."""
    arrays = supplier_waves(spark, SF)
    parts = framing.without_places(arrays, 400, 450)
    two = in_parts(framing.crop_places(arrays, 0, 400)).unionByName(in_parts(framing.crop_places(arrays, 450)))
    assert not is_whole(parts) and sorted(parts.collect()) == sorted(two.collect())
    plan = pack_blocks(parts, 8190, 0, 21)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # one a side of the exchange that both sides share
    assert "struct(end" not in plan and "min(struct(" not in plan


def test_slices_with_gaps_are_blocks_with_missing_values(spark):
    rows = [("r", "a", 0, 0, [1.0, 2.0]), ("r", "a", 0, 5, [3.0, None, 4.0]), ("r", "a", 0, 30, [5.0]), ("r", "b", 1, 13, [6.0, 7.0])]
    frame = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, i0 bigint, v array<double>")
    want = {}
    for _, c, _, i0, v in rows:
        want.setdefault(c, {}).update({i0 + k: x for k, x in enumerate(v)})
    got = pack_blocks(frame, 10, 3, 2).collect()
    assert sorted((r["channel"], r["block"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    for r in got:
        held, lo, hi = want[r["channel"]], min(want[r["channel"]]), max(want[r["channel"]])
        first, last = max(lo, r["own0"] - 3), min(hi, r["own0"] + 11)
        assert r["i0"] == first and r["v"] == [held.get(i) for i in range(first, last + 1)]


def test_whole_channels_stay_whole_under_every_reference(spark):
    """a9_comparison at 0.1 GB: every day became a row, and pairs of channels met day by day."""
    from wavecairn.operators.framing import is_whole, unpack_blocks, whole
    from wavecairn.plans import analyse
    from wavecairn.session import cut_lineage

    rows = [("r", f"EEG PM{k + 1}", k, 0, [float((k + 2) * j % 7) for j in range(9000 + k)]) for k in range(3)]
    arrays = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, i0 bigint, v array<double>").withColumn("i0", whole(F.col("i0")))
    got = cut_lineage(analyse.with_montage(arrays))
    assert is_whole(got) and got.count() == 5
    key = lambda r: (r.recording_id, r.channel, r.ch_index, r.i, r.v)
    assert sorted(map(key, unpack_blocks(got).collect())) == sorted(map(key, analyse.with_montage(unpack_blocks(arrays)).select("recording_id", "channel", "ch_index", "i", "v").collect()))
