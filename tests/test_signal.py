import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import event, samples
from wavecairn import EnsembleConfig, RecruitmentConfig, ReservoirConfig
from wavecairn.functions.wavelets import decompose_rows, rebuild_rows, taps, with_dwt
from wavecairn.operators import ensemble, residual, spectral
from wavecairn.plans import ensemble as PE
from wavecairn.operators.framing import CHANNEL, pack_blocks
from wavecairn.plans.analyse import compare_montages
from wavecairn.plans.ensemble import ensemble_detect
from wavecairn.plans.residual import residual_detect


def butter_by_recursion(low, high, fs, x, order=4):
    """Direct difference equation of the same band-pass, from its zeros and poles."""
    edge = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    bw, w0 = edge[1] - edge[0], np.sqrt(edge[0] * edge[1])
    p = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * bw / 2
    p = np.concatenate([p + np.sqrt(p**2 - w0**2), p - np.sqrt(p**2 - w0**2)])
    gain = np.real(bw**order * (2 * fs) ** order / np.prod(2 * fs - p))
    b = gain * np.real(np.poly([1] * order + [-1] * order))
    a = np.real(np.poly((2 * fs + p) / (2 * fs - p)))
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(9) if n >= k) - sum(a[k] * y[n - k] for k in range(1, 9) if n >= k)
    return y


def test_impulse_response_equals_the_difference_equation():
    impulse = np.zeros(120)
    impulse[0] = 1
    np.testing.assert_allclose(spectral.butterworth_response(13, 80, 256, 120), butter_by_recursion(13, 80, 256, impulse), atol=1e-10)


def test_zero_phase_passes_the_band_and_nothing_else():
    t = np.arange(4000) / 256
    inside, below, above = np.sin(2 * np.pi * 35 * t), np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 120 * t)
    kept = spectral.zero_phase(np.stack([inside, below, above]), 13, 80, 256)[:, 500:-500]
    np.testing.assert_allclose(kept[0], inside[500:-500], atol=2e-3)
    assert np.abs(kept[1]).max() < 1e-3 and np.abs(kept[2]).max() < 2e-2
    assert np.abs(spectral.zero_phase(np.full(400, 7.0), 13, 80, 256)).max() < 1e-9


def test_phase_of_a_sine_is_linear():
    t = np.arange(1024) / 256
    phase = np.unwrap(spectral.analytic_phase(np.cos(2 * np.pi * 16 * t)))
    np.testing.assert_allclose(np.diff(phase), 2 * np.pi * 16 / 256, atol=1e-9)


def test_blockwise_filter_agrees_with_the_whole_signal(spark):
    x = np.random.default_rng(0).normal(size=(2, 1500))
    got = spectral.bandpass(samples(spark, x, ["a", "b"]), 13.0, 80.0, 256.0, 400, 300).toPandas().sort_values(["ch_index", "i"])
    want = spectral.zero_phase(x, 13, 80, 256)
    np.testing.assert_allclose(got["v"].to_numpy().reshape(2, 1500)[:, 50:-50], want[:, 50:-50], atol=1e-6)


@settings(max_examples=30, deadline=None)
@given(st.integers(64, 300), st.sampled_from(["db1", "db2", "db4"]), st.integers(0, 10_000))
def test_wavelet_bands_rebuild_the_signal(n, wavelet, seed):
    x = np.random.default_rng(seed).normal(size=(2, n))
    bands = decompose_rows(x, wavelet, 3)
    np.testing.assert_allclose(rebuild_rows(bands, wavelet, n), x, atol=1e-10)


def test_column_dwt_equals_the_matrix_form(spark):
    x = np.random.default_rng(1).normal(size=64)
    frame = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    row = with_dwt(frame, "x", "db4", 3).first()
    for name, band in zip(["band_a3", "band_d3", "band_d2", "band_d1"], decompose_rows(x[None], "db4", 3)):
        np.testing.assert_allclose(row[name], band[0], atol=1e-12)
    assert [len(row[b]) for b in ("band_d1", "band_d2", "band_d3")] == [35, 21, 14]


def test_components_add_up(spark):
    x = np.random.default_rng(2).normal(size=(1, 250))
    parts = spectral.dwt_components(samples(spark, x, ["a"]), "db4", 4, 512)
    total = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"]
    np.testing.assert_allclose(total, x[0], atol=1e-10)


def dtw_by_hand(a, b, radius):
    n = len(a)
    cost = np.full((n + 1, n + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - radius), min(n, i + radius) + 1):
            cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return np.sqrt(cost[n, n] / n)


@settings(max_examples=20, deadline=None)
@given(st.integers(8, 40), st.integers(1, 7), st.integers(0, 10_000))
def test_warping_distance(n, radius, seed):
    a, b = np.random.default_rng(seed).normal(size=(2, 3, n))
    got = ensemble.dtw_rows(a, b, radius)
    np.testing.assert_allclose(got, [dtw_by_hand(x, y, radius) for x, y in zip(a, b)], atol=1e-12)
    np.testing.assert_allclose(ensemble.dtw_rows(a, a, radius), 0)


def test_wavelet_power_peaks_at_the_tone(spark):
    x = np.sin(2 * np.pi * 20 * np.arange(1024) / 256)[None]
    power = spectral.cwt_power(samples(spark, x, ["a"]), 5.0, 80.0, 256.0, 2048).where("i between 400 and 600")
    best = power.groupBy("frequency").agg(F.avg("power").alias("p")).orderBy(F.desc("p")).first()["frequency"]
    # Power grows with the scale of the wavelet, so the peak sits a little below the tone.
    assert abs(np.log2(best / 20)) < 0.25
    with pytest.raises(ValueError):
        spectral.cwt_frequencies(5, 200, 256)


def test_synchrony_is_one_for_equal_channels(spark):
    t = np.arange(2000) / 200
    x = np.stack([np.sin(2 * np.pi * 20 * t)] * 3)
    order = spectral.kuramoto_order(samples(spark, x, ["a", "b", "c"]), 200.0, 200, 100, F.lit(2000), 800, 400, {"beta": (13.0, 30.0)}, tile=2)
    values = order.toPandas()
    assert len(values) == 19 and values["order"].min() > 0.999


def test_ensemble_finds_the_burst(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 6000))
    x[:3, 3000:3400] += 12 * np.sin(2 * np.pi * 18 * np.arange(400) / 100)
    found = PE.ensemble_detect(samples(spark, x, list("abcd")), 100.0, EnsembleConfig(threshold_mad=3.0), {"beta": (13.0, 30.0)}).events.orderBy("rank").collect()
    assert found[0]["detected"] and found[0]["start_s"] < 34 and found[0]["end_s"] > 30 and found[0]["top_channels"] in ("a", "b", "c")


def test_reservoir_guards_and_states():
    for bad in ({"spectral_radius": 0.0}, {"leak_rate": 0.0}, {"n_reservoir": 2}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            ReservoirConfig(**bad)
    config = ReservoirConfig(n_reservoir=40, seed=3)
    u = np.random.default_rng(1).normal(size=(200, 2))
    states = residual.drive(u, config)
    np.testing.assert_array_equal(states, residual.drive(u, config))
    assert states.shape == (200, 40) and np.abs(states).max() <= 1
    assert residual.reservoir_matrices(2, config)[3] == pytest.approx(0.95, abs=1e-6)


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(6)
    f, y = rng.normal(size=(90, 5)), rng.normal(size=(90, 2))
    rows = spark.createDataFrame([("r", k, -1.0, y[k].tolist(), f[k].tolist()) for k in range(90)],
                                 "recording_id string, i bigint, t_rel double, y array<double>, f array<double>")
    got = np.array(residual.ridge_fit(rows, 0.3, 16).first()["weights"])
    np.testing.assert_allclose(got, np.linalg.solve(f.T @ f + 0.3 * np.eye(5), f.T @ y).T, atol=1e-10)


def test_residual_flags_the_burst(spark):
    sfreq, rng = 200.0, np.random.default_rng(11)
    n = int(90 * sfreq)
    t = np.arange(n) / sfreq - 60
    data = rng.normal(0, 1e-5, (3, n))
    data[:, (t >= 0) & (t < 3)] += 2e-3 * np.sin(2 * np.pi * 6 * t[(t >= 0) & (t < 3)])
    clock = (np.arange(n) % 200 < 2).astype(float)
    table = samples(spark, np.vstack([data, clock]), ["C0", "C1", "C2", "MKR1+"])
    inputs = spark.createDataFrame([("r", "MKR1+")], "recording_id string, channel string")
    outputs = spark.createDataFrame([("r", f"C{k}", k) for k in range(3)], "recording_id string, channel string, position int")
    out = residual_detect(table, event(spark, 60.0), inputs, outputs, sfreq, ReservoirConfig(n_reservoir=80, washout=50, seed=4), 60.0, 30.0)
    row = out.verdicts.first()
    assert row["detected"] and -0.1 <= row["onset_t"] <= 3.5 and row["peak_score"] >= 6 and "DETECTED" in row["verdict"]


@pytest.mark.parametrize("n", [300, 1001, 1536])
def test_long_segments_in_blocks_equal_whole_ones(spark, n):
    """Overlap-save: blocks of 256 samples against one block that holds the whole segment."""
    x = np.random.default_rng(2).standard_normal((2, n)).cumsum(axis=1)
    rows = samples(spark, x, ["a", "b"])
    for wavelet, level in (("db4", 3), ("db2", 4)):
        cut, whole = (spectral.dwt_components(rows, wavelet, level, block).toPandas().sort_values(["channel", "band", "i"]) for block in (256, 4096))
        assert len(cut) == len(whole) == 2 * n * (level + 1)
        np.testing.assert_allclose(cut["v"].to_numpy(), whole["v"].to_numpy(), atol=1e-9)
        total = cut.groupby(["channel", "i"])["v"].sum().to_numpy().reshape(2, n)
        np.testing.assert_allclose(total, x, atol=1e-9)
    cut, whole = (spectral.cwt_power(rows, 20.0, 80.0, 256.0, block).toPandas().sort_values(["channel", "frequency", "i"]) for block in (256, 4096))
    assert len(cut) == len(whole)
    np.testing.assert_allclose(cut["power"].to_numpy(), whole["power"].to_numpy(), rtol=1e-9, atol=1e-9)


def test_pipelines_take_arrays(spark):
    """Ensemble, whole analysis and montages out of arrays that are cut at odd borders, against the same samples."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (4, 2400))
    t = np.arange(300) / 200.0
    x[0, 1200:1500] += 4 * np.sin(2 * np.pi * 35 * t)
    x[1, 1240:1540] += 4 * np.sin(2 * np.pi * 35 * t)
    rows = samples(spark, x, ["EEG PM3", "EEG PM4", "EEG L1", "EEG L2"])
    arrays = pack_blocks(rows, 333).select(*CHANNEL, "i0", "v").cache()
    config = EnsembleConfig(window_seconds=0.5, step_seconds=0.1, merge_gap_seconds=0.2, wave_points=32)
    a, b = (ensemble_detect(s, 200.0, config, {"beta": (13.0, 30.0), "gamma": (30.0, 80.0)}, 1024) for s in (rows, arrays))
    pick = lambda d: sorted((r["w"], round(r["score"], 9)) for r in d.scores.collect())
    assert pick(a) == pick(b) and a.scores.count() > 100
    known = spark.createDataFrame([("r", 6.0, "given", 2.0)], "recording_id string, time_s double, label string, duration_s double")
    recruiting = RecruitmentConfig(baseline_seconds=5.0, analysis_seconds=2.0)
    found = [compare_montages(s, 200.0, explicit=known, recruiting=recruiting) for s in (rows, arrays)]
    roles = [sorted((r["recording_id"], r["channel"], round(r["peak_z"], 6), r["latency"], r["role"]) for r in f.roles.collect()) for f in found]
    assert roles[0] == roles[1] and {r[0] for r in roles[0]} == {"r#none", "r#bipolar"}
