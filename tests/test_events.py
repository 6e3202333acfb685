from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import event, samples
from wavecairn import GraphConfig, RecruitmentConfig
from wavecairn.functions import names
from wavecairn.operators import events, graph, montage, recruit
from wavecairn.plans import analyse as A

REC = ["recording_id"]


def test_region_membership(spark):
    cases = {"EEG PM3": True, "EEG PM1": False, "EEG CC9": True, "EEG CC5": False, "PM3-4": True, "PM2-3": True, "PM7-8": True,
             "CC7-8": True, "CC9-10": True, "PM1-2": False, "CC1-2": False, "EEG CC'4": False, "EEG PM'3": False, "MKR1+": False}
    frame = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.in_region(F.col("n")).alias("x"))
    assert {r["n"]: r["x"] for r in frame.collect()} == cases


def test_markers_and_contacts(spark):
    frame = spark.createDataFrame([("MKR1+",), ("mkr 2",), ("EEG PM3",), ("EEG CC'4",), ("ПМ7",)], "n string")
    rows = frame.select("n", names.is_marker(F.col("n")), names.shaft(F.col("n")), names.contact(F.col("n"))).collect()
    assert [tuple(r)[1:] for r in rows] == [(True, None, None), (True, "mkr", 2), (False, "PM", 3), (False, "CC'", 4), (False, "ПМ", 7)]


def test_montage_spans_gaps_and_subtracts(spark):
    labels = ["EEG PM1", "EEG PM2", "EEG PM4", "EEG PM'1", "EEG PM'2", "MKR1+"]
    data = np.arange(24, dtype=float).reshape(6, 4) ** 2
    table = samples(spark, data, labels)
    pairs = montage.contact_pairs(table.select("recording_id", "channel", "ch_index").distinct())
    text = montage.format_montage(pairs).first()["montage"]
    assert text == "PM:\n  1-2\n  2-4\nPM':\n  1-2"
    derived = montage.apply_montage(table, pairs).toPandas().sort_values(["ch_index", "i"])
    assert derived["channel"].drop_duplicates().tolist() == ["PM1-2", "PM2-4", "PM'1-2"]
    np.testing.assert_array_equal(derived["v"].to_numpy().reshape(3, 4), [data[0] - data[1], data[1] - data[2], data[3] - data[4]])
    missing = montage.apply_montage(table.where("channel <> 'EEG PM2'"), pairs)
    assert {r["channel"] for r in missing.select("channel").distinct().collect()} == {"PM'1-2"}
    with pytest.raises(ValueError, match="montage"):
        A.with_montage(table, ("average",))


def test_spread_beats_score(spark):
    rows = [("r", 10.0, 10.3, 10.1, 40.0, 1.0, 1), ("r", 6000.0, 6030.0, 6012.0, 15.0, 0.9, 20)]
    frame = spark.createDataFrame(rows, "recording_id string, start_s double, end_s double, peak_s double, score double, confidence double, involved_count int")
    best = events.select_event(frame).first()
    assert best["time_s"] == 6012.0 and best["involved_count"] == 20
    assert events.select_event(frame.limit(0)).count() == 0


def test_annotation_cluster(spark):
    rows = [(10392.734, "где тут начало?"), (10396.445, "приступ + БТКП"), (10399.469, "клиника"), (500.0, "recording start")]
    frame = spark.createDataFrame([("r", *r) for r in rows], "recording_id string, onset double, description string")
    got = events.cluster_annotations(frame).first()
    assert got["time_s"] == 10396.445 and got["label"] == "приступ + БТКП" and got["member_count"] == 3
    assert got["duration_s"] == pytest.approx(10399.469 - 10392.734)
    members = events.cluster_members(frame, events.cluster_annotations(frame)).orderBy("onset").collect()
    assert [m["onset"] for m in members] == [10392.734, 10396.445, 10399.469]
    quiet = spark.createDataFrame([("r", 1.0, "lights off"), ("r", 2.0, "impedance check")], frame.schema)
    assert events.cluster_annotations(quiet).count() == 0


def test_clock(spark):
    rows = [("17:27:14", datetime(2026, 1, 1, 17, 27, 11), 20.0), ("00:00:01.500", datetime(2026, 1, 1, 23, 59, 59), 5.0),
            ("17:28:00", datetime(2026, 1, 1, 17, 27, 11), 20.0), ("soon", datetime(2026, 1, 1, 17, 27, 11), 20.0)]
    frame = spark.createDataFrame(rows, "c string, s timestamp, d double")
    offset = names.clock_offset(F.col("c"), F.col("s"), F.col("d"))
    assert [r[0] for r in frame.select(offset).collect()] == [3.0, 2.5, None, None]
    with pytest.raises(Exception, match="outside"):
        frame.select(names.clock_offset(F.col("c"), F.col("s"), F.col("d"), strict=True)).collect()


@pytest.fixture(scope="module")
def recruited(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(0, 0.05, (4, 2400))
    wave = 3 * np.sin(2 * np.pi * 35 * np.arange(400) / 200.0)
    data[0, 1200:1600] += wave
    data[1, 1240:1640] += wave
    table = samples(spark, data, ["EEG PM3", "EEG CC8", "EEG L1", "EEG L2"])
    config = RecruitmentConfig(baseline_seconds=5.0)
    z = A.band_z(table, event(spark, 6.0), 200.0, config)
    return z, recruit.assign_roles(recruit.recruitment(z, 8.0), config), table


def test_recruitment_order_and_text(spark, recruited):
    _, roles, _ = recruited
    rows = {r["channel"]: r for r in roles.collect()}
    assert {c for c, r in rows.items() if r["role"] == "initiator"} == {"EEG PM3", "EEG CC8"}
    assert rows["EEG PM3"]["latency"] < rows["EEG CC8"]["latency"]
    text = recruit.describe_source(roles, event(spark, 6.0)).first()["summary"]
    assert "EEG PM3" in text and "EEG CC8" in text and "6.000" in text
    empty = recruit.describe_source(roles.limit(0), event(spark, 42.0)).first()["summary"]
    assert "No channel crossed" in empty and "42.000" in empty


def test_graph_and_diffusion(spark, recruited):
    z, roles, _ = recruited
    nodes = graph.graph_nodes(roles)
    assert {r["channel"] for r in nodes.collect()} == {"EEG PM3", "EEG CC8"}
    spokes = graph.recruitment_edges(roles).collect()
    assert {r["dst"] for r in spokes} == {"EEG PM3", "EEG CC8"} and all(r["src"] == "PEAK" for r in spokes)
    involved = z.join(nodes.select(*REC, "channel"), [*REC, "channel"], "left_semi")
    edges = graph.correlation_graph(graph.series_vectors(involved), REC, 0.5, 4, 4)
    states = graph.diffuse(nodes, edges, 4).toPandas()
    peaks = nodes.toPandas()["peak_z"]
    assert len(states) == 10 and states["h"].min() >= peaks.min() - 1e-6 and states["h"].max() <= peaks.max() + 1e-6
    check = graph.evaluate_diffusion(graph.diffuse(nodes, edges, 4), z, 4, 8.0).orderBy("step").collect()
    assert [r["elapsed_s"] for r in check] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_isolated_nodes_decay(spark):
    nodes = spark.createDataFrame([("r", "a", 8.0), ("r", "b", 4.0), ("r", "c", 2.0)], "recording_id string, channel string, peak_z double")
    edges = spark.createDataFrame([("r", "a", "b", -0.9)], "recording_id string, src string, dst string, weight double")
    got = graph.diffuse(nodes, edges, 2, 0.5).toPandas().pivot(index="step", columns="channel", values="h")
    assert got["a"].tolist() == [8.0, 6.0, 6.0] and got["b"].tolist() == [4.0, 6.0, 6.0] and got["c"].tolist() == [2.0, 1.0, 0.5]


def test_tiles_do_not_change_the_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 40))
    rows = [("r", f"c{k}", k, [float(x) for x in base[k % 3] + 0.5 * rng.normal(size=40)]) for k in range(11)]
    vectors = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, x array<double>")
    matrix = np.corrcoef([r[3] for r in rows])
    want = {(a, b) for a in range(11) for b in range(11) if a != b and abs(matrix[a, b]) >= 0.4}
    whole = graph.correlation_links(vectors, REC, 0.4, 11).collect()
    assert {(r["ch_index"], r["other_index"]) for r in whole} == want
    pruned = [
        {(r["src"], r["dst"]): round(r["weight"], 9) for r in graph.prune_edges(graph.correlation_links(vectors, REC, 0.4, 11, 2, tile), REC, 2).collect()}
        for tile in (2, 4, 128)
    ]
    assert pruned[0] == pruned[1] == pruned[2] and pruned[0]


def test_summary_ignores_undefined_correlations(spark):
    rec = spark.createDataFrame([("r", 4)], "recording_id string, n_channels int")
    found = spark.createDataFrame([("r",), ("r",)], "recording_id string")
    roles = spark.createDataFrame([("r", "C0", 0, 0.1, "initiator")], "recording_id string, channel string, ch_index int, latency double, role string")
    edges = spark.createDataFrame([("r",)], "recording_id string")
    fit = spark.createDataFrame([("r", 0.6), ("r", 0.2), ("r", None)], "recording_id string, correlation double")
    row = A.summarise_runs(rec, found, roles, edges, fit).first()
    assert row["n_detected_candidates"] == 2 and row["best_correlation"] == 0.6 and row["mean_correlation"] == pytest.approx(0.4)
    assert row["likely_initiators"] == ["C0"]


def test_tiers(spark):
    make = lambda rid, t: event(spark, t, rid)
    got = events.resolve_event(make("a", 1.0), make("a", 2.0).unionByName(make("b", 3.0)), make("b", 4.0).unionByName(make("c", 5.0)))
    assert {r["recording_id"]: (r["tier"], r["time_s"]) for r in got.collect()} == {"a": ("explicit", 1.0), "b": ("annotation", 3.0), "c": ("blind", 5.0)}
