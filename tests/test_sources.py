import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecairn.operators.framing import unpack_blocks
from wavecairn.sources import tables
from wavecairn.sources.edf import read_edf
from wavecairn.sources.npy import read_names, read_npy


def write_edf(path, signals, labels, sfreq=100, annotations=(), start=dt.datetime(2026, 1, 2, 3, 4, 5)):
    """One-second records, microvolt scaling, optional annotation channel."""
    n = signals.shape[1] // sfreq
    rows = [(label, "uV", sfreq) for label in labels] + ([("EDF Annotations", "", 60)] if annotations else [])
    limit = float(np.ceil(np.abs(signals).max() * 1e6)) or 1.0
    pad = lambda value, width: str(value).encode("cp1251").ljust(width)[:width]
    head = pad(0, 8) + pad("", 80) + pad("", 80) + pad(start.strftime("%d.%m.%y"), 8) + pad(start.strftime("%H.%M.%S"), 8)
    head += pad(256 * (len(rows) + 1), 8) + pad("EDF+C" if annotations else "", 44) + pad(n, 8) + pad(1, 8) + pad(len(rows), 4)
    for column, width in ((lambda r: r[0], 16), (lambda r: "", 80), (lambda r: r[1], 8), (lambda r: -limit if r[1] else -1, 8), (lambda r: limit if r[1] else 1, 8),
                          (lambda r: -32767 if r[1] else -32768, 8), (lambda r: 32767, 8), (lambda r: "", 80), (lambda r: r[2], 8), (lambda r: "", 32)):
        head += b"".join(pad(column(r), width) for r in rows)
    digital = np.round(signals * 1e6 / limit * 32767).astype("<i2")
    with open(path, "wb") as out:
        out.write(head)
        for k in range(n):
            out.write(digital[:, k * sfreq : (k + 1) * sfreq].tobytes())
            if annotations:
                text = f"+{k}\x14\x14\x00".encode()
                for onset, label in annotations:
                    if k <= onset < k + 1:
                        text += f"+{onset}\x15\x14".encode() + label.encode("cp1251") + b"\x14\x00"
                out.write(text.ljust(120, b"\x00"))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    ramp = np.stack([np.linspace(0, 10, 1000, endpoint=False), np.linspace(0, 20, 1000, endpoint=False), np.zeros(1000)]) * 1e-6
    write_edf(root / "one.edf", ramp, ["EEG A1", "EEG A2", "MKR1+"], annotations=[(2.5, "приступ + БТКП"), (7.25, "клиника")])
    (root / "sub").mkdir()
    write_edf(root / "sub" / "TWO.EDF", ramp[:2] * 2, ["EEG A1", "EEG A2"])
    return root, ramp


def test_signals_of_a_folder(spark, corpus):
    root, ramp = corpus
    rows = unpack_blocks(read_edf(spark, str(root), part_bytes=900)).toPandas().sort_values(["recording_id", "ch_index", "i"])
    assert rows["recording_id"].unique().tolist() == ["one", "sub/TWO"]
    one = rows[rows["recording_id"] == "one"]
    assert one["channel"].unique().tolist() == ["EEG A1", "EEG A2"]
    np.testing.assert_allclose(one["v"].to_numpy().reshape(2, 1000), ramp[:2], atol=2e-9)


def test_crop_is_inclusive_and_clamped(spark, corpus):
    root, ramp = corpus
    cut = unpack_blocks(read_edf(spark, str(root / "one.edf"), tmax=5.0)).where("channel = 'EEG A1'").toPandas().sort_values("i")
    assert len(cut) == 501
    np.testing.assert_allclose(cut["v"], ramp[0][:501], atol=2e-9)
    assert unpack_blocks(read_edf(spark, str(root / "one.edf"), tmax=1000.0)).count() == 2000
    middle = unpack_blocks(read_edf(spark, str(root / "one.edf"), tmin=2.505, tmax=4.0)).where("channel = 'EEG A2'").agg(F.min("i"), F.max("i")).first()
    assert tuple(middle) == (251, 400)
    with pytest.raises(Exception, match="past the end"):
        read_edf(spark, str(root / "one.edf"), tmin=50.0).collect()


def test_markers_header_channels_annotations(spark, corpus):
    root, _ = corpus
    marks = read_edf(spark, str(root), kind="marker")
    assert {r["channel"] for r in marks.select("channel").distinct().collect()} == {"MKR1+"}
    assert unpack_blocks(read_edf(spark, str(root), kind="marker", tmax=5.0)).count() == 501
    head = {r["recording_id"]: r for r in read_edf(spark, str(root), "header").collect()}
    assert head["one"]["sfreq"] == 100 and head["one"]["n_samples"] == 1000 and head["one"]["n_channels"] == 3
    assert head["one"]["start"] == dt.datetime(2026, 1, 2, 3, 4, 5) and head["sub/TWO"]["duration_s"] == 10.0
    kinds = {(r["recording_id"], r["channel"]): r["kind"] for r in read_edf(spark, str(root), "channels").collect()}
    assert kinds[("one", "MKR1+")] == "marker" and kinds[("sub/TWO", "EEG A1")] == "signal"
    notes = read_edf(spark, str(root), "annotations").orderBy("onset").collect()
    assert [(r["recording_id"], r["onset"], r["description"]) for r in notes] == [("one", 2.5, "приступ + БТКП"), ("one", 7.25, "клиника")]


def test_channel_predicate_reaches_the_source(spark, corpus):
    root, _ = corpus
    blocks = read_edf(spark, str(root)).where(F.col("channel").isin("EEG A2"))
    assert {r["channel"] for r in blocks.select("channel").collect()} == {"EEG A2"}
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_errors(spark, tmp_path):
    with pytest.raises(Exception, match="no .edf file"):
        read_edf(spark, str(tmp_path)).collect()
    write_edf(tmp_path / "m.edf", np.ones((1, 200)) * 1e-6, ["MKR1+"])
    with pytest.raises(Exception, match="no signal channels"):
        read_edf(spark, str(tmp_path / "m.edf")).collect()


def test_npy_and_names(spark, tmp_path):
    data = np.random.default_rng(0).normal(size=(3, 50))
    np.save(tmp_path / "c.npy", data)
    np.save(tmp_path / "f.npy", np.asfortranarray(data))
    (tmp_path / "names.txt").write_text("A1\n\n A2 \nA3\n", encoding="utf-8")
    names = read_names(spark, str(tmp_path / "names.txt"))
    rows = unpack_blocks(read_npy(spark, str(tmp_path), names)).toPandas().sort_values(["recording_id", "ch_index", "i"])
    assert rows["channel"].unique().tolist() == ["A1", "A2", "A3"]
    np.testing.assert_array_equal(rows["v"].to_numpy().reshape(2, 3, 50), [data, data])
    assert read_npy(spark, str(tmp_path / "c.npy")).select("channel").distinct().count() == 3


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("r", 1, 2.0, ["a", "b"])], "recording_id string, rank int, start_s double, involved_channels array<string>")
    tables.write_events_csv(events, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["involved_channels"] == "a, b"
    edges = spark.createDataFrame([("r", 1, "a", "b", 0.5), ("r", 2, "b", "c", -0.7)], "recording_id string, w int, src string, dst string, weight double")
    stored = tables.write_graph(edges, str(tmp_path / "graph"))
    assert stored.count() == 4 and [tuple(r) for r in tables.read_window(stored, 2).collect()] == [("r", 2, "b", "c", -0.7)]


def counted(monkeypatch, module):
    """Bytes that a reader takes from its files, in this process."""
    read = []
    opened = module._open

    class Counting:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *rest):
            self.stream.close()

        def read(self, n):
            raw = self.stream.read(n)
            read.append(len(raw))
            return raw

        def __getattr__(self, name):
            return getattr(self.stream, name)

    monkeypatch.setattr(module, "_open", lambda base, path: Counting(opened(base, path)))
    return read


def test_ranges_and_recordings_become_byte_runs(spark, corpus, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    from wavecairn.sources import edf

    root, ramp = corpus
    blocks = read_edf(spark, str(root), read_bytes=1000)
    near = blocks.where("recording_id = 'one' AND i0 < 500 AND i1 > 300")
    rows = unpack_blocks(near.where("channel = 'EEG A1'")).where("i >= 300 AND i < 500").orderBy("i").toPandas()
    np.testing.assert_allclose(rows["v"], ramp[0][300:500], atol=2e-9)
    read = counted(monkeypatch, edf)
    reader = edf.EdfReader({"path": str(root), "read_bytes": "1000"}, "blocks")
    assert list(reader.pushFilters([EqualTo(("recording_id",), "one"), LessThan(("i0",), 500), GreaterThan(("i1",), 300)])) == []
    parts = reader.partitions()
    assert [p.recording_id for p in parts] == ["one"]
    got = [b for p in parts for b in reader.read(p)]
    assert sorted({x for b in got for x in b.column(3).to_pylist()}) == [300, 400]
    record = 2 * (3 * 100 + 60)
    assert sum(read) == 256 * 5 + 2 * record


def test_annotations_read_their_own_bytes(spark, corpus, monkeypatch):
    from wavecairn.sources import edf

    root, _ = corpus
    read = counted(monkeypatch, edf)
    reader = edf.EdfReader({"path": str(root / "one.edf")}, "annotations")
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 2
    assert sum(read) == 256 * 5 + 10 * 120


def test_npy_headers_are_read_by_tasks(spark, tmp_path, monkeypatch):
    from wavecairn.sources import npy

    data = np.random.default_rng(1).normal(size=(3, 5000))
    np.save(tmp_path / "c.npy", data)
    np.save(tmp_path / "f.npy", np.asfortranarray(data))
    monkeypatch.setattr(npy, "_open", lambda *_: pytest.fail("the driver opened a file"))
    reader = npy.NpyReader({"path": str(tmp_path), "part_bytes": "50000"})
    assert len(reader.partitions()) == 6
    monkeypatch.undo()
    read = counted(monkeypatch, npy)
    found = {}
    for p in reader.partitions():
        for b in reader.read(p):
            for r in b.to_pylist():
                found.setdefault((r["recording_id"], r["ch_index"]), []).append((r["i0"], r["i1"], r["v"]))
    assert sum(read) < 2 * data.nbytes + 6 * 200
    for rid in "cf":
        for c in range(3):
            runs = sorted(found[rid, c])
            assert [x[0] for x in runs][1:] == [x[1] for x in runs][:-1]
            np.testing.assert_array_equal(np.concatenate([x[2] for x in runs]), data[c])


def test_written_files_read_back(spark, tmp_path):
    from wavecairn.sources.edf_sink import write_edf

    rng = np.random.default_rng(4)
    values = rng.integers(-3000, 3000, (2, 130)).astype(float)
    values[1, 40:60] = np.nan
    rows = [("r/x", f"C{c}", c, i, float(values[c, i])) for c in range(2) for i in range(130) if not (c == 0 and i < 25)]
    table = spark.createDataFrame(rows, "recording_id string, channel string, ch_index int, i bigint, v double")
    notes = spark.createDataFrame([("r/x", 1.5, "начало"), ("r/x", 12.25, "конец")], "recording_id string, onset double, description string")
    (tmp_path / "r").mkdir()
    written = write_edf(table, str(tmp_path), 10, 1.0, dt.datetime(2026, 1, 2), notes).collect()
    assert [r["recording_id"] for r in written] == ["r/x"] and written[0]["bytes"] == (tmp_path / "r" / "x.edf").stat().st_size
    back = unpack_blocks(read_edf(spark, str(tmp_path))).orderBy("ch_index", "i").toPandas()
    want = np.nan_to_num(values)
    want[0, :25] = 0
    np.testing.assert_array_equal(back["v"].to_numpy().reshape(2, 130), want)
    assert [(r["onset"], r["description"]) for r in read_edf(spark, str(tmp_path), "annotations").orderBy("onset").collect()] == [(1.5, "начало"), (12.25, "конец")]


def test_resolved_recordings_are_never_opened(spark, tmp_path):
    """The file of a recording with a given event is no EDF file at all: only a reader that opens it would notice."""
    from wavecairn import DetectorConfig
    from wavecairn.plans.tiers import resolve_lazily

    rng = np.random.default_rng(7)
    data = rng.normal(0, 0.15, (8, 3000))
    data[2:5, 1400:1800] += 7 * np.sin(2 * np.pi * 18 * np.arange(400) / 100.0)
    write_edf(tmp_path / "blind.edf", data * 1e-6, [f"C{k}" for k in range(8)])
    for name in ("given", "noted"):
        (tmp_path / f"{name}.edf").write_bytes(b"not a recording")
    ids = spark.createDataFrame([("blind",), ("given",), ("noted",)], "recording_id string")
    given = spark.createDataFrame([("given", 3.0, "g", 2.0)], "recording_id string, time_s double, label string, duration_s double")
    notes = spark.createDataFrame([("noted", 5.0, "error")], "recording_id string, onset double, description string")
    config = DetectorConfig(window_seconds=1, step_seconds=0.25, threshold_mad=5, min_involved_channels=2)
    found = resolve_lazily(read_edf(spark, str(tmp_path)), 100.0, ids, notes, given, config, keywords=("error",))
    tiers = {r["recording_id"]: (r["tier"], r["time_s"]) for r in found.context.collect()}
    assert tiers["given"] == ("explicit", 3.0) and tiers["noted"] == ("annotation", 5.0)
    assert tiers["blind"][0] == "blind" and 13 <= tiers["blind"][1] <= 18
    again = resolve_lazily(read_edf(spark, str(tmp_path)), 100.0, ids.where("recording_id <> 'blind'"), notes, given, config, keywords=("error",))
    assert again.blind is None and again.context.count() == 2


def test_sources_without_pushdown(spark, corpus, tmp_path):
    """Spark's default: the session pushes nothing, and the same predicates give the same rows."""
    root, ramp = corpus
    np.save(tmp_path / "c.npy", ramp)
    wanted = "recording_id = 'one' AND i0 < 500 AND i1 > 300 AND channel = 'EEG A1'"
    read = lambda: (
        unpack_blocks(read_edf(spark, str(root), read_bytes=1000).where(wanted)).orderBy("i").collect(),
        {m: read_edf(spark, str(root), m).where("recording_id = 'one'").count() for m in ("header", "channels", "annotations")},
        unpack_blocks(read_npy(spark, str(tmp_path)).where("channel = 'channel_1'")).orderBy("i").collect(),
    )
    pushed = read()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert read() == pushed and len(pushed[0]) == 200 and pushed[1] == {"header": 1, "channels": 3, "annotations": 2} and len(pushed[2]) == 1000
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_very_many_small_files_are_few_tasks(tmp_path):
    """a3_edf_header at 1 GB: a task for each of 60 000 files."""
    from wavecairn.sources import edf

    for k in range(300):
        write_edf(tmp_path / f"r{k}.edf", np.ones((1, 200)) * 1e-6, ["EEG A1"])
    for mode, rows in (("header", 300), ("channels", 300), ("blocks", 300)):
        reader = edf.EdfReader({"path": str(tmp_path)}, mode)
        parts = reader.partitions()
        found = [r for p in parts for r in reader.read(p)]
        assert len(parts) < 6 and sum(getattr(r, "num_rows", 1) for r in found) == rows
    large = edf.grouped([(edf.FilePart("p", "r", k, 4), 20 << 20) for k in range(4)], 32 << 20)
    assert [g.part for g in large] == [0, 1, 2, 3]


def test_files_of_whole_arrays_equal_those_of_samples(spark, tmp_path, monkeypatch):
    """Blocks of many records give the records that samples one by one give; a recording without samples has no file."""
    from wavecairn.operators.framing import whole
    from wavecairn.sources import edf_sink

    monkeypatch.setattr(edf_sink, "BLOCK_SAMPLES", 20)
    rng = np.random.default_rng(4)
    waves = {("a", "x", 0): [0.0, *rng.integers(-9, 9, 54).astype(float).tolist()], ("a", "y", 3): [float("nan"), 70000.0, -0.4] * 11, ("b", "x", 0): [5.0] * 7}
    arrays = spark.createDataFrame([(*k, 0, v) for k, v in waves.items()], "recording_id string, channel string, ch_index int, i0 bigint, v array<double>")
    notes = spark.createDataFrame([("a", 51.5, "late"), ("a", 3.0, "one"), ("a", 3.0, "onE"), ("a", 90.0, "outside"), ("c", 1.0, "nowhere")], "recording_id string, onset double, description string")
    rows = unpack_blocks(arrays)
    made = {}
    for kind, samples in (("arrays", arrays), ("whole", arrays.withColumn("i0", whole(F.col("i0")))), ("rows", rows)):
        folder = tmp_path / kind
        assert {r.recording_id for r in edf_sink.write_edf(samples, str(folder), 10, 10.0, dt.datetime(2026, 1, 2), notes).collect()} == {"a", "b"}
        made[kind] = {f.name: f.read_bytes() for f in folder.iterdir()}
    assert made["arrays"] == made["whole"] == made["rows"] and set(made["rows"]) == {"a.edf", "b.edf"}
    got = {(r.recording_id, r.channel): r.v for r in read_edf(spark, str(tmp_path / "whole"), kind="all").collect()}
    for (rid, channel, _), v in waves.items():
        want = np.zeros(60 if rid == "a" else 10)
        want[: len(v)] = np.clip(np.round(np.nan_to_num(v)), -32768, 32767)
        assert got[rid, channel] == want.tolist()
    texts = [(r.onset, r.description) for r in read_edf(spark, str(tmp_path / "whole"), "annotations").collect()]
    assert sorted(texts) == [(3.0, "onE"), (3.0, "one"), (51.5, "late")]
