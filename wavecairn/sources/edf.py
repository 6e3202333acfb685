"""EDF / EDF+ files as a Spark data source.

    spark.dataSource.register(EdfDataSource)
    spark.read.format("edf_blocks").option("mode", "blocks").load("/data/corpus")

The driver lists files and their sizes only; headers and samples are read by the tasks, each one a
run of data records of one file, or several small files. Modes: blocks, header, channels, annotations. A block holds the samples
i0 to i1 - 1. Predicates on recording_id choose the files, those on i0 and i1 the runs of records that are
read (``i0 < end AND i1 > begin`` is the overlap with a range), those on channel what is scaled and sent.
Where the session leaves spark.sql.python.filterPushdown.enabled off, as Spark does by default, the same
predicates run in Spark on all blocks. ``read_edf`` looks it up; without it, .option("pushdown", "true") says so.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavecairn.functions.names import MARKER
from wavecairn.sources.pushdown import Pushed, pushdown, takes_filters

# Text encoding of the header and annotations, unit factors to volts.
ENCODING = "cp1251"
TO_VOLTS = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "µV": 1e-6, "nV": 1e-9}
SCHEMAS = {
    "blocks": "recording_id string, channel string, ch_index int, i0 bigint, i1 bigint, v array<double>",
    "header": "recording_id string, path string, sfreq double, start timestamp, n_samples bigint, duration_s double, n_channels int",
    "channels": "recording_id string, ch_index int, channel string, kind string, unit string",
    "annotations": "recording_id string, onset double, description string",
}
PART_BYTES = 32 << 20
#: What opening a file counts as when small files are put together in one partition.
OPEN_BYTES = 256 << 10
READ_BYTES = 8 << 20


@dataclass
class Header:
    start: datetime | None
    header_bytes: int
    records: int
    seconds: float
    labels: list[str]
    units: list[str]
    factor: np.ndarray
    offset: np.ndarray
    counts: np.ndarray

    @property
    def signals(self) -> list[int]:
        return [k for k, label in enumerate(self.labels) if label != "EDF Annotations"]

    @property
    def per_record(self) -> int:
        counts = {int(self.counts[k]) for k in self.signals}
        if len(counts) != 1:
            raise ValueError(f"signals with different sampling rates in one file: {sorted(counts)} samples per record")
        return counts.pop()

    @property
    def sfreq(self) -> float:
        return self.per_record / self.seconds

    @property
    def record_bytes(self) -> int:
        return 2 * int(self.counts.sum())


def read_header(stream) -> Header:
    fixed = stream.read(256)
    text = lambda a, b: fixed[a:b].decode(ENCODING).strip()
    if text(192, 236).startswith("EDF+D"):
        raise ValueError("interrupted recordings (EDF+D) are not supported")
    n = int(text(252, 256))
    body = stream.read(256 * n)
    fields, at = {}, 0
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8),
                        ("dmax", 8), ("prefilter", 80), ("count", 8), ("reserved", 32)):
        fields[name] = [body[at + k * width : at + (k + 1) * width].decode(ENCODING).strip() for k in range(n)]
        at += n * width
    number = {k: np.array([float(x) for x in fields[k]]) for k in ("pmin", "pmax", "dmin", "dmax")}
    volts = np.array([TO_VOLTS.get(u, 1.0) for u in fields["unit"]])
    gain = (number["pmax"] - number["pmin"]) / (number["dmax"] - number["dmin"])
    try:
        start = datetime.strptime(text(168, 184), "%d.%m.%y%H.%M.%S")
        if start.year >= 2085:
            start = start.replace(year=start.year - 100)
    except ValueError:
        start = None
    return Header(
        start, int(text(184, 192)), int(text(236, 244)), float(text(244, 252)), fields["label"], fields["unit"],
        gain * volts, (number["pmin"] - number["dmin"] * gain) * volts, np.array([int(c) for c in fields["count"]]),
    )


@dataclass
class FilePart(InputPartition):
    path: str
    recording_id: str
    part: int
    parts: int

    def __init__(self, path: str, recording_id: str, part: int, parts: int):
        super().__init__(None)
        self.path, self.recording_id, self.part, self.parts = path, recording_id, part, parts


@dataclass
class FileGroup(InputPartition):
    """Runs of records of files, read one after the other by one task."""

    pieces: list[FilePart]

    def __init__(self, pieces: list[FilePart]):
        super().__init__(None)
        self.pieces = pieces


def grouped(parts: list[tuple[FilePart, int]], most: int) -> list[FilePart | FileGroup]:
    """Neighbouring parts (part, bytes) together up to ``most`` bytes: very many small files are not as many tasks."""
    groups, held = [], most + 1
    for part, size in parts:
        if held + size + OPEN_BYTES > most:
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += size + OPEN_BYTES
    return [FileGroup(g) if len(g) > 1 else g[0] for g in groups]


def list_files(path: str, suffix: str) -> list[tuple[str, str, int]]:
    """(path, recording id, bytes) of one file, or of every matching file below a folder, sorted.

    The recording id is the path below the folder without its suffix, so equal names in different
    folders stay apart.
    """
    filesystem, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = filesystem.get_file_info(root)
    if info.type == pafs.FileType.File:
        found = [info]
    elif info.type == pafs.FileType.Directory:
        found = [f for f in filesystem.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
        found = [f for f in found if f.path.lower().endswith(suffix)]
    else:
        found = []
    if not found or any(not f.path.lower().endswith(suffix) for f in found):
        raise ValueError(f"{path} holds no {suffix} file")
    prefix = root.rstrip("/") + "/" if info.type == pafs.FileType.Directory else root[: root.rfind("/") + 1]
    return sorted((f.path, f.path[len(prefix) : -len(suffix)], f.size) for f in found)


def _open(base: str, path: str):
    filesystem = pafs.FileSystem.from_uri(base)[0] if "://" in base else pafs.LocalFileSystem()
    return filesystem.open_input_file(path)


class EdfReader(DataSourceReader):
    def __init__(self, options: dict, mode: str):
        self.base, self.mode = options["path"], mode
        self.kind = options.get("kind", "signal")
        self.tmin = float(options.get("tmin", 0.0))
        self.tmax = float(options["tmax"]) if options.get("tmax") else None
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.read_bytes = int(options.get("read_bytes", READ_BYTES))
        self.pushed = Pushed(["recording_id", "channel"], ["i0", "i1"]) if mode == "blocks" else Pushed(["recording_id"], [])

    def pushFilters(self, filters):
        return [f for f in filters if not self.pushed.take(f)]

    def partitions(self):
        parts = []
        for path, rid, size in list_files(self.base, ".edf"):
            if not self.pushed.allows(recording_id=rid):
                continue
            whole = self.mode not in ("blocks", "annotations")
            count = 1 if whole else max(1, math.ceil(size / self.part_bytes))
            parts += [(FilePart(path, rid, k, count), 0 if whole else size // count) for k in range(count)]
        return grouped(parts, self.part_bytes)

    def read(self, group: FilePart | FileGroup):
        for part in group.pieces if isinstance(group, FileGroup) else [group]:
            with _open(self.base, part.path) as stream:
                header = read_header(stream)
                yield from getattr(self, f"_read_{self.mode}")(part, header, stream)

    def _wanted(self, header: Header) -> list[tuple[int, int]]:
        """(position in the file, ch_index) of the chosen signals."""
        marker = re.compile(MARKER)
        chosen = [
            (k, n) for n, k in enumerate(header.signals)
            if self.kind == "all" or bool(marker.match(header.labels[k])) == (self.kind == "marker")
        ]
        if not chosen and self.kind == "signal":
            raise ValueError("no signal channels besides markers")
        return [c for c in chosen if self.pushed.allows(channel=header.labels[c[0]])]

    def _read_header(self, part, header: Header, stream):
        start = header.start
        n = header.per_record * header.records
        yield (part.recording_id, part.path, header.sfreq, start, n, n / header.sfreq, len(header.signals))

    def _read_channels(self, part, header: Header, stream):
        for n, k in enumerate(header.signals):
            kind = "marker" if re.match(MARKER, header.labels[k]) else "signal"
            yield (part.recording_id, n, header.labels[k], kind, header.units[k])

    def _records(self, part, header: Header, stream, first: int, last: int, wanted=lambda begin, end: True):
        """Arrays [records, values per record] of int16, a bounded number of records at a time; unwanted runs are skipped."""
        step = max(1, self.read_bytes // header.record_bytes)
        for begin in range(first, last, step):
            count = min(step, last - begin)
            if not wanted(begin, begin + count):
                continue
            stream.seek(header.header_bytes + begin * header.record_bytes)
            raw = stream.read(count * header.record_bytes)
            yield begin, np.frombuffer(raw, dtype="<i2").reshape(count, -1)

    def _span(self, part, header: Header) -> tuple[int, int]:
        return header.records * part.part // part.parts, header.records * (part.part + 1) // part.parts

    def _read_blocks(self, part, header: Header, stream):
        wanted = self._wanted(header)
        labels = [header.labels[k] for k in header.signals]
        if len(set(labels)) != len(labels):
            raise ValueError("channel names must be unique")
        if not wanted:
            return
        per, total = header.per_record, header.per_record * header.records
        low = math.ceil(self.tmin * header.sfreq)
        high = total - 1 if self.tmax is None else min(total - 1, math.floor(self.tmax * header.sfreq))
        if low > total - 1:
            raise ValueError("the requested range starts past the end of the recording")
        first, last = self._span(part, header)
        first, last = max(first, low // per), min(last, high // per + 1)
        columns = np.concatenate([[0], np.cumsum(header.counts)])
        border = lambda begin, end: (max(low, begin * per), min(high + 1, end * per))

        def overlaps(begin: int, end: int) -> bool:
            a, b = border(begin, end)
            return a < b and self.pushed.allows(i0=a, i1=b)

        for begin, matrix in self._records(part, header, stream, first, last, overlaps):
            a, b = border(begin, begin + len(matrix))
            cut = slice(a - begin * per, b - begin * per)
            rows = [matrix[:, columns[k] : columns[k + 1]].ravel()[cut] * header.factor[k] + header.offset[k] for k, _ in wanted]
            sizes = np.arange(0, (len(rows) + 1) * (b - a), b - a, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.recording_id] * len(rows)), pa.array([header.labels[k] for k, _ in wanted]),
                    pa.array([n for _, n in wanted], pa.int32()), pa.array([a] * len(rows), pa.int64()), pa.array([b] * len(rows), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rows))),
                ],
                names=["recording_id", "channel", "ch_index", "i0", "i1", "v"],
            )

    def _read_annotations(self, part, header: Header, stream):
        texts = [k for k, label in enumerate(header.labels) if label == "EDF Annotations"]
        columns = np.concatenate([[0], np.cumsum(header.counts)])
        first, last = self._span(part, header)
        for record in range(first, last):  # only the bytes of the texts are read
            for k in texts:
                stream.seek(header.header_bytes + record * header.record_bytes + 2 * int(columns[k]))
                for onset, text in parse_annotations(stream.read(2 * int(header.counts[k]))):
                    yield (part.recording_id, onset, text)


class PlainEdfReader(EdfReader):
    """For sessions without pushdown: Spark refuses a reader with its own pushFilters there."""

    pushFilters = DataSourceReader.pushFilters


def parse_annotations(raw: bytes):
    """(onset, text) pairs of one record's annotation bytes; time-keeping entries have no text."""
    for entry in raw.split(b"\x00"):
        head, *texts = entry.split(b"\x14")
        if head[:1] in (b"+", b"-"):
            onset = float(head.split(b"\x15")[0])
            for text in texts:
                if text:
                    yield onset, text.decode(ENCODING)


class EdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf_blocks"

    def _mode(self) -> str:
        mode = self.options.get("mode", "blocks")
        if mode not in SCHEMAS:
            raise ValueError(f"mode must be one of {sorted(SCHEMAS)}")
        return mode

    def schema(self) -> str:
        return SCHEMAS[self._mode()]

    def reader(self, schema) -> EdfReader:
        options = dict(self.options)
        return (EdfReader if takes_filters(options) else PlainEdfReader)(options, self._mode())


def read_edf(spark: SparkSession, path: str, mode: str = "blocks", **options) -> DataFrame:
    spark.dataSource.register(EdfDataSource)
    reader = spark.read.format("edf_blocks").option("mode", mode).option("pushdown", pushdown(spark))
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)
