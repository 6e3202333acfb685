"""[channels, samples] matrices in NumPy files as a Spark data source, and channel-name lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavecairn.sources.edf import _open, list_files
from wavecairn.sources.pushdown import Pushed, pushdown, takes_filters

PART_BYTES = 32 << 20
BLOCK = 65_536


@dataclass
class Slab(InputPartition):
    """Share ``part`` of ``parts`` of a file's values."""

    def __init__(self, path: str, recording_id: str, part: int, parts: int):
        super().__init__(None)
        self.path, self.recording_id, self.part, self.parts = path, recording_id, part, parts


def matrix_shape(stream) -> tuple[tuple[int, int], bool, np.dtype, int]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(stream)
    if len(shape) != 2 or shape[0] < 1 or shape[1] < 4:
        raise ValueError("the matrix must have shape [channels, samples] with at least 4 samples")
    return shape, by_column, dtype, stream.tell()


class NpyReader(DataSourceReader):
    """The driver lists files and sizes; a task reads a header and its share of the values behind it."""

    def __init__(self, options: dict):
        self.base = options["path"]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.pushed = Pushed(["recording_id", "channel"], ["i0", "i1"])

    def pushFilters(self, filters):
        return [f for f in filters if not self.pushed.take(f)]

    def partitions(self):
        found = [(path, rid, max(1, -(-size // self.part_bytes))) for path, rid, size in list_files(self.base, ".npy") if self.pushed.allows(recording_id=rid)]
        return [Slab(path, rid, k, parts) for path, rid, parts in found for k in range(parts)]

    def read(self, slab: Slab):
        with _open(self.base, slab.path) as stream:
            (channels, samples), by_column, dtype, at = matrix_shape(stream)
            wanted = [c for c in range(channels) if self.pushed.allows(channel=f"channel_{c}")]
            share = lambda n: (n * slab.part // slab.parts, n * (slab.part + 1) // slab.parts)
            if by_column:  # values of one place lie side by side: a share is a range of places
                begin, end = share(samples)
                step = max(1, BLOCK // channels)
                for first in range(begin, end, step):
                    last = min(end, first + step)
                    if wanted and self.pushed.allows(i0=first, i1=last):
                        stream.seek(at + first * channels * dtype.itemsize)
                        raw = np.frombuffer(stream.read((last - first) * channels * dtype.itemsize), dtype)
                        yield _rows(slab.recording_id, wanted, first, raw.reshape(-1, channels).T[wanted])
                return
            begin, end = share(channels * samples)  # channel after channel: a share may end inside a channel
            for c in wanted:
                low, high = max(0, begin - c * samples), min(samples, end - c * samples)
                for first in range(low, high, BLOCK):
                    last = min(high, first + BLOCK)
                    if self.pushed.allows(i0=first, i1=last):
                        stream.seek(at + (c * samples + first) * dtype.itemsize)
                        yield _rows(slab.recording_id, [c], first, np.frombuffer(stream.read((last - first) * dtype.itemsize), dtype)[None, :])


class PlainNpyReader(NpyReader):
    """For sessions without pushdown."""

    pushFilters = DataSourceReader.pushFilters


def _rows(recording_id: str, channels: list[int], first: int, rows: np.ndarray) -> pa.RecordBatch:
    sizes = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    number = lambda x: pa.array([x] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([recording_id] * len(rows)), pa.array([f"channel_{c}" for c in channels]), pa.array(channels, pa.int32()),
            number(first), number(first + rows.shape[1]), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.ascontiguousarray(rows, dtype=float).ravel())),
        ],
        names=["recording_id", "channel", "ch_index", "i0", "i1", "v"],
    )


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_blocks"

    def schema(self) -> str:
        return "recording_id string, channel string, ch_index int, i0 bigint, i1 bigint, v array<double>"

    def reader(self, schema) -> NpyReader:
        options = dict(self.options)
        return (NpyReader if takes_filters(options) else PlainNpyReader)(options)


def read_npy(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """Blocks of every matrix below ``path``; ``names`` (ch_index, channel) replaces channel_<i>."""
    spark.dataSource.register(NpyDataSource)
    blocks = spark.read.format("npy_blocks").option("pushdown", pushdown(spark)).load(path)
    if names is None:
        return blocks
    renamed = blocks.drop("channel").join(names, "ch_index", "left").withColumn(
        "channel", F.coalesce("channel", F.raise_error(F.lit("fewer channel names than channels")).cast("string"))
    )
    return renamed.select("recording_id", "channel", "ch_index", "i0", "i1", "v")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per non-blank line, numbered in file order."""
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("ch_index", "channel"))
