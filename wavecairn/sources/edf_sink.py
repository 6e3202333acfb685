"""EDF+ files out of recordings: one file each, written record by record."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.operators.framing import is_packed, is_whole, pack_blocks, whole
from wavecairn.session import cut_lineage
from wavecairn.sources.edf import ENCODING

#: Samples of a channel that a writing task holds at a time, in whole records.
BLOCK_SAMPLES = 1 << 14
#: Digital values are stored as they are: one unit a step.
DIGITAL = (-32768, 32767)


def _field(value, width: int) -> bytes:
    return str(value).encode(ENCODING).ljust(width)[:width]


def header_bytes(labels: list[str], counts: list[int], records: int, seconds: float, start: dt.datetime, unit: str) -> bytes:
    """Fixed part and one column block a field, as the format lays them out."""
    n = len(labels)
    head = _field(0, 8) + _field("", 160) + _field(start.strftime("%d.%m.%y"), 8) + _field(start.strftime("%H.%M.%S"), 8)
    head += _field(256 * (n + 1), 8) + _field("EDF+C", 44) + _field(records, 8) + _field(f"{seconds:g}", 8) + _field(n, 4)
    text = lambda width, of: b"".join(_field(of(k), width) for k in range(n))
    own = lambda k: labels[k] == "EDF Annotations"
    return head + text(16, lambda k: labels[k]) + text(80, lambda k: "") + text(8, lambda k: "" if own(k) else unit) + text(8, lambda k: DIGITAL[0]) + text(8, lambda k: DIGITAL[1]) \
        + text(8, lambda k: DIGITAL[0]) + text(8, lambda k: DIGITAL[1]) + text(80, lambda k: "") + text(8, lambda k: counts[k]) + text(32, lambda k: "")


def annotation_bytes(record: int, seconds: float, entries: list[tuple[float, str]], size: int) -> bytes:
    """The texts of one record behind its own time; too many for the reserved bytes are an error."""
    raw = f"+{record * seconds:g}\x14\x14\x00".encode()
    for onset, text in entries:
        raw += f"+{onset!r}\x14".encode() + text.encode(ENCODING) + b"\x14\x00"
    if len(raw) > size:
        raise ValueError(f"the annotations of record {record} need {len(raw)} bytes, {size} are reserved")
    return raw.ljust(size, b"\x00")


def write_edf(samples: DataFrame, folder: str, record: int, seconds: float, start: dt.datetime, annotations: DataFrame | None = None, unit: str = "V", text_bytes: int = 400) -> DataFrame:
    """Writes ``folder/<recording_id>.edf`` for every recording and returns (recording_id, path, bytes).

    ``samples`` are single samples or arrays; a file has records of ``record`` samples that last ``seconds``. Values are
    rounded to 16-bit steps of one unit, missing ones are 0, a last incomplete record is filled with 0.
    ``annotations``: recording_id, onset, description; those outside the records go. The rows of a recording are
    sorted and stream through one task, which holds blocks of some ``BLOCK_SAMPLES`` samples of each channel, one at a
    time; a file appears under its name when it is whole.
    """
    held = cut_lineage(samples)
    held = held.withColumn("i0", whole(F.col("i0"))) if is_whole(samples) else held
    # A channel that begins late or ends early is filled up to the recording's records.
    end = F.max(F.col("i0") + F.size("v") if is_packed(samples) else F.col("i") + 1)
    known = held.where(F.col("recording_id").isNotNull() & F.col("channel").isNotNull() & F.col("ch_index").isNotNull())
    heads = known.groupBy("recording_id").agg(
        F.sort_array(F.collect_set(F.struct("ch_index", "channel"))).alias("channels"), F.ceil(end / record).cast("bigint").alias("records")).where("records > 0")
    many = max(1, BLOCK_SAMPLES // record)
    values = pack_blocks(held, record * many).select(
        "recording_id", "block", "ch_index", (F.col("i0") - F.col("own0")).alias("at"), F.col("v").cast("array<double>").alias("v"))
    rows = heads.withColumns({"block": F.lit(-1).cast("bigint"), "ch_index": F.lit(-1)}).unionByName(values, allowMissingColumns=True)
    if annotations is not None:
        placed = annotations.withColumn("r", F.floor(F.col("onset") / seconds).cast("bigint")).where("r >= 0")
        notes = placed.groupBy("recording_id", F.floor(F.col("r") / many).cast("bigint").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("r", "onset", "description"))).alias("notes")).withColumn("ch_index", F.lit(-1))
    else:
        notes = rows.limit(0).select("recording_id", "block", "ch_index", F.lit(None).cast("array<struct<r:bigint,onset:double,description:string>>").alias("notes"))
    ordered = rows.unionByName(notes, allowMissingColumns=True).repartition("recording_id").sortWithinPartitions("recording_id", "block", "ch_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        out = name = temporary = channels = matrix = None
        records = at_block = 0
        noted: dict[int, list] = {}

        def put() -> None:
            """The records of the block that is held."""
            nonlocal matrix, noted
            first, count = at_block * many, min(many, records - at_block * many)
            if count > 0:
                texts = b"".join(annotation_bytes(first + k, seconds, noted.get(first + k, []), text_bytes // 2 * 2) for k in range(count))
                digital = np.clip(np.round(matrix), *DIGITAL).astype("<i2").reshape(len(channels), many, record)[:, :count]
                data = np.ascontiguousarray(digital.transpose(1, 0, 2)).reshape(count, -1).view(np.uint8)
                out.write(np.concatenate([data, np.frombuffer(texts, np.uint8).reshape(count, -1)], axis=1).tobytes())
            matrix, noted = np.zeros_like(matrix), {}

        def advance(block: int) -> None:
            nonlocal at_block
            while at_block < block and at_block * many < records:
                put()
                at_block += 1

        def finish() -> pa.RecordBatch:
            advance(-(-records // many))
            size = out.tell()
            out.close()
            filesystem.move(temporary, f"{root}/{name}.edf")
            return pa.RecordBatch.from_pydict({"recording_id": [name], "path": [f"{root}/{name}.edf"], "bytes": [size]})

        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            lists, heads_, notes_ = get("v"), get("channels"), get("notes")
            for k, (rid, block, index, at) in enumerate(zip(*(get(c).to_pylist() for c in ("recording_id", "block", "ch_index", "at")))):
                if block == -1:
                    if out is not None:
                        yield finish()
                    name, channels, records, at_block, noted = rid, heads_[k].as_py(), get("records")[k].as_py(), 0, {}
                    place = {c["ch_index"]: n for n, c in enumerate(channels)}
                    matrix = np.zeros((len(channels), many * record))
                    temporary = f"{root}/_{uuid.uuid4().hex}"
                    filesystem.create_dir(root, recursive=True)
                    out = filesystem.open_output_stream(temporary)
                    labels = [c["channel"] for c in channels] + ["EDF Annotations"]
                    out.write(header_bytes(labels, [record] * len(channels) + [text_bytes // 2], records, seconds, start, unit))
                elif rid == name:  # notes without a recording go
                    advance(block)
                    if index == -1:
                        for n in notes_[k].as_py():
                            noted.setdefault(n["r"], []).append((n["onset"], n["description"]))
                    else:
                        found = lists[k].values.to_numpy(zero_copy_only=False)
                        matrix[place[index], at : at + len(found)] = np.where(np.isnan(found), 0.0, found)
        if out is not None:
            yield finish()

    return cut_lineage(ordered.mapInArrow(run, "recording_id string, path string, bytes bigint"))
