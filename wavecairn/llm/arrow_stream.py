"""Token files in Arrow's stream format: fixed-size lists of ids and masks, with a list of documents beside.

A part holds a range of doc_ids in ascending order. ``part-N.arrows`` has record batches of
``ids: fixed_size_list<uint16 or uint32>`` and ``mask: fixed_size_list<bool>`` (true: a token, false: padding
after the part's last token); ``part-N.docs.arrows`` has (doc_id, start in the part, n_tokens). Mapped
into memory, every sequence is a view of the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecairn.llm.common import column, inputs
from wavecairn.llm.tokens import encoder
from wavecairn.session import cut_lineage

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, tokens_path string, docs_path string, n_docs bigint, n_tokens bigint"
_MANIFEST = pa.schema([("part", pa.int32()), ("tokens_path", pa.string()), ("docs_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def stream_schema(length: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Streams ids into record batches of at most ``rows`` sequences; only one batch is in memory."""

    def __init__(self, sink, length: int, vocabulary: int, rows: int = 256):
        self.schema, self.length, self.rows = stream_schema(length, vocabulary), length, rows
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        while self.held >= self.length * self.rows:
            self._flush(self.length * self.rows)

    def _flush(self, count: int) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=self.kind)
        now, rest = flat[:count], flat[count:]
        self.waiting, self.held = [rest], len(rest)
        pad = -len(now) % self.length
        mask = np.concatenate([np.ones(len(now), dtype=bool), np.zeros(pad, dtype=bool)])
        now = np.concatenate([now, np.zeros(pad, dtype=self.kind)])
        ids, masks = (pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (now, mask))
        self.out.write_batch(pa.RecordBatch.from_arrays([ids, masks], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.out.close()


class StreamFile:
    """Random access to the sequences of a part, without copies where the file can be mapped."""

    def __init__(self, path: str):
        system, where = pafs.FileSystem.from_uri(path)
        local = isinstance(system, pafs.LocalFileSystem)
        self.source = pa.memory_map(where) if local else system.open_input_file(where)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.first = np.concatenate([[0], np.cumsum([b.num_rows for b in self.batches])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def _row(self, k: int, name: str) -> pa.Array:
        b = int(np.searchsorted(self.first, k, side="right")) - 1
        lists = self.batches[b].column(name)
        length = lists.type.list_size
        return lists.values.slice((k - int(self.first[b])) * length, length)

    def sequence(self, k: int) -> np.ndarray:
        return self._row(k, "ids").to_numpy()

    def mask(self, k: int) -> np.ndarray:
        return self._row(k, "mask").to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the part; a view while they lie in one record batch."""
        parts = []
        while count > 0:
            length = self.batches[0].column("ids").type.list_size
            b = int(np.searchsorted(self.first, start // length, side="right")) - 1
            flat = self.batches[b].column("ids").values.to_numpy()
            begin = start - int(self.first[b]) * length
            part = flat[begin : begin + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, dtype=np.uint16)


def write_stream(docs: DataFrame, folder: str, end_id: int = 1, length: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` to each and write them; returns the list of parts as a table.

    ``folder`` must be a URI that every executor reaches. A part is written under another name and moved
    into place, so a lost or repeated task leaves one whole file. Null texts count as empty, null doc_ids
    sort first, repeated doc_ids stay (ordered by text). An empty table gives parts without sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer), TaskContext.get().partitionId()
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        names = [f"part-{part:06d}.arrows", f"part-{part:06d}.docs.arrows"]
        drafts = [f"{base}/draft-{uuid.uuid4().hex}-{n}" for n in names]
        done = 0
        with system.open_output_stream(drafts[0]) as sink, system.open_output_stream(drafts[1]) as list_sink:
            writer = _Writer(sink, length, tool.tokenizer.get_vocab_size())
            listing = pa.ipc.new_stream(list_sink, DOCS)
            for batch in batches:
                for begin in range(0, batch.num_rows, 512):
                    rows = batch.slice(begin, 512)
                    ids, counts = tool.encode(column(rows, "text"))
                    counts = counts + 1
                    ids = np.insert(ids, np.cumsum(counts - 1), end_id)
                    starts = writer.total + np.cumsum(counts) - counts
                    listing.write_batch(pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(starts), pa.array(counts)], schema=DOCS))
                    writer.add(ids)
                    done += rows.num_rows
            writer.close()
            listing.close()
        for draft, name in zip(drafts, names):
            system.move(draft, f"{base}/{name}")
        row = [[part], *([f"{folder}/{n}"] for n in names), [done], [writer.total]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _MANIFEST)], schema=_MANIFEST)

    ordered = inputs(docs, doc_id="doc_id", text="text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(run, MANIFEST))


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start over all parts, n_tokens, ids_crc32.

    The offsets of the parts come from the list of parts, which has one short row per file.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.where("n_docs > 0").withColumn("before", before)
    count = max(1, manifest.rdd.getNumPartitions(), manifest.count())
    schema = pa.schema([*DOCS, ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = StreamFile(row["tokens_path"])
                system, where = pafs.FileSystem.from_uri(row["docs_path"])
                with system.open_input_stream(where) as source:
                    for docs in pa.ipc.open_stream(source):
                        starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = [zlib.crc32(file.tokens(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + row["before"]), docs.column(2), pa.array(sums, pa.int64())], schema=schema)

    return parts.repartition(count, "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
