"""Best-fit packing of documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.llm.common import column, inputs, map_rows
from wavecairn.llm.tokens import encoder
from wavecairn.session import cut_lineage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: the ids of the whole text and the end id, cut only where longer than ``capacity``.

    Null and empty texts are one piece with the end id. Repeated rows give repeated pieces.
    """

    def cut(batch) -> dict:
        ids, counts = encoder(tokenizer).encode(column(batch, "text"))
        ids, bounds = ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)])
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for k, doc in enumerate(column(batch, "doc_id").to_pylist()):
            own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
            for n, begin in enumerate(range(0, len(own), capacity)):
                part = own[begin : begin + capacity]
                for key, value in (("doc_id", doc), ("piece", n), ("start", begin), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                    out[key].append(value)
                if with_ids:
                    out["ids"].append(part)
        return out

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return map_rows(inputs(docs, doc_id="doc_id", text="text"), cut, schema, 512)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length, in the given order.

    With N(g) open bins of residual gap g, each piece goes where the sum of N(g)^2 becomes smallest:
    into a bin of some gap or into a new one. A full bin counts nothing. Ties take the smallest gap.
    """
    leave = np.full(capacity + 1, np.iinfo(np.int64).max // 2)  # change of the sum when a bin loses gap g
    leave[capacity] = 0  # a new bin
    enter = np.ones(capacity + 1, dtype=np.int64)  # and when one gets gap g
    enter[0] = 0
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0

    def note(gap: int) -> None:
        n = len(waiting[gap])
        leave[gap] = 1 - 2 * n if n else np.iinfo(np.int64).max // 2
        enter[gap] = 1 + 2 * n

    for k, size in enumerate(lengths.tolist()):
        gap = size + int(np.argmin(leave[size:] + enter[: capacity + 1 - size]))
        if gap == capacity:
            here, made = made, made + 1
        else:
            here = waiting[gap].pop()
            note(gap)
        bins[k], offsets[k] = here, capacity - gap
        if gap > size:
            waiting[gap - size].append(here)
            note(gap - size)
    return bins, offsets


def pack(pieces_table: DataFrame, capacity: int = 2048, bins_per_task: int = 16_384, pieces_per_task: int = 2_000_000) -> DataFrame:
    """Sequence and offset of every piece; ``pieces_table`` must be a written table.

    The pieces are dealt evenly, by position in the table, to as many groups as their tokens fill
    ``bins_per_task`` sequences, or as many more as keep a group at about ``pieces_per_task`` pieces if most
    are tiny, so a group is bounded whatever the documents are; each group packs its pieces from long to short. Only lengths and keys are shuffled, no ids. An empty table gives no rows.
    Groups share no sequence: a group leaves a few sequences partly empty, out of ``bins_per_task``.
    """
    tokens, rows = pieces_table.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-tokens // (capacity * bins_per_task)), -(-rows // pieces_per_task))
    dealt = pieces_table.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    names = pieces_table.columns

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        return frame[names].assign(sequence_id=(int(frame["_group"].iloc[0]) << 40) + bins, offset=offsets)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_table.schema)
    return dealt.groupBy("_group").applyInPandas(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_lineage(pieces(docs, capacity, end_id, tokenizer)), capacity)
