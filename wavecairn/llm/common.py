"""Helpers shared by the operators for training data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space of the word definition: space and U+0009 to U+000D.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def inputs(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator works with: other columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """``fn`` turns every slice of at most ``rows`` rows into equally long output columns."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                out = fn(batch.slice(begin, rows))
                arrays = [v if isinstance(v := out[f.name], pa.Array) and v.type == f.type else pa.array(v, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, kind)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [x or b"" for x in column(batch, name).cast(pa.large_binary()).to_pylist()]


def unit_hash(*cols: Column | str) -> Column:
    """A repeatable number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def small(df: DataFrame, rows: int = 250_000, weight: Column | None = None) -> DataFrame:
    """``df`` to be broadcast if it was measured to be small; else left to a shuffled join, with the same rows.

    Small is: at most ``rows`` rows, if all rows are short, or a sum of ``weight`` of at most ``rows``.
    """
    if weight is None:
        fits = df.limit(rows + 1).count() <= rows
    else:
        fits = (df.agg(F.sum(weight)).first()[0] or 0) <= rows
    return F.broadcast(df) if fits else df
