"""Arrow helpers for operators that work on whole texts inside tasks.

Spark hands a task Arrow batches of up to 10,000 rows; with long texts such a batch is tens of MB.  ``pieces`` cuts
batches (never texts) so that the temporaries of one step stay small, whatever the length of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts sum to at most max_bytes, or hold a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()  # workers are used again, and what they keep adds up


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy; a null is an empty text."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:  # Arrow allows bytes under a null
        return utf8(column.fill_null(""))
    return raw[ends[0] : ends[-1]], ends - ends[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.frombuffer(raw.tobytes().lower(), dtype=np.uint8)


def map_texts(
    docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable], max_bytes: int = 2 << 20
) -> DataFrame:
    """(id_col, *schema) per row of docs.  make() runs once a task and gives a function from a text column to arrays."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        work = make()
        for piece in pieces(batches, 1, max_bytes):
            arrays = work(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), *arrays], names=names)

    names = [id_col, *(part.split()[0] for part in _fields(schema))]
    return source.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, start = [], 0, 0
    for at, char in enumerate(schema):
        depth += (char == "<") - (char == ">")
        if char == "," and not depth:
            out.append(schema[start:at].strip())
            start = at + 1
    return [*out, schema[start:].strip()]
