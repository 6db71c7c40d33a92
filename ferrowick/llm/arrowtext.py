"""Arrow text columns as flat byte arrays, and mapping batches with added columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows whose new columns are made at once.
SLICE_ROWS = 1000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets in them; null counts as empty."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def give_back() -> None:
    """Return freed memory to the system. Arrow and the C library keep it otherwise, some 500 MB in a worker that has encoded texts,
    while later stages need it in the same executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


_MODEL: dict = {}


def forget_model() -> None:
    """Drop what an earlier stage's tasks have kept in this worker."""
    if _MODEL:
        _MODEL.clear()
        give_back()


def only_model(key: tuple, make: Callable[[], object]):
    """The large object that this worker keeps between tasks: one at a time, as stages follow each other in the same workers."""
    if key not in _MODEL:
        forget_model()
        _MODEL[key] = make()
    return _MODEL[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for `mapInArrow` that gives back its worker's freed memory when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def with_arrays(df: DataFrame, schema: str, inputs: list[str], added: Callable[[], Callable]) -> DataFrame:
    """`df` with the columns of `schema`, which the function that `added()` makes in each task yields from the arrays `inputs`.

    Every other column passes through as it is. The function gets one array for each of `inputs` and returns one
    array for each new column.
    """
    new = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = added()
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            columns = function(*[batch.column(batch.schema.get_field_index(name)) for name in inputs])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[f.name for f in new]])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *new.fields]))
