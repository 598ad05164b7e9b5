"""Row helpers: Arrow columns as Python values, batch-wise maps and the cluster's shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.session import storage_root

#: Rows, and bytes of text, handed to a row function at once: what one Python worker holds beside the batch itself.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


#: What a worker remembers between tasks (emptied by ``clear``), and the function that it last ran.
MEMORIES: list = []
_LAST: list = [None]


def begin(rows: Callable) -> None:
    """A worker that goes on to another function forgets what the one before remembered."""
    name = f"{rows.__module__}.{rows.__qualname__}"
    if _LAST[0] != name:
        for memory in MEMORIES:
            memory.clear()
        _LAST[0] = name


def end() -> None:
    """A worker that waits for its next task gives back what Arrow holds but does not use."""
    pa.default_memory_pool().release_unused()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return [value or "" for value in column.to_pylist()]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each within ``SLICE_ROWS`` and ``SLICE_BYTES``, or one row."""
    held = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            held[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(held, held[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``rows`` applied to slices of each Arrow batch; it returns the output columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(rows)
        for batch in batches:
            for part in slices(batch):
                out = rows(part)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, types[n]) for n, c in out.items()], names=list(out)
                )
        end()

    types = {field.name: _ARROW[field.dataType.simpleString()] for field in _parsed(schema)}
    return df.mapInArrow(run, schema)


def edit_slices(df: DataFrame, edit: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``df`` with slices of its batches edited in place: rows left out, or values of its own columns replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(edit)
        for batch in batches:
            for part in slices(batch):
                yield edit(part)
        end()

    return df.mapInArrow(run, df.schema)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names: lineage ends there."""
    spark = df.sparkSession
    path = f"{storage_root(spark)}/corpus/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))
