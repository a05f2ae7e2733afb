"""Input tables, shared scratch tables and Arrow batches of texts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one round of array work takes at a time; a longer text is taken whole.
SLICE_BYTES = 2 << 20
#: The same for operators whose rounds send no more for being small: a worker's memory follows the slice.
SMALL_SLICE = 512 << 10
#: Bytes after which a task's Arrow batch ends while settle() writes: a little less than two slices. What an executor
#: holds beside its heap, and each of its workers, follows the batch; Spark's own limit is a number of rows.
BATCH_BYTES = 15 * SLICE_BYTES // 8
#: The written table is all that is read later, so the shuffle files behind it go at once, not when the driver happens
#: to collect its garbage.
_WHILE_WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the text operators read, under fixed names, whatever else the table holds."""
    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it (a session of a test) a folder in the warehouse, which is shared as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """With these settings of the session; afterwards it has its own again."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settle(df: DataFrame) -> DataFrame:
    """The same rows read from a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with _settings(spark, _WHILE_WRITING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives the system back what Arrow and the C library keep for later: a worker lives on through many tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, TypeError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Texts(NamedTuple):
    """UTF-8 texts end to end: text i is data[offsets[i]:offsets[i + 1]], of batch row first_row + i."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a batch in slices of about `limit` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    yield from pieces(Texts(0, data, offsets), limit)


def pieces(texts: Texts, limit: int) -> Iterator[Texts]:
    """Texts in slices of about `limit` bytes; a longer text is one by itself."""
    row, offsets = 0, texts.offsets
    while row < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(offsets) - 1)
        base = offsets[row]
        yield Texts(texts.first_row + row, texts.data[base : offsets[stop]], offsets[row : stop + 1] - base)
        row = stop


def str_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """As text_slices, as Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    row, done = 0, 0
    while row < len(column):
        stop = min(max(int(np.searchsorted(sizes, done + limit, "right")), row + 1), len(column))
        yield row, column.slice(row, stop - row).to_pylist()
        row, done = stop, sizes[stop - 1]
