"""Shared pieces: the Arrow pass over texts, written intermediate tables, input selection.

Conventions of all operators here. ``text`` null counts as the empty text and
is handled like any other row. Rows are never merged: repeated rows each get
their result. An input column whose name equals an output column is replaced
by the output; every other input column passes through untouched. An empty
table gives an empty result of the same schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# Bytes of text that one vectorised pass holds at a time (a single longer
# text is one pass of its own).
CHUNK_BYTES = 1 << 20


class Texts:
    """A run of texts as one UTF-8 buffer: text ``i`` is ``data[off[i]:off[i + 1]]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def raw(self) -> bytes:
        return self.data.tobytes()

    def each(self) -> Iterator[bytes]:
        raw, off = self.raw(), self.off.tolist()
        for a, b in zip(off, off[1:]):
            yield raw[a:b]

    def row_of(self, pos: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.off, pos, side="right") - 1


def texts_of(col: pa.Array) -> Texts:
    """The buffer view of a string or binary array (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64))
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return Texts(np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0])


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes (one row at least)."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over one buffer; ``ends``: 0 and the end of each value, in bytes."""
    wide = len(data) >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(ends) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(ends, np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def list_array(values: pa.Array | np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(ends, np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def map_texts(df: DataFrame, source: str, work: Callable[[], Callable[[Texts], dict[str, pa.Array]]], out: str,
              keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Add the columns that ``work`` makes of the text column ``source``.

    ``work()`` runs once for each task and gives the function from a run of
    texts to output arrays. ``out`` is the DDL of its columns. ``keep`` names
    the input columns to return (all by default). Kept columns travel packed
    in one struct, so no name of theirs can clash with the outputs. The pass
    is one narrow map: no shuffle, and memory is bounded by one Arrow batch
    plus the work on ``chunk_bytes`` of text.
    """
    schema = T.StructType.fromDDL(out)
    keep = [c for c in (df.columns if keep is None else keep) if c not in schema.names]
    packed = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(True).alias("_"))
    src = df.select(packed.alias("row"), F.col(f"`{source}`").alias("src"))
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = work()
        for batch in batches:
            col = batch.column(1)
            sizes = np.diff(texts_of(col).off)
            for i, j in cuts(sizes, chunk_bytes):
                got = fn(texts_of(col.slice(i, j - i)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(got[n] if got[n].type == k else got[n].cast(k) for n, k in zip(names, kinds))], ["row", *names])

    result = src.mapInArrow(run, T.StructType([src.schema["row"], *schema.fields]))
    return result.select(*(F.col("row").getField(c).alias(c) for c in keep), *names)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs of frames made within leave no shuffle files behind. For results that are collected or written
    once: else the files of each step stay on disk until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and read again: later
    steps neither recompute it nor depend on one executor's copy."""
    path = scratch_path(df.sparkSession, "llm", name)
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
