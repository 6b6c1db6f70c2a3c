"""Integer vectors from embeddings, shared by the operators on vectors.

A row whose vector is null or holds a null or non-finite component is left
out. A component c becomes ``floor(256 * c)``, taken in double precision; one
beyond the range of ``long`` leaves its row out too, as it has no such value.
An empty vector stays: it counts as zero in every dimension, as a shorter
vector does in those it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
LONG = 2.0 ** 63

# Sums of products of doubles are exact below this.
EXACT = 2.0 ** 53


def _floors(col: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """(positions of the rows that stay, their integer vectors)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    there = np.flatnonzero(np.asarray(col.is_valid()))
    col = col.take(pa.array(there))
    flat = col.flatten()
    size = np.asarray(pc.list_value_length(col), np.int64)
    values = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) * SCALE)
    row = np.arange(len(col)).repeat(size)
    with np.errstate(invalid="ignore"):
        odd = ~((values >= -LONG) & (values < LONG))
    good = np.bincount(row, odd, len(col))[:len(col)] == 0
    kept = good[row] if len(row) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(size[good])])
    return there[good], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[kept].astype(np.int64)))


def integer_vectors(df: DataFrame, source: str = "embedding", out: str = "x") -> DataFrame:
    """The rows that take part, with ``out`` array<bigint> beside their other columns (one of that name is replaced)."""
    keep = [c for c in df.columns if c not in (source, out)]
    packed = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(True).alias("_"))
    src = df.select(packed.alias("row"), F.col(f"`{source}`").alias("src"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _floors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), x], ["row", "x"])

    done = src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("x", T.ArrayType(T.LongType()))]))
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("x").alias(out))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of an int64 matrix, zeros behind the end of short ones."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(pc.list_value_length(col), np.int64)
    flat = np.asarray(col.flatten(), np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    got = np.zeros((len(size), width), np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    row = np.arange(len(size)).repeat(size)
    place = np.arange(len(flat)) - start.repeat(size)
    got[row, place] = flat
    return got


def width_of(vectors: DataFrame, x: str = "x") -> int:
    """The length of the longest vector (0 for no rows)."""
    return int(vectors.agg(F.max(F.size(x))).first()[0] or 0)
