"""Sharding by jump consistent hashing (law ``key``).

The shard of a row depends on its key and the number of shards alone, with no
ring table. When one shard is appended, a row either stays or moves into the
new shard, and only 1/(n+1) of the rows move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

# The multiplier of the published jump hash (Lamping and Veach, 2014); a fixed value.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into ``shards`` shards, all keys a step at a time.

    Each round moves the keys that have not yet jumped past the last shard;
    about ln(shards) rounds are needed.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = np.asarray(keys).astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        with np.errstate(over="ignore"):
            state[live] = state[live] * _STEP + np.uint64(1)
        ahead = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = ahead < shards
        live = live[on]
        at[live] = ahead[on]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit integer key column. A null key counts as 0."""

    @F.pandas_udf(T.IntegerType())
    def f(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards))

    return f(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def assign(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard if one more were appended).

    ``key`` is a 64-bit integer column, such as an id or ``xxhash64`` of other
    columns. Columns of these names in the input are replaced. Narrow: no shuffle.
    """
    return df.withColumns({"shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1)})


def number(df: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """Add ``slot``: the place of a row within its ``shard`` by ``order`` (nulls first), gapless from 0.

    Rows are range-partitioned by shard and order and written once with the
    place each took in its partition. A shard is thus spread over as many
    tasks as it needs; rows equal in ``order`` are told apart by a row number,
    so a key that holds a third of all rows is spread too. The slot is that
    place plus the rows of the shard in earlier partitions. That table of
    starts has at most partitions + shards rows, and alone is broadcast.
    """
    cols = df.columns
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"))
    keys = [F.col("row").getField(c) for c in ["shard", *order]]
    placed = (packed.withColumn("tie", F.monotonically_increasing_id())
              .repartitionByRange(*keys, F.col("tie"))
              .sortWithinPartitions(*keys, F.col("tie"))
              .select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    placed = written(placed, "slots")
    starts = (placed.groupBy("part", F.col("row").getField("shard").alias("shard"))
              .agg(F.min("place").alias("first"), F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    rows = placed.withColumn("shard", F.col("row").getField("shard"))
    return (rows.join(F.broadcast(starts), ["part", "shard"])
            .select(*(F.col("row").getField(c).alias(c) for c in cols if c != "slot"), (F.col("place") + F.col("shift")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document's shard and its slot there.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law,
    shard, slot, grown_shard. A null text has size 8 and the checksum of the
    empty text; a null doc_id counts as key 0; repeated rows get a slot each.
    Other input columns are not carried.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return number(assign(rows, F.col("doc_id"), shards), shards, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: Column) -> None:
    """Write the documents as Parquet folders ``shard=N``, each shard over as many files as tasks held rows of it."""
    assign(docs, key, shards).drop("grown_shard").write.partitionBy("shard").parquet(path)
