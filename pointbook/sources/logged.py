"""Tables as a base, appended rows and committed deletes, under one manifest.

The state of a table is a base folder (rows as last rewritten) and a log of
entries in commit order: *append* (rows added) and *delete* (what goes: ids,
students, or days of students). A delete applies to what was there before it,
so rows carry the number of the commit that added them, and a read leaves out
each row that a later delete names. Writing is thus in proportion to the
request; ``compaction`` folds the log into a new base.

Deletes are joined as a broadcast while their recorded rows and bytes are
small, and as a shuffled join beyond that; nothing is counted on a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Deletes of a table that a read broadcasts: rows and bytes on disk, both recorded at the commit.
DELETE_BROADCAST_ROWS, DELETE_BROADCAST_BYTES = 100_000, 16 << 20

# What a delete entry holds, by the columns that name the rows.
DELETE_COLUMNS = {
    "id": ["id"],
    "student_id": ["student_id"],
    "student_day": ["student_id", "occurred_on"],
}


def empty_state() -> dict:
    return {"base": None, "buckets": None, "log": []}


def _extended(schema: StructType, cols: list[str] | None, mark: str) -> StructType:
    """The schema (of some columns, all by default), nullable, with the commit's number in ``mark``."""
    fields = [StructField(f.name, f.dataType) for f in schema.fields if cols is None or f.name in cols]
    return StructType([*fields, StructField(mark, LongType())])


def appended(spark: SparkSession, state: dict, schema: StructType) -> DataFrame | None:
    """The appended rows with the number of their commit (``_n``), None for none: one scan, however many entries."""
    paths = [e["path"] for e in state["log"] if e["kind"] == "append"]
    return spark.read.schema(_extended(schema, None, "_n")).parquet(*paths) if paths else None


def without_deleted(spark: SparkSession, state: dict, schema: StructType, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``_n``) less those that a later delete names."""
    for by, cols in DELETE_COLUMNS.items():
        mine = [e for e in state["log"] if e["kind"] == "delete" and e["by"] == by]
        if not mine:
            continue
        gone = spark.read.schema(_extended(schema, cols, "_gone")).parquet(*(e["path"] for e in mine))
        if len(mine) > 1:
            gone = gone.groupBy(*cols).agg(F.max("_gone").alias("_gone"))
        gone = gone.select(*(F.col(c).alias(f"_d_{c}") for c in cols), "_gone")
        if sum(e["rows"] for e in mine) <= DELETE_BROADCAST_ROWS and sum(e["bytes"] for e in mine) <= DELETE_BROADCAST_BYTES:
            gone = F.broadcast(gone)
        cond = F.col("_n") < F.col("_gone")
        for c in cols:
            cond = cond & (F.col(c) == F.col(f"_d_{c}"))
        rows = rows.join(gone, cond, "left_anti")
    return rows


def rows_of(spark: SparkSession, state: dict, schema: StructType, base: DataFrame | None) -> DataFrame:
    """The rows of a table in ``state``; ``base``: its base folder as read (None for none)."""
    if base is None:
        base = spark.createDataFrame([], schema)
    if not state["log"]:
        return base
    rows = base.withColumn("_n", F.lit(0).cast("bigint"))
    more = appended(spark, state, schema)
    if more is not None:
        rows = rows.unionByName(more)
    return without_deleted(spark, state, schema, rows).drop("_n")
