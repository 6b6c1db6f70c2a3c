"""Table scans (A1) and versioned snapshots with an atomic commit (A3).

A table lives in a folder ``<root>/<table>/v=<n>/``; a version is committed
once its ``_SUCCESS`` marker exists (Spark's file committer writes it last),
and a reader takes the highest committed version. A mutation therefore never
overwrites the files it reads, a failed write leaves the previous version
current, and a retried write of the same version replaces only its own
uncommitted folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import schemas


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_scan(spark: SparkSession, path: str, table: str | StructType) -> DataFrame:
    """A1: scan a stored table with its fixed schema (no inference).

    Column pruning and filter pushdown reach the Parquet reader through
    Catalyst; callers select only what they use.
    """
    schema = schemas.TABLES[table] if isinstance(table, str) else table
    return spark.read.schema(schema).parquet(path)


# -- versioned snapshots -----------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def committed_versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Versions of ``table`` under ``root`` whose write has committed."""
    fs, base, jvm = _fs(spark, f"{root.rstrip('/')}/{table}")
    if not fs.exists(base):
        return []
    out = []
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                try:
                    out.append(int(name[2:]))
                except ValueError:
                    pass
    return sorted(out)


def snapshot_path(root: str, table: str, version: int) -> str:
    return f"{root.rstrip('/')}/{table}/v={version}"


def write_snapshot(df: DataFrame, root: str, table: str, version: int | None = None) -> int:
    """A3: write ``df`` as the next version of ``table`` and return the version.

    The whole batch becomes visible at once (commit marker) or not at all.
    The output keeps the DataFrame's partitioning; callers that want fewer,
    larger files repartition before (never to one partition at scale).
    """
    spark = df.sparkSession
    if version is None:
        have = committed_versions(spark, root, table)
        version = (have[-1] + 1) if have else 0
    df.write.mode("overwrite").parquet(snapshot_path(root, table, version))
    return version


def read_snapshot(spark: SparkSession, root: str, table: str, version: int | None = None,
                  schema: StructType | None = None) -> DataFrame:
    """Read the current (or a given) committed version of ``table``."""
    if version is None:
        have = committed_versions(spark, root, table)
        if not have:
            raise FileNotFoundError(f"no committed version of {table} under {root}")
        version = have[-1]
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    elif table in schemas.TABLES:
        r = r.schema(schemas.TABLES[table])
    return r.parquet(snapshot_path(root, table, version))


def write_ledger_snapshot(ledger: DataFrame, root: str, table: str = "penalties", version: int | None = None,
                          month_col: str = "occurred_month") -> int:
    """A3 for the ledger: a new version partitioned by the ``yyyy-MM`` prefix of
    ``occurred_on`` so date-range reads prune whole months.

    No shuffle: a month is far too coarse a key to hash-partition on (a few
    keys, terabytes each). Each task sorts its own rows by month and student,
    so it writes one file per month it holds, one writer at a time, and the
    row groups carry tight ``student_id`` min/max statistics for pushdown.
    """
    from pyspark.sql import functions as F

    spark = ledger.sparkSession
    if version is None:
        have = committed_versions(spark, root, table)
        version = (have[-1] + 1) if have else 0
    out = ledger.withColumn(month_col, F.substring("occurred_on", 1, 7))
    (out.sortWithinPartitions(month_col, "student_id").write.mode("overwrite").partitionBy(month_col)
     .parquet(snapshot_path(root, table, version)))
    return version


# Names that every file system takes as part of a path.
BATCH_NAME = re.compile(r"[A-Za-z0-9-][A-Za-z0-9._-]*")


# -- bucketed versions (co-located joins) -------------------------------------

def _bucket_table_name(path: str) -> str:
    import hashlib

    return "pb_" + hashlib.sha1(path.encode()).hexdigest()[:16]


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` to ``path`` as ``buckets`` hash buckets of ``key`` (sorted by
    ``key`` within each bucket).

    Tables bucketed on their join key with the same bucket count join and
    aggregate on that key without any shuffle. Rows are first hash-partitioned
    into exactly ``buckets`` partitions, so each task writes one bucket file
    rather than one file per bucket. The table is registered in the session
    catalog under a name derived from its path (Spark's in-process catalog; no
    metastore service).
    """
    name = _bucket_table_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(name))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int, schema: StructType) -> DataFrame:
    """Read what ``write_bucketed`` wrote, with its bucket layout (registering it in this session's catalog if needed)."""
    name = _bucket_table_name(path)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_bucketed_snapshot(df: DataFrame, root: str, table: str, key: str, buckets: int,
                            version: int | None = None) -> int:
    """A3, bucketed: the next version of ``table``, written with ``write_bucketed``."""
    if version is None:
        have = committed_versions(df.sparkSession, root, table)
        version = (have[-1] + 1) if have else 0
    write_bucketed(df, snapshot_path(root, table, version), key, buckets)
    return version


def read_bucketed_snapshot(spark: SparkSession, root: str, table: str, key: str, buckets: int,
                           schema: StructType, version: int | None = None) -> DataFrame:
    """Read a version written by ``write_bucketed_snapshot`` with its bucket layout."""
    if version is None:
        version = committed_versions(spark, root, table)[-1]
    return read_bucketed(spark, snapshot_path(root, table, version), key, buckets, schema)
