"""As-of ("greatest key <= value") lookup without broadcasting the lookup side.

Used when a lookup table is too large to broadcast. Both sides are unioned
into one key-ordered stream, range-partitioned on the key, and each
partition carries the last lookup row forward with a running window; the
value a partition starts with comes from a per-partition summary of at most
``num_partitions`` rows (its size is bounded by the partition count, not by
the data). No pairs are formed, and every key is handled by exactly one task.

The left side must already be distinct on the key (callers pass distinct
values, so a value shared by a third of all rows is still one row here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root


def asof_floor(values: DataFrame, key: str, lookup: DataFrame, lookup_key: str, payload: list[str],
               num_partitions: int | None = None) -> DataFrame:
    """For each distinct ``values.key`` the lookup row with the greatest
    ``lookup_key <= key`` (``lookup_key`` unique), as a struct column ``hit``
    (NULL when none). Returns ``(key, hit)``."""
    spark = values.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pl = F.struct(*[F.col(c) for c in payload])
    right = lookup.select(F.col(lookup_key).cast("bigint").alias("_v"), F.lit(0).alias("_side"), pl.alias("_pl"))
    left = values.select(F.col(key).cast("bigint").alias("_v"), F.lit(1).alias("_side"),
                         F.lit(None).cast(right.schema["_pl"].dataType).alias("_pl"))
    # lookup rows sort before values at the same key, so key >= lookup_key hits
    u = (left.unionByName(right).repartitionByRange(n, "_v", "_side")
         .withColumn("_pid", F.spark_partition_id()))
    # range bounds are sampled anew by each exchange: the scan and the tails
    # must read one and the same partitioning, so it is written once
    checkpoint_root(spark)
    u = u.checkpoint(eager=True)
    run = Window.partitionBy("_pid").orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = u.withColumn("_hit", F.last("_pl", ignorenulls=True).over(run))
    # last lookup row of every partition, then the one each partition inherits
    tails = u.where(F.col("_side") == 0).groupBy("_pid").agg(F.max_by("_pl", "_v").alias("_tail"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = (spark.range(n).select(F.col("id").cast("int").alias("_pid"))
             .join(tails, "_pid", "left")
             .select("_pid", F.last("_tail", ignorenulls=True).over(before).alias("_carry")))
    out = (scanned.where(F.col("_side") == 1)
           .join(F.broadcast(carry), "_pid", "left")
           .select(F.col("_v").alias(key), F.coalesce("_hit", "_carry").alias("hit")))
    return out
