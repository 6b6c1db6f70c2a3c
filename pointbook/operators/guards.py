"""Size guards: broadcast only what a bounded check has proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root

# Largest side broadcast on a row-count proof. Configuration tables (rules,
# thresholds) hold tens of rows; 100k narrow rows stay far below the
# broadcast size limits on every executor.
DEFAULT_BROADCAST_ROWS = 100_000

# Largest side broadcast, in bytes: rows with texts may be few and yet large.
BROADCAST_BYTES = 32 << 20


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain count: one partial count per task, and no column is read from a
    bare scan. Callers apply it to configuration tables and request batches,
    never to the ledger.
    """
    return df.count() <= max_rows


def few_per_key(df: DataFrame, key: str, max_rows: int = DEFAULT_BROADCAST_ROWS, max_per_key: int = 32) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and no key has more than
    ``max_per_key`` of them: a row joined with it on the key and a further
    condition then meets a bounded number of rows. One job over ``df`` (a
    request batch), counted per key in the tasks first."""
    got = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    return (got[0] or 0) <= max_rows and (got[1] or 0) <= max_per_key


def size_of(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of their values as text), in one job."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(8))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return n, size or 0


def small_enough(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows that take at most ``max_bytes``: it may be broadcast."""
    n, size = size_of(df)
    return n <= max_rows and size <= max_bytes


def materialize_if_bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Prove ``df`` small and keep it: ``(checkpointed df, True)`` when it has
    at most ``max_rows`` rows and ``max_bytes`` bytes, else ``(df, False)``.

    Rows and bytes are counted in the tasks. A small ``df`` is then checkpointed
    to the shared checkpoint folder (reliable, survives executor loss, cuts
    lineage), so later plans read it instead of recomputing it.
    """
    if not small_enough(df, max_rows, max_bytes):
        return df, False
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True), True


def materialize_counted(df: DataFrame, max_rows: int) -> tuple[DataFrame, int]:
    """The first ``max_rows + 1`` rows of ``df`` checkpointed (reliable, in the
    shared checkpoint folder) and their count (at most ``max_rows + 1``)."""
    from pyspark import StorageLevel

    checkpoint_root(df.sparkSession)
    # an eager checkpoint runs its input once to count it and once more to
    # write it; persisting the (bounded) head first makes that one computation
    head = df.limit(max_rows + 1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        saved = head.checkpoint(eager=True)
    finally:
        head.unpersist()
    return saved, saved.count()


def restrict_to_keys(tables: list[tuple[DataFrame, str]], requests: DataFrame, request_key: str,
                     max_rows: int = DEFAULT_BROADCAST_ROWS) -> list[DataFrame]:
    """Narrow large tables to the keys a request batch names, when that key
    set is proven small.

    A batch of a few requests should not aggregate the whole ledger or
    shuffle the whole roster: a batch of at most ``max_rows`` requests
    has at most that
    many distinct keys, which are broadcast into a semi-join, so each table is only scanned and
    filtered map-side before any aggregation or shuffle. A key set beyond
    the bound leaves the tables as they are (the caller's aggregate-first
    plan is then the cheaper one).
    """
    # the raw batch bounds its distinct keys; a larger batch keeps the
    # aggregate-first plan
    if not row_count_at_most(requests, max_rows):
        return [t for t, _ in tables]
    b = F.broadcast(requests.select(F.col(request_key).alias("_key")).distinct())
    return [t.join(b, F.col(col) == F.col("_key"), "left_semi") for t, col in tables]
