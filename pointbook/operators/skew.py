"""Hot keys: split a skewed row-level join so its hot part never shuffles.

When one student holds a large share of the ledger, a join of ledger rows
with roster rows on ``student_id`` sends all of that student's rows to one
reducer. Adaptive execution can split such a partition at run time; this
module makes the split explicit and engine-independent:

1. A sample of the key column names the hot keys: keys estimated to hold at
   least ``min_rows`` rows (more than one reducer partition should take),
   at most ``max_keys`` of them. The key set is bounded by construction, so
   it may be broadcast.
2. Rows of hot keys join the (equally bounded) other-side rows of those keys
   map-side through a broadcast hash join - no shuffle at all.
   When the other side has too many rows of hot keys to broadcast (a student
   with a third of both sides), the big side's rows of hot keys get a random
   salt, the other side's are repeated once for each salt, and the two are
   joined on key and salt: each hot key is then as many reducer keys as there
   are salts, and a big row still meets every other-side row of its key once.
3. The remaining rows take the ordinary shuffled join, now free of hot keys.

The result is exact whichever keys the sample picks: hot and cold rows are
disjoint by key, and each side of the union is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import DEFAULT_BROADCAST_ROWS, materialize_counted, materialize_if_bounded

HOT_SAMPLE_FRACTION = 0.01
# About one 128 MB reducer partition of ~100-byte ledger rows.
HOT_MIN_ROWS = 1_000_000
HOT_MAX_KEYS = 1_000
# Parts that a hot key is dealt into beyond the broadcast bound; the other side's hot rows are repeated as often.
HOT_SALTS = 32


def hot_keys(df: DataFrame, key: str, sample_fraction: float = HOT_SAMPLE_FRACTION,
             min_rows: int = HOT_MIN_ROWS, max_keys: int = HOT_MAX_KEYS, seed: int = 17) -> DataFrame | None:
    """Keys of ``df`` estimated from a ``sample_fraction`` sample to hold at least
    ``min_rows`` rows (at most ``max_keys``, the heaviest first), checkpointed;
    None when there is none. Reads only the key column, in one pass."""
    threshold = max(1.0, min_rows * sample_fraction)
    counts = (df.select(F.col(key).alias("_hk")).sample(False, sample_fraction, seed)
              .where(F.col("_hk").isNotNull())
              .groupBy("_hk").agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") >= F.lit(threshold)))
    hot = counts.orderBy(F.col("_n").desc()).limit(max_keys).select(F.col("_hk").alias(key))
    hot, n = materialize_counted(hot, max_keys)  # already at most max_keys rows
    return hot if n else None


def join_splitting_hot_keys(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
                            hot: DataFrame | None, how: str = "inner", extra: Column | None = None,
                            max_small_rows: int = DEFAULT_BROADCAST_ROWS, salts: int = HOT_SALTS) -> DataFrame:
    """``big.join(small, big_key == small_key [AND extra], how)`` in which the
    rows of ``hot`` keys are joined map-side against the broadcast ``small``
    rows of those keys (proven to be at most ``max_small_rows``), and only
    the other rows are shuffled. ``how`` is any join that keeps ``big`` rows
    independent of each other (inner, left, left_semi, left_anti); the two
    parts are disjoint by key, so their union is the whole join. When the small
    side's hot rows exceed the bound, the hot part is joined on key and salt
    (``salts`` parts a key). Without hot keys it is the plain join."""
    cond = F.col(big_key) == F.col(small_key)
    if extra is not None:
        cond = cond & extra
    if hot is None:
        return big.join(small, cond, how)
    hk = F.broadcast(hot.select(F.col(hot.columns[0]).alias("_hot")))
    small_hot, bounded = materialize_if_bounded(small.join(hk, F.col(small_key) == F.col("_hot"), "left_semi"),
                                                max_small_rows)
    big_hot = big.join(hk, F.col(big_key) == F.col("_hot"), "left_semi")
    # rows without a key (left and anti joins keep them) are cold
    big_cold = big.join(hk, F.col(big_key) == F.col("_hot"), "left_anti")
    cold = big_cold.join(small, cond, how)
    if bounded:
        return big_hot.join(F.broadcast(small_hot), cond, how).unionByName(cold)
    # the salt is made of the row, not drawn: a task that is run again deals the row to the same part
    dealt = big_hot.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in big.columns)), F.lit(salts)).cast("int"))
    repeated = small.join(hk, F.col(small_key) == F.col("_hot"), "left_semi").withColumn(
        "_small_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = dealt.join(repeated, cond & (F.col("_salt") == F.col("_small_salt")), how)
    return salted.drop("_salt", "_small_salt").unionByName(cold)


def join_ledger_with_requests(big: DataFrame, requests: DataFrame, big_key: str, request_key: str,
                              how: str, extra: Column | None = None, split_hot: bool = True,
                              max_request_rows: int = DEFAULT_BROADCAST_ROWS, **hot_kw) -> DataFrame:
    """Join ledger rows with a batch of requests on the student key.

    A batch proven small (at most ``max_request_rows`` rows, and few bytes) is
    broadcast: the ledger is scanned once, map-side, with no shuffle and no
    hot-key sampling. A larger batch takes the shuffled join with hot students
    split off (``split_hot``).
    """
    from .guards import small_enough

    cond = F.col(big_key) == F.col(request_key)
    if extra is not None:
        cond = cond & extra
    if small_enough(requests, max_request_rows):
        return big.join(F.broadcast(requests), cond, how)
    hot = hot_keys(big, big_key, **hot_kw) if split_hot else None
    return join_splitting_hot_keys(big, requests, big_key, request_key, hot, how, extra)
