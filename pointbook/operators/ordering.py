"""Output orders (F1-F7) and top-k reports.

Orders apply at output only; no operator depends on row order. Residual ties
are broken by ``id`` so every order is total. Name orders use the SQLite
NOCASE key (ASCII letters folded only).

* Global reports use ``orderBy(...).limit(k)``, which Spark runs as a
  per-partition top-k followed by a merge of at most ``k`` rows per task.
* Per-student reports use ``row_number() <= k`` over a window partitioned by
  student; Spark inserts a group limit *before* the shuffle, so a student
  with a third of the ledger contributes at most ``k`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nocase


def order_keys(table: str) -> list[Column]:
    """The reference's list order for ``table`` (plus ``id`` as last key)."""
    c = F.col
    return {
        "students": [nocase("name").asc(), c("id").asc()],                          # F1
        "rules": [c("sort_order").asc(), nocase("title").asc(), c("id").asc()],     # F2
        "thresholds": [c("sort_order").asc(), c("min_points").asc(), c("id").asc()],  # F3
        "penalties": [c("occurred_on").desc(), c("created_at").desc(), c("id").asc()],  # F4
        "notes": [c("noted_on").desc(), c("created_at").desc(), c("id").asc()],     # F5
        "summary": [nocase("name").asc(), c("id").asc()],                           # F6
        # the client's min_points orders are folded into the threshold lookup
    }[table]


def sorted_rows(df: DataFrame, table: str) -> DataFrame:
    """The full list in the reference's order (a global sort: use for output)."""
    return df.orderBy(*order_keys(table))


def top_k(df: DataFrame, table: str, k: int) -> DataFrame:
    """The first ``k`` rows of the list."""
    return df.orderBy(*order_keys(table)).limit(k)


def top_k_per_group(df: DataFrame, table: str, k: int, group: str = "student_id") -> DataFrame:
    """The first ``k`` rows of each group's list, with their ``rank`` (1-based)."""
    w = Window.partitionBy(group).orderBy(*order_keys(table))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
