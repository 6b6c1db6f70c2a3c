"""Threshold lookups: which threshold a student's total has reached.

A student with total ``p`` reaches every threshold with ``min_points <= p``;
the one shown is the reached threshold with the greatest ``min_points``.
When several thresholds share that ``min_points`` the two uses break the
tie in opposite directions (the reference sorts the same list once
ascending and takes the last hit, once descending and takes the first):

* badge (D4):   the LAST in (sort_order, id) order wins
* message (D5): the FIRST in (sort_order, id) order wins

Plan: ties are collapsed per ``min_points`` first, which leaves disjoint
intervals ``[min_points, next min_points)``. When the threshold table is
proven small (bounded row count) the intervals are broadcast and matched by
a range condition (broadcast nested-loop left join, exactly one match per
student, no re-aggregation). Beyond the bound, the lookup goes through the
distinct totals and a range-partitioned as-of scan, and the result is
equi-joined back on the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import badge_label
from .asof import asof_floor
from .guards import row_count_at_most

# The broadcast plan is a nested-loop join: every student is compared with
# every broadcast interval, so its bound is set by per-row cost (students x
# thresholds comparisons), not by memory. Threshold tables hold a handful of
# rows; beyond this bound the sort-based as-of plan is cheaper.
THRESHOLD_BROADCAST_ROWS = 1_000

KEEP_LAST = "last"    # badge tie rule
KEEP_FIRST = "first"  # message tie rule

_PAYLOAD = ["id", "min_points", "label", "message_template", "sort_order"]


def collapse_ties(thresholds: DataFrame, keep: str) -> DataFrame:
    """One threshold per ``min_points``: the last (``keep='last'``) or first
    (``keep='first'``) in (sort_order, id) order."""
    order = F.struct("sort_order", "id")
    payload = F.struct(*_PAYLOAD)
    pick = F.max_by(payload, order) if keep == KEEP_LAST else F.min_by(payload, order)
    return thresholds.groupBy("min_points").agg(pick.alias("_t")).select("_t.*")


def threshold_lookup(totals: DataFrame, thresholds: DataFrame, keep: str, points_col: str = "points",
                     max_broadcast_rows: int = THRESHOLD_BROADCAST_ROWS) -> DataFrame:
    """``totals`` + the reached threshold as ``threshold_id``, ``threshold_min_points``,
    ``threshold_label``, ``threshold_template``, ``threshold_sort_order``
    (all NULL when none is reached)."""
    t = collapse_ties(thresholds, keep)
    out_cols = {
        "id": "threshold_id", "min_points": "threshold_min_points", "label": "threshold_label",
        "message_template": "threshold_template", "sort_order": "threshold_sort_order",
    }
    p = F.col(points_col)
    # the raw table is a stored configuration table: counted by task, and the
    # collapse is recomputed inside the broadcast
    if row_count_at_most(thresholds, max_broadcast_rows):
        # bounded: a window without partitioning is fine on <= max rows
        iv = t.withColumn("_hi", F.lead("min_points").over(Window.orderBy("min_points")))
        iv = iv.select(*[F.col(k).alias(v) for k, v in out_cols.items()], "_hi")
        j = totals.join(F.broadcast(iv),
                        (p >= F.col("threshold_min_points")) & (F.col("_hi").isNull() | (p < F.col("_hi"))),
                        "left")
        return j.drop("_hi")
    values = totals.select(p.alias("_p")).distinct()
    hits = asof_floor(values, "_p", t, "min_points", _PAYLOAD)
    hits = hits.select("_p", *[F.col(f"hit.{k}").alias(v) for k, v in out_cols.items()])
    return totals.join(hits, p == F.col("_p"), "left").drop("_p")


def threshold_status(totals: DataFrame, thresholds: DataFrame, **kw) -> DataFrame:
    """Per student the reached threshold (badge tie rule) and the badge
    text (I13): label, ``>=min`` for an empty label, or the normal badge."""
    j = threshold_lookup(totals, thresholds, KEEP_LAST, **kw)
    return j.select(
        F.col("id").alias("student_id"), "name", "points", "threshold_id",
        badge_label("threshold_id", "threshold_label", "threshold_min_points").alias("badge"))


def best_threshold(totals: DataFrame, thresholds: DataFrame, **kw) -> DataFrame:
    """``totals`` + the reached threshold under the message tie rule."""
    return threshold_lookup(totals, thresholds, KEEP_FIRST, **kw)


def exceeded_students(status: DataFrame) -> DataFrame:
    """Students at or over some threshold."""
    return status.where(F.col("threshold_id").isNotNull())


def status_counts(status: DataFrame) -> DataFrame:
    """E5: number of students per badge."""
    return status.groupBy("badge").agg(F.count(F.lit(1)).alias("students"))
