"""Named queries: cumulative points (E1), threshold lookups."""

from __future__ import annotations

from ..operators import ledger
from ..operators import thresholds as th
from ..sources import standin as si
from . import oracles as o
from .registry import query


@query("cumulative_points", """
SELECT s.id, s.name, s.grade, s.student_phone, s.parent_phone, s.created_at, s.updated_at,
 CAST(COALESCE(SUM(p.points), 0) AS BIGINT) AS points
FROM students s LEFT JOIN penalties p ON p.student_id = s.id
GROUP BY s.id, s.name, s.grade, s.student_phone, s.parent_phone, s.created_at, s.updated_at""")
def q_cumulative_points(spark, sf):
    """Per student totals, zero-filled."""
    return ledger.cumulative_points(si.students(spark, sf), si.penalties(spark, sf))


# == thresholds ===============================================================


def _totals(spark, sf):
    return ledger.cumulative_points(si.students(spark, sf), si.penalties(spark, sf))


def _status(spark, sf):
    return th.threshold_status(_totals(spark, sf), si.thresholds(spark, sf))


@query("threshold_status", f"SELECT * FROM {o.STATUS} s")
def q_threshold_status(spark, sf):
    """D4 + I13: reached threshold (badge tie rule) and badge per student."""
    return _status(spark, sf)


@query("best_threshold", f"SELECT * FROM {o.BEST} b")
def q_best_threshold(spark, sf):
    """Reached threshold under the message tie rule, per student."""
    return th.best_threshold(_totals(spark, sf), si.thresholds(spark, sf))


@query("exceeded_students", f"SELECT * FROM {o.STATUS} s WHERE threshold_id IS NOT NULL")
def q_exceeded_students(spark, sf):
    """Students at or over a threshold."""
    return th.exceeded_students(_status(spark, sf))


@query("status_counts", f"SELECT badge, CAST(count(*) AS BIGINT) AS students FROM {o.STATUS} s GROUP BY badge")
def q_status_counts(spark, sf):
    """E5: students per badge."""
    return th.status_counts(_status(spark, sf))


@query("badge_label", f"SELECT student_id, badge FROM {o.STATUS} s")
def q_badge_label(spark, sf):
    """Badge text (label, ``>=min`` or the normal badge)."""
    return _status(spark, sf).select("student_id", "badge")
