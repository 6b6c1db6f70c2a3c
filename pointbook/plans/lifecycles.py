"""Named queries: the store's lifecycles (A3, A5, C4, C10, C11, D7, E1) over the whole stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import standin as si
from . import oracles as o
from .registry import query
from .store import LedgerStore

_LEFT = f"""(SELECT * FROM penalties p WHERE id NOT IN (SELECT id FROM penalty_deletes)
 AND student_id NOT IN (SELECT id FROM student_deletes) AND NOT EXISTS (
  SELECT 1 FROM (SELECT * FROM {o.RESETS_CHECKED} c WHERE issues = '') r
  WHERE r.student_id = p.student_id AND p.occurred_on BETWEEN r."from" AND r."to"))"""


def _store(spark, sf) -> LedgerStore:
    """A store after resets, deletes by id, and deletes of students with their rows."""
    st = LedgerStore(spark, scratch_path(spark, "store"))
    st.commit("students", si.students(spark, sf))
    st.commit("penalties", si.penalties(spark, sf))
    st.commit("notes", si.notes(spark, sf))
    st.reset(si.reset_requests(spark, sf))
    st.delete("penalties", si.penalty_deletes(spark, sf))
    st.delete_students(si.student_deletes(spark, sf))
    return st


@query("store_penalties", f"SELECT * FROM {_LEFT} x")
def q_store_penalties(spark, sf):
    """C10 + C11 + D7 as committed deletes: the ledger that a read gives."""
    return _store(spark, sf).table("penalties")


@query("store_notes", "SELECT * FROM notes WHERE student_id NOT IN (SELECT id FROM student_deletes)")
def q_store_notes(spark, sf):
    """D7 in one commit: the notes that are left."""
    return _store(spark, sf).table("notes")


@query("store_summary", f"""
SELECT s.*, CAST(COALESCE(p.n, 0) AS BIGINT) AS points FROM students s LEFT JOIN (
 SELECT student_id, SUM(points) AS n FROM {_LEFT} x GROUP BY student_id) p ON p.student_id = s.id
WHERE s.id NOT IN (SELECT id FROM student_deletes)""")
def q_store_summary(spark, sf):
    """E1 from kept totals, after deletes of every kind."""
    return _store(spark, sf).summary()


@query("outbox_resumed", f"SELECT * FROM {o.sms_outbox(f'send-{o.BATCH}')} x WHERE seq % 2 = 1")
def q_outbox_resumed(spark, sf):
    """A5 handed over in two calls of one batch: what the second, overlapping one still sends."""
    st = LedgerStore(spark, scratch_path(spark, "outbox"))
    for name, table in (("students", si.students), ("penalties", si.penalties), ("thresholds", si.thresholds)):
        st.commit(name, table(spark, sf))
    requests = si.sms_requests(spark, sf)
    st.send(requests.where(F.col("seq") % 2 == 0), o.SENDER, o.BATCH)
    path, _ = st.send(requests, o.SENDER, o.BATCH)
    return spark.read.parquet(path).withColumn("pos", F.col("pos").cast("bigint"))
