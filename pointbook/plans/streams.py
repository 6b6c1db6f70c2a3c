"""Named queries: the streaming operators (S1, S2) run to completion on the
driver's events directory (``availableNow``) and read back from their sink."""

from __future__ import annotations

from ..operators.ledger import with_points
from ..operators.mutate import accepted_penalties
from ..session import scratch_path
from ..sources import standin as si
from ..streaming.ingest import (read_assigned, read_parquet_stream, read_stream_totals, read_total_changes, stream_assign,
                                stream_assign_into, stream_totals)
from . import oracles as o
from .registry import query
from .store import LedgerStore


def _events_stream(spark, sf):
    return read_parquet_stream(spark, sf, "events.parquet")


@query("stream_assign", f"""
SELECT {', '.join(o.PENALTY_COLS)} FROM {o.assign_decided(f'{o.BATCH}-0')} d WHERE reject_reason IS NULL""")
def q_stream_assign(spark, sf):
    """Assign requests ingested as a stream, each micro-batch through the
    batch assign operator; the ledger rows it appended."""
    out, ck = scratch_path(spark, "stream_assign", "out"), scratch_path(spark, "stream_assign", "ckpt")
    requests = si.penalty_requests_from_events(_events_stream(spark, sf))
    q = stream_assign(requests, lambda: si.rules(spark, sf), lambda: si.students(spark, sf), out, ck, o.AS_OF, o.BATCH)
    q.awaitTermination()
    return accepted_penalties(read_assigned(spark, out))


@query("stream_assign_store", f"""
SELECT s.*, CAST(COALESCE(p.n, 0) AS BIGINT) AS points FROM students s LEFT JOIN (
 SELECT student_id, SUM(points) AS n FROM {o.assign_decided(f'{o.BATCH}-0')} d WHERE reject_reason IS NULL GROUP BY student_id
) p ON p.student_id = s.id""")
def q_stream_assign_store(spark, sf):
    """S1 into a store: the roster with the totals that the stream's commits keep."""
    root = scratch_path(spark, "stream_assign_store")
    st = LedgerStore(spark, f"{root}/store")
    st.commit("students", si.students(spark, sf))
    st.commit("rules", si.rules(spark, sf))
    requests = si.penalty_requests_from_events(_events_stream(spark, sf))
    stream_assign_into(st, requests, f"{root}/ckpt", o.AS_OF, o.BATCH).awaitTermination()
    return st.summary()


@query("stream_totals", f"SELECT * FROM {o.TOTALS} t")
def q_stream_totals(spark, sf):
    """Running totals from the ledger stream, zero-filled over the roster."""
    root, ck = scratch_path(spark, "stream_totals", "out"), scratch_path(spark, "stream_totals", "ckpt")
    ledger = si.penalties_from_events(_events_stream(spark, sf))
    q = stream_totals(ledger, root, ck)
    q.awaitTermination()
    return with_points(si.students(spark, sf), read_stream_totals(spark, root))


@query("stream_totals_signed", """
SELECT student_id, CAST(SUM(points) AS BIGINT) AS points, CAST(count(*) AS BIGINT) AS rows FROM penalties
WHERE id NOT IN (SELECT id FROM penalty_deletes) GROUP BY student_id""")
def q_stream_totals_signed(spark, sf):
    """S2 under deletions: a store's corrections (the ledger, then rows deleted by id) as a stream; totals go down."""
    root = scratch_path(spark, "stream_totals_signed")
    st = LedgerStore(spark, f"{root}/store")
    st.commit("penalties", si.penalties(spark, sf))
    st.delete("penalties", si.penalty_deletes(spark, sf))
    stream_totals(read_total_changes(spark, st.feed_path()), f"{root}/out", f"{root}/ckpt").awaitTermination()
    return read_stream_totals(spark, f"{root}/out")
