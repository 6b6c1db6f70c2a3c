"""API surface beyond the registered queries: client prechecks, merge op flags,
request-file streams, stream-total compaction."""

from pyspark.sql import functions as F

from pointbook.operators import mutate as mu
from pointbook.operators.validate import precheck
from pointbook.session import scratch_path
from pointbook.sources import read_snapshot
from pointbook.sources import standin as si
from pointbook.sources.requests import stream_requests
from pointbook.streaming.ingest import (compact_stream_totals, read_assigned, read_parquet_stream,
                                        read_stream_totals, stream_assign, stream_totals)

from conftest import SF_SMALL, rows

AS_OF = "2024-03-01 00:00:00"


def test_precheck_forms(spark):
    pen = spark.createDataFrame([(1, " ", "r"), (2, "s", "")], "seq bigint, student_id string, rule_id string")
    assert rows(precheck(pen, "penalties").select("seq", F.array_join("precheck", ","))) == [
        (1, ""), (2, "rule_id:blank")]
    notes = spark.createDataFrame([(1, "s", "　\t"), (2, "s", "ok")], "seq bigint, student_id string, content string")
    assert rows(precheck(notes, "notes").select("seq", F.array_join("precheck", ","))) == [
        (1, "content:blank"), (2, "")]
    sms = spark.createDataFrame([(1, "s", " "), (2, "s", None), (3, "", "hi")],
                                "seq bigint, student_id string, message string")
    assert rows(precheck(sms, "sms").select("seq", F.array_join("precheck", ","))) == [
        (1, "message:blank"), (2, ""), (3, "student_id:blank")]


def test_merge_op_flags_both_plans(spark):
    base = si.students(spark, SF_SMALL)
    ch = spark.createDataFrame([("1", "A", None, None, None), ("new1", "B", None, None, None)],
                               "id string, name string, grade string, student_phone string, parent_phone string")
    for bound in (0, 1000):
        out = mu.merge_upsert(base, ch, "id", mu.STUDENT_FIELDS, AS_OF, with_op=True, max_broadcast_rows=bound)
        ops = dict(rows(out.where(F.col("op").isNotNull()), "id", "op"))
        assert ops == {"1": "updated", "new1": "inserted"}
        assert out.count() == base.count() + 1


def test_request_file_stream_into_assign(spark, tmp_path):
    src = tmp_path / "requests"
    src.mkdir()
    (src / "a.json").write_text(
        '{"seq": 1, "student_id": "1", "rule_id": "rule_click", "occurred_on": "2024-01-02"}\n'
        '{"seq": 2, "student_id": "2", "rule_id": "rule_nope", "occurred_on": "2024-01-02"}\n', encoding="utf-8")
    (src / "b.json").write_text(
        '{"seq": 3, "student_id": "ghost", "rule_id": "rule_view", "occurred_on": "2024-01-03"}\n', encoding="utf-8")
    out, ck = scratch_path(spark, "t_req", "out"), scratch_path(spark, "t_req", "ck")
    stream = stream_requests(spark, str(src), "penalty_requests", max_files_per_trigger=1)
    stream_assign(stream, lambda: si.rules(spark, SF_SMALL), lambda: si.students(spark, SF_SMALL), out, ck,
                  lambda batch_id: f"2024-03-0{batch_id + 1} 00:00:00", "s1").awaitTermination()
    got = {r.seq: (r.reject_reason, r.created_at) for r in read_assigned(spark, out).collect()}
    assert got[2][0] == "rule_not_found" and got[3][0] == "student_not_found" and got[1][0] is None
    assert spark.read.parquet(out).select("batch").distinct().count() == 2


def test_compact_stream_totals(spark):
    root, ck = scratch_path(spark, "t_cmp", "out"), scratch_path(spark, "t_cmp", "ck")
    stream_totals(si.penalties_from_events(read_parquet_stream(spark, SF_SMALL, "events.parquet")), root, ck
                  ).awaitTermination()
    snap = scratch_path(spark, "t_cmp", "snap")
    v = compact_stream_totals(spark, root, snap)
    t = read_snapshot(spark, snap, "totals", version=v, schema="student_id string, points bigint, rows bigint")
    assert rows(t) == rows(read_stream_totals(spark, root))
