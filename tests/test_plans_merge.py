"""Plans of merges, deletes and look-ups; bounds by bytes; blank messages."""

import pytest
from pyspark.sql import functions as F

from pointbook.operators import ledger, messages as msg, mutate as mu
from pointbook.operators.guards import materialize_if_bounded, small_enough
from pointbook.operators.validate import missing_student, precheck, validate_sms
from pointbook.schemas import THRESHOLDS
from pointbook.sources import standin as si

from conftest import SF_SMALL, rows

AS_OF = "2024-03-01 00:00:00"


def stored(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def scans(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"/{name}")


def test_small_merge_reads_the_base_twice_and_shuffles_nothing(spark, tmp_path):
    base = stored(spark, tmp_path, si.students(spark, SF_SMALL), "base")
    new, _ = mu.upsert_students(base, si.student_upserts(spark, SF_SMALL), AS_OF)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") - plan.count("rdd_") >= 2 and scans(new, "base") == 2 and "Exchange hashpartitioning(id" not in plan
    big, _ = mu.upsert_students(base, si.student_upserts(spark, SF_SMALL), AS_OF, max_broadcast_rows=0)
    assert rows(new) == rows(big)
    touched = mu.upsert_students(base, si.student_upserts(spark, SF_SMALL), AS_OF, with_op=True)[0].where("op is not null")
    assert rows(touched.drop("op")) == rows(new.where(F.col("updated_at") == AS_OF))


def test_update_and_delete_broadcast_a_small_batch(spark, tmp_path):
    base = stored(spark, tmp_path, si.students(spark, SF_SMALL), "base")
    ledger_ = stored(spark, tmp_path, si.penalties(spark, SF_SMALL), "ledger")
    keys = spark.createDataFrame([("1",), ("1",), ("5",), (None,)], "id string")
    for df in (mu.update_students(base, si.student_upserts(spark, SF_SMALL), AS_OF), mu.delete_by_keys(ledger_, keys, "student_id"), ledger.lookup_by_keys(base, keys)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    big = mu.delete_by_keys(ledger_, keys, "student_id", max_broadcast_rows=0)
    assert rows(big) == rows(mu.delete_by_keys(ledger_, keys, "student_id")) == rows(ledger_.where("student_id not in ('1', '5')"))
    assert rows(ledger.lookup_by_keys(base, keys), "id") == [("1",), ("5",)]


def test_few_rows_of_many_bytes_are_not_broadcast(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 1000).alias("content"))
    assert small_enough(df) and not small_enough(df, max_bytes=10_000) and not small_enough(df, max_rows=19)
    kept, small = materialize_if_bounded(df, max_bytes=10_000)
    assert not small and kept is df
    kept, small = materialize_if_bounded(df)
    assert small and rows(kept) == rows(df)
    assert "GlobalLimit" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_student_check_is_one_join(spark):
    req, students = si.penalty_requests(spark, SF_SMALL), si.students(spark, SF_SMALL)
    flagged = ledger.with_student_found(req, students)
    assert flagged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    kept, rejected = ledger.student_fk_check(req, students)
    assert kept.count() + rejected.count() == req.count() == flagged.count() and kept.columns == rejected.columns == req.columns
    assert rows(rejected) == rows(req.where("student_id in ('ghost', '')"))


@pytest.mark.parametrize("given,issue,text", [(None, "message:empty", ""), ("", "message:empty", ""), (" \t　", "message:empty", ""), ("  hi ", "", "hi")])
def test_blank_messages_are_never_sent(spark, given, issue, text):
    """A template that renders blank, and blank, missing and given messages."""
    st = spark.createDataFrame([("1", "Ann", None, "010-1", None, "", "")], "id string, name string, grade string, student_phone string, parent_phone string, created_at string, updated_at string")
    led = spark.createDataFrame([("1", 9)], "student_id string, points long")
    ths = spark.createDataFrame([("t", 5, "L", " {unknown} ", 1, "", "")], THRESHOLDS)
    req = spark.createDataFrame([(1, "1", "both", given), (2, "ghost", "both", given)], "seq long, student_id string, target string, message string")
    prepared = msg.prepare_messages(req, st, led, ths)
    got = {r.seq: (",".join(r.issues), r.reject_reason) for r in prepared.collect()}
    assert got[1] == (issue, "schema" if issue else None)
    assert got[2] == (("", "student_not_found") if given is None or not issue else (issue, "schema"))
    assert [r.text for r in msg.message_outbox(prepared, "02", "b").collect()] == ([text] if text else [])
    kept = msg.prepare_messages(req, st, led, ths, totals=spark.createDataFrame([("1", 9, 1)], "student_id string, points long, rows long"))
    assert rows(kept.select("seq", "reject_reason", "text")) == rows(prepared.select("seq", "reject_reason", "text"))


def test_server_and_client_rules(spark):
    sms = spark.createDataFrame([(1, "s", "student", " "), (2, "s", "both", None), (3, "", "x", ""), (4, None, None, "m"), (5, " ", "parent", "m")],
                                "seq long, student_id string, target string, message string")
    got = {r.seq: list(r.issues) for r in validate_sms(sms).collect()}
    assert got == {1: [], 2: ["message:required"], 3: ["student_id:empty", "target:enum", "message:empty"], 4: ["student_id:required", "target:required"], 5: []}
    pre = {r.seq: list(r.precheck) for r in precheck(sms, "sms").collect()}
    assert pre == {1: ["message:blank"], 2: [], 3: ["student_id:blank", "message:blank"], 4: ["student_id:blank"], 5: []}
    assert {r.seq: list(r.issues) for r in missing_student(sms).collect()} == {3: ["student_id:empty"], 4: ["student_id:required"]}
    with pytest.raises(ValueError):
        ledger.penalties_for_student(sms, "")
