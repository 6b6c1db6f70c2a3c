"""End-to-end lifecycles on versioned tables (open -> import -> assign -> reset -> send -> delete)."""

from pyspark.sql import functions as F

from pointbook.plans.store import LedgerStore
from pointbook.schemas import PENALTY_REQUESTS, TABLES
from pointbook.sources import standin as si

from conftest import SF_SMALL

T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


import pytest


@pytest.mark.parametrize("buckets", [None, 8])
def test_store_lifecycle(spark, tmp_path, buckets):
    st = LedgerStore(spark, str(tmp_path), buckets=buckets)
    st.open(T0)
    assert {r.id for r in st.table("rules").collect()} == {"rule_late", "rule_phone", "rule_sleep"}
    assert st.table("thresholds").count() == 2
    st.open(T0)  # re-open: no second seeding
    assert st.table("rules").count() == 3

    # roster from the students stand-in, then the rules of the events
    roster = si.students(spark, SF_SMALL).select(F.col("id").cast("long").alias("seq"), "id", "name", "grade",
                                                  "student_phone", "parent_phone")
    assert st.import_roster(roster, T1) == 150
    rules = si.rules(spark, SF_SMALL).select(F.lit(1).cast("long").alias("seq"), "id", "title",
                                             F.col("points").cast("string").alias("points"),
                                             F.col("is_active").cast("string").alias("is_active"),
                                             F.col("sort_order").cast("string").alias("sort_order"))
    assert st.upsert_rules(rules, T1, "r1").count() == 0

    rejects = st.assign(si.penalty_requests(spark, SF_SMALL), T1, "p1")
    assert st.table("penalties").count() == 957 and rejects.count() == 43
    before = st.table("penalties").count()
    counts = st.reset(spark.createDataFrame([(1, "3", "2024-01-05", "2024-01-12")],
                                            "seq bigint, student_id string, `from` string, `to` string"))
    deleted = counts.first().deleted
    assert deleted > 0 and st.table("penalties").count() == before - deleted
    assert st.summary().agg(F.sum("points")).first()[0] == st.table("penalties").agg(F.sum("points")).first()[0]

    path, bad = st.send(si.sms_requests(spark, SF_SMALL), "02-000", 0)
    assert spark.read.parquet(path).count() > 0 and bad.count() == 27

    st.delete_students(spark.createDataFrame([("3",)], "id string"))
    assert st.table("penalties").where("student_id = '3'").count() == 0
    assert st.summary().where("id = '3'").count() == 0 and st.totals().where("student_id = '3'").count() == 0


def test_bucketed_store_summary_has_no_shuffle(spark, tmp_path):
    st = LedgerStore(spark, str(tmp_path), buckets=8)
    st.open(T0)
    st.commit("students", si.students(spark, SF_SMALL))
    st.commit("penalties", si.penalties(spark, SF_SMALL))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = st.summary()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def _small_store(spark, root):
    st = LedgerStore(spark, root)
    st.open(T0)
    st.commit("students", spark.createDataFrame([("1", "Ann", None, "010", None, T0, T0)], TABLES["students"]))
    return st


def test_equal_seq_in_two_batches_keeps_both(spark, tmp_path):
    st = _small_store(spark, str(tmp_path))
    req = spark.createDataFrame([(1, "1", "rule_late", "2024-01-05", None)], PENALTY_REQUESTS)
    st.assign(req, T1, "a")
    st.assign(req, T1, "b")
    assert st.table("penalties").select("id").distinct().count() == 2
    st.assign(req, T1, "b")  # a retry
    assert st.table("penalties").count() == 2
    for batch, text in (("n1", "first"), ("n2", "second")):
        st.upsert_notes(spark.createDataFrame([(1, None, "1", "2024-01-05", text)],
                                              "seq bigint, id string, student_id string, noted_on string, content string"), T1, batch)
    assert {r.content for r in st.table("notes").collect()} == {"first", "second"}
    sends = spark.createDataFrame([("1", "student", "hi", 1)], "student_id string, target string, message string, seq bigint")
    ids = [spark.read.parquet(st.send(sends, "02", n)[0]).first().outbox_id for n in (0, 1)]
    assert ids[0] != ids[1]


def test_append_retry_after_commit_adds_nothing(spark, tmp_path):
    st = _small_store(spark, str(tmp_path))
    req = spark.createDataFrame([(1, "1", "rule_late", "2024-01-05", None)], PENALTY_REQUESTS)
    st.assign(req, T1, "a")
    st.commit("penalties", st.table("penalties"))  # folds the batch in
    st.assign(req, T1, "a")
    assert st.table("penalties").count() == 1
    with pytest.raises(ValueError):
        st.assign(req, T1, "2024-03-01T00:00:00")


def test_deleting_students_leaves_no_orphans(spark, tmp_path):
    st = _small_store(spark, str(tmp_path))
    st.assign(spark.createDataFrame([(1, "1", "rule_late", "2024-01-05", None)], PENALTY_REQUESTS), T1, "a")
    st.delete("students", spark.createDataFrame([("1",)], "id string"))
    assert [st.table(t).count() for t in ("students", "penalties", "notes")] == [0, 0, 0]
