"""Recipients, outbox, roster files, snapshots, streaming and the driver entry."""

import os
import tempfile

from pyspark.sql import functions as F

from pointbook.operators import messages as msg
from pointbook.sources import normalize_roster, read_roster_file, read_snapshot, write_snapshot
from pointbook.sources import standin as si
from pointbook.sources.tables import committed_versions

from conftest import SF_SMALL, rows


def test_recipients_dedupe_and_no_recipient(spark):
    s = spark.createDataFrame([
        ("1", "Kim", "010-1", "0101"), ("2", "Lee", None, None), ("3", "Park", "1", "010-9")],
        "id string, name string, student_phone string, parent_phone string")
    req = spark.createDataFrame([(1, "1", "both", None), (2, "2", "parent", None), (3, "3", "parent", "hi"),
                                 (4, "x", "both", None), (5, "3", "nobody", None)],
                                "seq bigint, student_id string, target string, message string")
    empty_ledger = spark.createDataFrame([], "student_id string, points bigint")
    prepared = msg.prepare_messages(req, s.withColumn("grade", F.lit(None).cast("string"))
                                    .withColumn("created_at", F.lit("t")).withColumn("updated_at", F.lit("t")),
                                    empty_ledger, si.thresholds(spark))
    p = {r.seq: r for r in prepared.collect()}
    assert p[1].recipients == ["0101"] and p[1].reject_reason is None
    assert p[2].reject_reason == "no_recipient"
    assert p[3].recipients == ["0109"] and p[3].text == "hi"
    assert p[4].reject_reason == "student_not_found"
    assert p[5].reject_reason == "schema"
    out = rows(msg.message_outbox(prepared, "02-123", "b1"), "seq", "pos", "to", "from")
    assert out == [(1, 0, "0101", "02123"), (3, 0, "0109", "02123")]


def test_outbox_counts_sf0001(spark):
    prepared = msg.prepare_messages(si.sms_requests(spark, SF_SMALL), si.students(spark, SF_SMALL),
                                    si.penalties(spark, SF_SMALL), si.thresholds(spark))
    assert msg.message_outbox(prepared, "02", "b1").count() == 160
    assert prepared.where("reject_reason = 'no_recipient'").count() == 6
    from pointbook.functions import normalize_phone

    s = si.students(spark, SF_SMALL)
    both = s.where(normalize_phone("student_phone").isNotNull() & normalize_phone("parent_phone").isNotNull())
    one = prepared.where((F.size("recipients") == 1) & (F.col("target") == "both")).select("student_id")
    assert both.join(one, both.id == one.student_id, "left_semi").count() == 23


def test_roster_csv_korean_headers(spark):
    d = tempfile.mkdtemp(prefix="roster-", dir="/tmp")
    path = os.path.join(d, "roster.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("ID,이름,학년,학생전화\n 1 ,김 수　,,010-1\n2,,G2,\n3,이,G3,\n")
    df = normalize_roster(read_roster_file(spark, path))
    assert rows(df, "id", "name", "grade", "student_phone", "parent_phone") == [
        ("1", "김 수", "", "010-1", ""), ("2", "", "G2", "", ""), ("3", "이", "G3", "", "")]
    assert [r.id for r in df.orderBy("seq").collect()] == ["1", "2", "3"]


def test_snapshot_versions(spark):
    root = tempfile.mkdtemp(prefix="snap-", dir="/tmp")
    df = si.students(spark, SF_SMALL)
    assert write_snapshot(df.limit(3), root, "students") == 0
    assert write_snapshot(df, root, "students") == 1
    assert committed_versions(spark, root, "students") == [0, 1]
    assert read_snapshot(spark, root, "students").count() == df.count()
    assert read_snapshot(spark, root, "students", version=0).count() == 3


def test_entry_smoke(spark):
    import __spark_entry__ as se

    df = se.entry(spark)
    assert df.columns == ["outbox_id", "seq", "student_id", "pos", "to", "from", "text"]
    assert df.count() == 160


def test_read_requests_json_and_outbox_sink(spark, tmp_path):
    from pointbook.operators.mutate import assign_penalties
    from pointbook.sources import read_requests

    f = tmp_path / "req.json"
    f.write_text('{"seq": 2, "student_id": "1", "rule_id": "rule_click", "occurred_on": "2024-01-02"}\n'
                 '{"student_id": "ghost", "rule_id": "rule_click", "occurred_on": "2024-01-03", "memo": "m"}\n',
                 encoding="utf-8")
    req = read_requests(spark, str(f), "penalty_requests")
    assert req.schema["seq"].dataType.typeName() == "long" and req.where("seq IS NULL").count() == 0
    d = {r.student_id: r.reject_reason for r in assign_penalties(
        req, si.rules(spark, SF_SMALL), si.students(spark, SF_SMALL), "2024-03-01 00:00:00", "b1").collect()}
    assert d == {"1": None, "ghost": "student_not_found"}

    prepared = msg.prepare_messages(si.sms_requests(spark, SF_SMALL), si.students(spark, SF_SMALL),
                                    si.penalties(spark, SF_SMALL), si.thresholds(spark))
    out = msg.message_outbox(prepared, "02", "b1")
    path = msg.write_outbox(out, str(tmp_path / "outbox"), 0)
    msg.write_outbox(out, str(tmp_path / "outbox"), 0)  # retry of the same batch
    assert spark.read.parquet(path).count() == 160


def test_roster_numeric_cells_print_like_js(spark):
    df = spark.createDataFrame([(1, 123.0, "Kim", 2.5, None)], "seq bigint, ID double, `이름` string, `학년` double, `학생전화` string")
    r = normalize_roster(df).first()
    assert (r.id, r.name, r.grade, r.student_phone, r.parent_phone) == ("123", "Kim", "2.5", "", "")


def test_roster_json_and_parquet(spark, tmp_path):
    j = tmp_path / "roster.json"
    j.write_text('{"ID": 12, "이름": " Kim ", "학년": "G1", "seq": 2}\n{"ID": "13", "이름": "Lee", "seq": 1}\n',
                 encoding="utf-8")
    df = normalize_roster(read_roster_file(spark, str(j), fmt="json", seq_col="seq"))
    assert rows(df, "seq", "id", "name", "grade", "parent_phone") == [(1, "13", "Lee", "", ""), (2, "12", "Kim", "G1", "")]
    pq = str(tmp_path / "roster.parquet")
    spark.createDataFrame([(7.0, "Park", 1)], "ID double, `이름` string, seq long").write.parquet(pq)
    df2 = normalize_roster(read_roster_file(spark, pq, fmt="parquet", seq_col="seq"))
    assert rows(df2, "id", "name") == [("7", "Park")]
