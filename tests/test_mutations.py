"""Mutation semantics (C1-C13) and properties from the survey's test strategy."""

import pytest
from pyspark.sql import functions as F

from pointbook.operators import mutate as mu
from pointbook.operators.ledger import cumulative_points
from pointbook.sources import standin as si

from conftest import SF_SMALL, rows

AS_OF = "2024-03-01 00:00:00"
S_SCHEMA = "id string, name string, grade string, student_phone string, parent_phone string, created_at string, updated_at string"
U_SCHEMA = "seq bigint, id string, name string, grade string, student_phone string, parent_phone string"


def students(spark):
    return spark.createDataFrame([
        ("1", "Kim", "G1", "010-1", "010-2", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
        ("2", "Lee", "G2", None, "010-3", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
    ], S_SCHEMA)


@pytest.mark.parametrize("bound", [0, 1000])
def test_upsert_students_null_overwrites_created_kept(spark, bound):
    ch = spark.createDataFrame([
        (1, "1", "Kim2", None, "", None),      # NULL grade overwrites, '' stays ''
        (2, "3", "Park", "", None, None),      # insert
        (3, "3", "Park2", "G3", None, None),   # later request wins
        (4, "", "Bad", None, None, None),      # rejected
    ], U_SCHEMA)
    new, bad = mu.upsert_students(students(spark), ch, AS_OF, max_broadcast_rows=bound)
    got = {r.id: r for r in new.collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].name, got["1"].grade, got["1"].student_phone) == ("Kim2", None, "")
    assert got["1"].created_at == "2024-01-01 00:00:00" and got["1"].updated_at == AS_OF
    assert (got["3"].name, got["3"].grade, got["3"].created_at) == ("Park2", "G3", AS_OF)
    assert got["2"].updated_at == "2024-01-01 00:00:00"
    assert [r.seq for r in bad.collect()] == [4]


def test_upsert_idempotent(spark):
    ch = spark.createDataFrame([(1, "1", "Kim2", None, "", None), (2, "9", "New", "G", None, None)], U_SCHEMA)
    once, _ = mu.upsert_students(students(spark), ch, AS_OF)
    twice, _ = mu.upsert_students(once, ch, AS_OF)
    assert rows(once) == rows(twice)


def test_import_empty_becomes_null_last_wins_and_count(spark):
    roster = spark.createDataFrame([
        (1, " 1 ", "Kim3 ", "", "010", ""),
        (2, "4", "Choi", "G4", "", ""),
        (3, "4", "Choi2", "", "", ""),
        (4, "5", "　", "G", "", ""),   # blank name after trim -> dropped
    ], "seq bigint, ID string, `이름` string, `학년` string, `학생전화` string, `보호자전화` string")
    new, imported = mu.import_students(students(spark), roster, AS_OF)
    got = {r.id: r for r in new.collect()}
    assert imported.collect()[0].imported == 3
    assert (got["1"].name, got["1"].grade, got["1"].student_phone, got["1"].parent_phone) == ("Kim3", None, "010", None)
    assert (got["4"].name, got["4"].grade) == ("Choi2", None)
    assert "5" not in got


def test_import_is_fold_of_single_upserts(spark):
    """Import of a batch = applying its rows one at a time."""
    roster = spark.createDataFrame([(1, "7", "A", "g", "", ""), (2, "7", "B", "", "p", ""), (3, "1", "C", "", "", "")],
                                   "seq bigint, id string, name string, grade string, student_phone string, parent_phone string")
    batch, _ = mu.import_students(students(spark), roster, AS_OF)
    cur = students(spark)
    for r in roster.orderBy("seq").collect():
        cur, _ = mu.import_students(cur, spark.createDataFrame([tuple(r)], roster.schema), AS_OF)
    assert rows(batch) == rows(cur)


def test_update_unknown_id_noop(spark):
    ch = spark.createDataFrame([(1, "99", "Ghost", None, None, None), (2, "2", "Lee2", None, None, None)], U_SCHEMA)
    new = mu.update_students(students(spark), ch, AS_OF)
    assert rows(new, "id", "name") == [("1", "Kim"), ("2", "Lee2")]


def test_delete_cascade_no_orphans(spark):
    p = si.penalties(spark, SF_SMALL)
    n = si.notes(spark, SF_SMALL)
    s = si.students(spark, SF_SMALL)
    keys = spark.createDataFrame([("3",), ("4",), ("unknown",)], "id string")
    s2, p2, n2 = mu.delete_students(s, p, n, keys)
    assert s2.count() == s.count() - 2
    assert p2.where(F.col("student_id").isin("3", "4")).count() == 0
    assert n2.where(F.col("student_id").isin("3", "4")).count() == 0
    assert p2.join(s2, p2.student_id == s2.id, "left_anti").count() == p.join(s, p.student_id == s.id, "left_anti").count()


def test_reset_counts_and_remaining(spark):
    p = si.penalties(spark, SF_SMALL)
    req = spark.createDataFrame([(1, "3", "2024-01-05", "2024-01-12"), (2, "3", "2024-01-01", "2024-01-08"),
                                 (3, "3", "2024-02-01", "2024-01-01"), (4, "3", "2024-1-5", "2024-01-12")],
                                "seq bigint, student_id string, `from` string, `to` string")
    remaining, counts = mu.reset_penalties(p, req.where("seq = 1"))
    assert dict(rows(counts, "seq", "deleted"))[1] == 21      # FIXTURES: sf0.001 -> 21
    assert remaining.count() + 21 == p.count()
    _, counts = mu.reset_penalties(p, req)
    c = {r.seq: (r.deleted, r.reject_reason) for r in counts.collect()}
    expect_1 = p.where("student_id = '3' AND occurred_on BETWEEN '2024-01-05' AND '2024-01-12'").count()
    expect_2 = p.where("student_id = '3' AND occurred_on BETWEEN '2024-01-01' AND '2024-01-04'").count()
    assert c[1] == (expect_1, None) and c[2] == (expect_2, None)   # overlap counted once, for the first
    assert c[3] == (0, None) and c[4] == (0, "schema")


def test_assign_reasons_and_frozen_rule(spark):
    rules = spark.createDataFrame([("r1", "Late", 1, 0, 1, "x", "x")], "id string, title string, points bigint, "
                                  "is_active bigint, sort_order bigint, created_at string, updated_at string")
    req = spark.createDataFrame([
        (1, "1", "r1", "2024-01-01", None),    # inactive rule accepted
        (2, "ghost", "nope", "2024-01-01", "m"),  # rule checked before student
        (3, "ghost", "r1", "2024-01-01", None),
        (4, "", "r1", "2024-1-1", None),
    ], "seq bigint, student_id string, rule_id string, occurred_on string, memo string")
    d = {r.seq: r for r in mu.assign_penalties(req, rules, students(spark), AS_OF, "b1").collect()}
    assert d[1].reject_reason is None and (d[1].rule_title, d[1].points) == ("Late", 1)
    assert d[2].reject_reason == "rule_not_found"
    assert d[3].reject_reason == "student_not_found"
    assert d[4].reject_reason == "schema" and d[4].issues == "student_id:empty,occurred_on:format"


def test_assign_counts_sf0001(spark):
    d = mu.assign_penalties(si.penalty_requests(spark, SF_SMALL), si.rules(spark, SF_SMALL),
                            si.students(spark, SF_SMALL), AS_OF, "b1")
    c = dict(rows(d.groupBy("reject_reason").count()))
    assert c == {None: 957, "schema": 22, "rule_not_found": 11, "student_not_found": 10}


def test_import_counts_sf0001(spark):
    new, imported = mu.import_students(si.students(spark, SF_SMALL), si.roster_import(spark, SF_SMALL), AS_OF)
    assert imported.collect()[0].imported == 148
    assert new.count() == 150 + 1


def test_note_upsert_keeps_student(spark):
    notes = spark.createDataFrame([("n1", "1", "2024-01-01", "a", "t", "t")],
                                  "id string, student_id string, noted_on string, content string, created_at string, updated_at string")
    req = spark.createDataFrame([
        (1, "n1", "2", "2024-02-01", "b"),        # existing: content changes, student does not
        (2, "n2", "ghost", "2024-02-01", "c"),    # new with unknown student: rejected
        (3, "n2", "2", "2024-02-02", "d"),        # first valid insert
        (4, "n2", "ghost", "2024-02-03", "e"),    # later update: student ignored
    ], "seq bigint, id string, student_id string, noted_on string, content string")
    new, bad = mu.upsert_notes(notes, req, students(spark), AS_OF, "b1")
    got = {r.id: (r.student_id, r.noted_on, r.content) for r in new.collect()}
    assert got == {"n1": ("1", "2024-02-01", "b"), "n2": ("2", "2024-02-03", "e")}
    assert [r.seq for r in bad.collect()] == [2]


def test_sum_of_ledger_equals_sum_of_totals(spark):
    p = si.penalties(spark, SF_SMALL)
    t = cumulative_points(si.students(spark, SF_SMALL), p)
    assert t.agg(F.sum("points")).collect()[0][0] == p.agg(F.sum("points")).collect()[0][0]
    assert t.count() == si.students(spark, SF_SMALL).count()


def test_seed_if_empty(spark):
    from pointbook.schemas import DEFAULT_RULES, RULES

    d = spark.createDataFrame([(i, t, p, 1, s, AS_OF, AS_OF) for i, t, p, s in DEFAULT_RULES], RULES)
    r = si.rules(spark, SF_SMALL)
    assert mu.seed_if_empty(r, d).count() == r.count()
    assert rows(mu.seed_if_empty(r.where("false"), d), "id") == [("rule_late",), ("rule_phone",), ("rule_sleep",)]


def test_ledger_month_partitions_prune(spark, tmp_path):
    from pointbook.operators.ledger import penalties_for_student
    from pointbook.sources.tables import write_ledger_snapshot

    p = si.penalties(spark, SF_SMALL)
    root = str(tmp_path)
    v = write_ledger_snapshot(p, root)
    stored = spark.read.parquet(f"{root}/penalties/v={v}")
    got = penalties_for_student(stored, "3", "2024-01-05", "2024-01-12", month_col="occurred_month")
    assert got.count() == 21
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(occurred_month" in plan and "PushedFilters" in plan
    assert penalties_for_student(p, "3", "", None).count() == p.where("student_id = '3'").count()


def test_penalties_in_range_bounds(spark):
    from pointbook.operators.ledger import ledger_total, penalties_in_range

    p = spark.createDataFrame([("a", "s", "2024-01-01", 1), ("b", "s", "2024-01-05", 2), ("c", "s", "2024-01-09", 4),
                               ("d", "t", "2024-01-05", 8)],
                              "id string, student_id string, occurred_on string, points bigint")
    req = spark.createDataFrame([(1, "s", None, None), (2, "s", "", "2024-01-05"), (3, "s", "2024-01-05", "2024-01-09"),
                                 (4, "s", "2024-01-09", "2024-01-01"), (5, "x", None, None)],
                                "seq bigint, student_id string, `from` string, `to` string")
    got = {}
    for r in penalties_in_range(p, req).collect():
        got.setdefault(r.request_seq, set()).add(r.id)
    assert got == {1: {"a", "b", "c"}, 2: {"a", "b"}, 3: {"b", "c"}}
    totals = dict(rows(ledger_total(p, req), "request_seq", "total"))
    assert totals == {1: 7, 2: 3, 3: 6, 4: 0, 5: 0}
