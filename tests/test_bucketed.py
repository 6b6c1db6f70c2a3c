"""Co-located layout: roster and ledger bucketed on the student key give a
totals plan with no shuffle at all, and the same totals."""

from pointbook.operators.ledger import cumulative_points
from pointbook.schemas import PENALTIES, STUDENTS
from pointbook.sources import standin as si
from pointbook.sources.tables import read_bucketed_snapshot, write_bucketed_snapshot

from conftest import SF_SMALL, rows


def test_bucketed_totals_without_shuffle(spark, tmp_path):
    root = str(tmp_path)
    s, p = si.students(spark, SF_SMALL), si.penalties(spark, SF_SMALL)
    write_bucketed_snapshot(s, root, "students", "id", 8)
    write_bucketed_snapshot(p, root, "penalties", "student_id", 8)
    bs = read_bucketed_snapshot(spark, root, "students", "id", 8, STUDENTS)
    bp = read_bucketed_snapshot(spark, root, "penalties", "student_id", 8, PENALTIES)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = cumulative_points(bs, bp)
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        assert "SortMergeJoin" in plan
        assert rows(t) == rows(cumulative_points(s, p))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
