"""Streaming: S1 equals the batch operator, replays are idempotent, restarts add nothing; S2 totals."""

from pyspark.sql import functions as F

from pointbook.operators.ledger import cumulative_points
from pointbook.operators.mutate import accepted_penalties, assign_penalties
from pointbook.session import scratch_path
from pointbook.sources import standin as si
from pointbook.streaming.ingest import (assign_batch_writer, read_assigned, read_parquet_stream,
                                        read_stream_totals, stream_assign, stream_totals)

from conftest import SF_SMALL, rows

AS_OF = "2024-03-01 00:00:00"


def test_stream_assign_equals_batch_and_restart_adds_nothing(spark):
    out, ck = scratch_path(spark, "t_s1", "out"), scratch_path(spark, "t_s1", "ck")
    src = si.penalty_requests_from_events(read_parquet_stream(spark, SF_SMALL, "events.parquet", max_files_per_trigger=1))
    load_rules, load_students = (lambda: si.rules(spark, SF_SMALL)), (lambda: si.students(spark, SF_SMALL))
    stream_assign(src, load_rules, load_students, out, ck, AS_OF, "s1").awaitTermination()
    first = rows(read_assigned(spark, out))
    batch = assign_penalties(si.penalty_requests(spark, SF_SMALL), si.rules(spark, SF_SMALL), si.students(spark, SF_SMALL), AS_OF, "s1-0")
    assert rows(accepted_penalties(read_assigned(spark, out))) == rows(accepted_penalties(batch))
    # restart from the same checkpoint: no new input, no new rows
    stream_assign(src, load_rules, load_students, out, ck, AS_OF, "s1").awaitTermination()
    assert rows(read_assigned(spark, out)) == first


def test_replayed_batch_is_idempotent(spark):
    out = scratch_path(spark, "t_replay", "out")
    w = assign_batch_writer(lambda: si.rules(spark, SF_SMALL), lambda: si.students(spark, SF_SMALL), out, AS_OF, "s1")
    reqs = si.penalty_requests(spark, SF_SMALL)
    w(reqs, 0)
    w(reqs, 0)  # the same micro-batch again, as after a failure before its commit
    assert read_assigned(spark, out).count() == reqs.count()


def test_stream_totals_match_batch(spark):
    root, ck = scratch_path(spark, "t_s2", "out"), scratch_path(spark, "t_s2", "ck")
    ledger = si.penalties_from_events(read_parquet_stream(spark, SF_SMALL, "events.parquet"))
    stream_totals(ledger, root, ck).awaitTermination()
    t = read_stream_totals(spark, root)
    got = cumulative_points(si.students(spark, SF_SMALL), t.select("student_id", "points"))
    want = cumulative_points(si.students(spark, SF_SMALL), si.penalties(spark, SF_SMALL))
    assert rows(got) == rows(want)
    assert t.agg(F.sum("rows")).first()[0] == si.penalties(spark, SF_SMALL).count()


def test_stream_totals_two_triggers(spark, tmp_path):
    """Two input files, one per trigger: the second batch rewrites only the
    students it changed; the merged view equals the batch totals."""
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.where("event_id % 2 = 0").coalesce(1).write.parquet(str(src / "a"))
    ev.where("event_id % 2 = 1").coalesce(1).write.parquet(str(src / "b"))
    files = sorted(str(p) for p in src.rglob("*.parquet"))
    feed = tmp_path / "feed"
    feed.mkdir()
    for i, f in enumerate(files):
        shutil.copy(f, feed / f"part{i}.events.parquet")
    root, ck = scratch_path(spark, "t_s2b", "out"), scratch_path(spark, "t_s2b", "ck")
    stream = read_parquet_stream(spark, str(feed), "*.events.parquet", schema=ev.schema, max_files_per_trigger=1)
    stream_totals(si.penalties_from_events(stream), root, ck).awaitTermination()
    batches = spark.read.parquet(root).select("batch").distinct().count()
    assert batches == 2
    got = read_stream_totals(spark, root).select("student_id", "points")
    want = si.penalties(spark, SF_SMALL).groupBy("student_id").agg(F.sum("points").alias("points"))
    assert rows(got) == rows(want)


def _store(spark, root):
    from pointbook.plans.store import LedgerStore

    st = LedgerStore(spark, root)
    st.commit("students", si.students(spark, SF_SMALL))
    st.commit("rules", si.rules(spark, SF_SMALL))
    return st


def test_stream_into_store_counts_rows_once(spark, tmp_path, monkeypatch):
    """Accepted rows join the ledger and the totals by one commit a micro-batch; a replay after any commit adds nothing."""
    from pointbook.sources.commits import CommitLog
    from pointbook.streaming.ingest import store_batch_writer, stream_assign_into

    st = _store(spark, str(tmp_path / "store"))
    src = si.penalty_requests_from_events(read_parquet_stream(spark, SF_SMALL, "events.parquet"))
    ck = str(tmp_path / "ck")
    stream_assign_into(st, src, ck, AS_OF, "s1").awaitTermination()
    want = accepted_penalties(assign_penalties(si.penalty_requests(spark, SF_SMALL), si.rules(spark, SF_SMALL), si.students(spark, SF_SMALL), AS_OF, "s1-0"))
    assert rows(st.table("penalties")) == rows(want) and st.stream_number("s1") == 0
    assert rows(st.summary()) == rows(cumulative_points(si.students(spark, SF_SMALL), want))
    n = st.log.latest()[0]
    write = store_batch_writer(st, AS_OF, "s1")
    write(si.penalty_requests(spark, SF_SMALL), 0)  # replayed after its commit
    stream_assign_into(st, src, ck, AS_OF, "s1").awaitTermination()
    assert st.log.latest()[0] == n
    # a failure before the commit, then the replay
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            write(si.penalty_requests(spark, SF_SMALL), 1)
        except OSError:
            pass
    assert st.stream_number("s1") == 0
    write(si.penalty_requests(spark, SF_SMALL), 1)
    write(si.penalty_requests(spark, SF_SMALL), 1)
    assert st.table("penalties").count() == 2 * want.count() and st.table("penalties").select("id").distinct().count() == 2 * want.count()
    rejects = spark.read.parquet(f"{st.root}/_stream_rejects/stream=s1")
    assert rejects.count() == 2 * (si.penalty_requests(spark, SF_SMALL).count() - want.count())


def test_stream_totals_follow_deletions(spark, tmp_path):
    """Totals of a store's change feed after assigns, resets, deletes and a cascade equal the store's own."""
    from pointbook.streaming.ingest import read_total_changes

    st = _store(spark, str(tmp_path / "store"))
    st.commit("penalties", si.penalties(spark, SF_SMALL))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def caught_up():
        stream_totals(read_total_changes(spark, st.feed_path(), 1), out, ck).awaitTermination()
        return rows(read_stream_totals(spark, out))

    assert caught_up() == rows(st.totals())
    st.reset(si.reset_requests(spark, SF_SMALL))
    st.delete("penalties", si.penalty_deletes(spark, SF_SMALL))
    st.delete_students(si.student_deletes(spark, SF_SMALL))
    got = caught_up()
    assert got == rows(st.totals()) and len(got) < si.penalties(spark, SF_SMALL).select("student_id").distinct().count()
    # every row of a student taken back: no longer listed
    st.delete_students(spark.createDataFrame([(got[0][0],)], "id string"))
    assert got[0][0] not in {r[0] for r in caught_up()}


def test_reading_totals_does_not_grow_with_age(spark, tmp_path, monkeypatch):
    from pointbook.sources.commits import CommitLog
    from pointbook.streaming import ingest

    monkeypatch.setattr(ingest, "TOTALS_FOLD", 3)
    out = str(tmp_path / "out")
    write = ingest.totals_batch_writer(out, "ck")
    total = {}
    for i in range(11):
        batch = [(f"s{i % 4}", i, i % 5), ("hot", i, i + 1)]
        total |= {s: (p, r) for s, p, r in batch}
        write(spark.createDataFrame(batch, "student_id string, points long, rows long"), i)
        write(spark.createDataFrame([("x", 99, 99)], "student_id string, points long, rows long"), i)  # a replay of what is recorded
        assert rows(read_stream_totals(spark, out)) == sorted((s, p, r) for s, (p, r) in total.items() if r > 0)
        record = CommitLog(spark, f"{out}/_totals").latest()[1]
        assert len(record["since"]) < 3 and len(read_stream_totals(spark, out).inputFiles()) <= 12
    import pytest
    with pytest.raises(ValueError):
        ingest.totals_batch_writer(out, "other")(spark.createDataFrame([("x", 1, 1)], "student_id string, points long, rows long"), 0)
    # an unfinished batch is not seen
    spark.createDataFrame([("ghost", 1, 1, 99)], "student_id string, points long, rows long, as_of_batch long").write.parquet(f"{out}/batch=99")
    assert "ghost" not in {r.student_id for r in read_stream_totals(spark, out).collect()}
