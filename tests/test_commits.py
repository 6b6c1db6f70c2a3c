"""Commit records: numbering, conflicts, stale hints; logged tables against plain models; failures between writes."""

import random

import pytest
from pyspark.sql import functions as F

from pointbook.operators.ledger import cumulative_points
from pointbook.plans import store as ps
from pointbook.plans.store import LedgerStore, Transaction
from pointbook.schemas import NOTES, PENALTIES, PENALTY_REQUESTS, STUDENTS
from pointbook.sources.commits import CommitConflict, CommitLog

from conftest import rows

T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def test_log_numbers_and_conflicts(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, None) and list(log.since(0)) == []
    log.append(1, {"a": "가"})
    log.append(2, {"a": 2})
    assert log.latest() == (2, {"a": 2}) and log.read(1) == {"a": "가"} and log.read(3) is None
    with pytest.raises(CommitConflict):
        CommitLog(spark, str(tmp_path / "log")).append(2, {"a": "other"})
    assert log.read(2) == {"a": 2}
    log.files.write(f"{log.root}/_latest", "1")  # a stale hint, then a wrong one, then none
    assert log.latest()[0] == 2
    log.files.write(f"{log.root}/_latest", "77")
    assert log.latest()[0] == 2
    log.files.write(f"{log.root}/_latest", "")
    assert log.latest()[0] == 2 and [n for n, _ in log.since(0)] == [1, 2]


def _store(spark, root, students=("1", "2", "3"), **kw):
    st = LedgerStore(spark, root, **kw)
    st.open(T0)
    st.commit("students", spark.createDataFrame([(s, f"N{s}", None, "010", None, T0, T0) for s in students], STUDENTS))
    return st


def _requests(spark, *triples):
    return spark.createDataFrame([(i, s, "rule_late", d, None) for i, (s, d) in enumerate(triples)], PENALTY_REQUESTS)


def _state(st):
    return {t: rows(st.table(t)) for t in ("students", "penalties", "notes", "rules", "thresholds")} | {"totals": rows(st.totals()), "feed": st.log.latest()[0]}


def _full(st):
    return rows(cumulative_points(st.table("students"), st.table("penalties")))


@pytest.mark.parametrize("fails", ["append", "delete", "commit", "log"])
def test_failure_between_tables_leaves_the_old_state(spark, tmp_path, monkeypatch, fails):
    """A cascade that breaks after some of its writes changes nothing; tried again, it does all."""
    st = _store(spark, str(tmp_path))
    st.assign(_requests(spark, ("1", "2024-01-05"), ("2", "2024-01-05")), T1, "a")
    st.commit("notes", spark.createDataFrame([("n1", "1", "2024-01-05", "x", T0, T0), ("n2", "2", "2024-01-05", "y", T0, T0)], NOTES))
    before = _state(st)

    class Broken(RuntimeError):
        pass

    def broken(*a, **k):
        raise Broken

    keys = spark.createDataFrame([("1",)], "id string")
    with monkeypatch.context() as m:
        if fails == "log":
            m.setattr(CommitLog, "append", broken)
        elif fails == "delete":
            plain, calls = Transaction.delete, []
            m.setattr(Transaction, "delete", lambda self, *a, **k: broken() if len(calls) == 2 else (calls.append(1), plain(self, *a, **k)))
        elif fails == "commit":
            m.setattr(Transaction, "commit", broken)
        else:
            m.setattr(Transaction, "_entry", broken)
        with pytest.raises(Broken):
            st.delete_students(keys)
    assert _state(st) == before == _state(LedgerStore(spark, str(tmp_path)))
    st.delete_students(keys)
    assert [rows(st.table(t), "id" if t == "students" else "student_id") for t in ("students", "penalties", "notes")] == [[("2",), ("3",)], [("2",)], [("2",)]]
    assert rows(st.summary()) == _full(st)


def test_failed_batch_can_be_retried_and_a_committed_one_not(spark, tmp_path, monkeypatch):
    st = _store(spark, str(tmp_path))
    req = _requests(spark, ("1", "2024-01-05"))
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            st.assign(req, T1, "a")
    assert not st.has_batch("a") and st.table("penalties").count() == 0
    for _ in range(3):
        st.assign(req, T1, "a")
    assert st.has_batch("a") and st.table("penalties").count() == 1 and rows(st.totals()) == [("1", 1, 1)]


def test_racing_writer_gets_a_conflict(spark, tmp_path):
    st = _store(spark, str(tmp_path))
    slow = Transaction(st)
    slow.append("penalties", spark.createDataFrame([("p", "1", "r", "t", 5, "2024-01-01", None, T0)], PENALTIES))
    st.assign(_requests(spark, ("2", "2024-01-05")), T1, "a")
    with pytest.raises(CommitConflict):
        slow.commit()
    assert rows(st.table("penalties"), "student_id") == [("2",)] and rows(st.summary()) == _full(st)


def test_writes_are_in_proportion_to_the_request(spark, tmp_path):
    st = _store(spark, str(tmp_path), students=[str(i) for i in range(50)])
    big = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("id"), (F.col("id") % 50).cast("string").alias("student_id"), F.lit("r").alias("rule_id"),
                                     F.lit("t").alias("rule_title"), (F.col("id") % 4).alias("points"),
                                     F.format_string("2024-%02d-%02d", F.col("id") % 12 + 1, F.col("id") % 28 + 1).alias("occurred_on"),
                                     F.sha2(F.col("id").cast("string"), 512).alias("memo"), F.lit(T0).alias("created_at"))
    st.commit("penalties", big)
    base = st.log.files.bytes_under(st._tables()["penalties"]["base"])
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())
    for change in (
        lambda: st.reset(spark.createDataFrame([(1, "7", "2024-01-01", "2024-06-30")], "seq bigint, student_id string, `from` string, `to` string")),
        lambda: st.delete("penalties", spark.createDataFrame([("p9",), ("p10",)], "id string")),
        lambda: st.delete_students(spark.createDataFrame([("11",)], "id string")),
        lambda: st.assign(_requests(spark, ("1", "2024-01-05")), T1, "x"),
    ):
        before = size()
        change()
        assert size() - before < base / 20
        assert rows(st.summary()) == _full(st)
    # a read of the totals does not touch the ledger
    assert "penalties" not in st.summary()._jdf.queryExecution().optimizedPlan().toString().split("totals")[0]
    assert not any("/penalties/" in f for f in st.summary().inputFiles())


@pytest.mark.parametrize("seed,buckets", [(0, None), (1, 4), (2, None)])
def test_random_lifecycles_equal_a_model(spark, tmp_path, monkeypatch, seed, buckets):
    """Random changes; tables equal a plain model, kept totals the recomputed ones, also over merges and compaction."""
    monkeypatch.setattr(ps, "LOG_ENTRIES", 3)
    rng = random.Random(seed)
    names = [str(i) for i in range(6)]
    st = _store(spark, str(tmp_path), students=names, buckets=buckets)
    model, people = {}, set(names)
    for step in range(12):
        kind = rng.choice(["assign", "assign", "reset", "delete", "drop", "compact", "replace"])
        if kind == "assign":
            asked = [(rng.choice(names), f"2024-01-{rng.randint(1, 9):02d}") for _ in range(rng.randint(1, 8))]
            known = {r.id for r in st.table("penalties").select("id").collect()}
            st.assign(_requests(spark, *asked), T1, f"b{step}")
            for r in st.table("penalties").collect():
                if r.id not in known:
                    model[r.id] = (r.student_id, r.occurred_on)
            assert sorted(model[i] for i in model if i not in known) == sorted((s, d) for s, d in asked if s in people)
        elif kind == "reset":
            s, lo, hi = rng.choice(names), rng.randint(1, 9), rng.randint(1, 9)
            got = st.reset(spark.createDataFrame([(1, s, f"2024-01-{lo:02d}", f"2024-01-{hi:02d}")], "seq bigint, student_id string, `from` string, `to` string")).first().deleted
            gone = [i for i, (a, d) in model.items() if a == s and f"2024-01-{lo:02d}" <= d <= f"2024-01-{hi:02d}"]
            assert got == len(gone)
            for i in gone:
                del model[i]
        elif kind == "delete" and model:
            gone = rng.sample(sorted(model), min(3, len(model)))
            st.delete("penalties", spark.createDataFrame([(i,) for i in [*gone, "none"]], "id string"))
            for i in gone:
                del model[i]
        elif kind == "drop" and len(people) > 2:
            s = rng.choice(sorted(people))
            people.discard(s)
            st.delete("students", spark.createDataFrame([(s,)], "id string"))
            model = {i: v for i, v in model.items() if v[0] != s}
        elif kind == "compact":
            st.compact(rng.choice(["penalties", "students", "totals"]))
        elif kind == "replace":
            st.commit("penalties", st.table("penalties"))
        assert sorted((r.id, r.student_id, r.occurred_on) for r in st.table("penalties").collect()) == sorted((i, *v) for i, v in model.items()), (step, kind)
        assert rows(st.table("students"), "id") == sorted((s,) for s in people)
        assert rows(st.summary()) == _full(st), (step, kind)
    # the published corrections add up to the totals
    feed = spark.read.schema(ps.TOTALS).parquet(f"{st.feed_path()}/n=*").groupBy("student_id").agg(F.sum("points"), F.sum("rows")).where("`sum(rows)` <> 0")
    assert rows(feed) == rows(st.totals())


def test_publishing_is_made_up_for(spark, tmp_path, monkeypatch):
    st = _store(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(LedgerStore, "publish", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            st.assign(_requests(spark, ("1", "2024-01-05")), T1, "a")  # committed, not published
    assert st.has_batch("a")
    st.assign(_requests(spark, ("1", "2024-01-06")), T1, "b")
    st.publish()
    assert spark.read.parquet(f"{st.feed_path()}/n=*").agg(F.sum("rows")).first()[0] == 2


def test_updates_and_upserts_write_only_what_they_touch(spark, tmp_path):
    st = _store(spark, str(tmp_path))
    req = spark.createDataFrame([(1, "1", "Ann", "G1", None, ""), (2, "9", "New", None, None, None), (3, "", "x", None, None, None)],
                                "seq long, id string, name string, grade string, student_phone string, parent_phone string")
    assert st.update_students(req, T1).count() == 1
    assert rows(st.table("students"), "id", "name", "updated_at") == [("1", "Ann", T1), ("2", "N2", T0), ("3", "N3", T0)]
    st.upsert_students(req, T1)
    assert rows(st.table("students"), "id", "created_at") == [("1", T0), ("2", T0), ("3", T0), ("9", T1)]
    log = st._tables()["students"]["log"]
    assert sum(e["rows"] for e in log if e["kind"] == "append") == 3


def test_reads_of_one_student_and_ordered_lists(spark, tmp_path):
    st = _store(spark, str(tmp_path))
    st.assign(_requests(spark, ("1", "2024-01-05"), ("1", "2024-01-09"), ("2", "2024-01-07")), T1, "a")
    assert [r.occurred_on for r in st.history("1").collect()] == ["2024-01-09", "2024-01-05"]
    assert [r.occurred_on for r in st.history("1", "2024-01-06", "").collect()] == ["2024-01-09"] and st.notes("1").count() == 0
    for call in (st.history, st.notes):
        for missing in (None, ""):
            with pytest.raises(ValueError):
                call(missing)
    assert [r.id for r in st.students().collect()] == ["1", "2", "3"] and [r.sort_order for r in st.rules().collect()] == [1, 2, 3]
    assert [r.min_points for r in st.thresholds().collect()] == [5, 10]
    assert {r.student_id: r.badge for r in st.threshold_status().collect()}["1"] == "정상"


def test_sent_messages_are_not_sent_again(spark, tmp_path):
    st = _store(spark, str(tmp_path))
    sends = lambda *s: spark.createDataFrame([(int(x), x, "student", "hi") for x in s], "seq long, student_id string, target string, message string")
    first, _ = st.send(sends("1", "2"), "02", "s1")
    again, _ = st.send(sends("1", "2"), "02", "s1")
    more, _ = st.send(sends("2", "3"), "02", "s1")
    other, _ = st.send(sends("1"), "02", "s2")
    assert [spark.read.parquet(p).count() for p in (first, again, more, other)] == [2, 0, 1, 1]
    assert rows(st.outbox("s1"), "student_id") == [("1",), ("2",), ("3",)] and st.outbox("s3") is None
    assert st.outbox("s1").union(st.outbox("s2")).select("outbox_id").distinct().count() == 4
