"""The request lifecycles on tables that change together.

``LedgerStore`` keeps the five tables, and the students' running totals, under
one root folder (a shared, durable location on a cluster) and applies request
batches: each call reads the current state, runs the operators, writes what
they add or remove, and commits one manifest record that names the new state
of *every* table. So a student's removal takes ledger rows and notes along in
the same commit, a failure at any point leaves the former state, and a reader
never sees half of a change.

This is the set-based counterpart of the reference's routes (one batch of
requests per call instead of one HTTP request per row). What a call writes is
in proportion to the request: rows are appended, removals are committed as
keys or days that reads leave out (``sources.logged``), an update is both.
``compact`` folds a table's log into a new base. One writer per root is
meant; a second one that races gets ``CommitConflict`` and changes nothing.

Totals (E1) are kept, not recomputed: each commit that touches the ledger
adds signed (student, points, rows) corrections, made of the rows that it
adds or removes. The same corrections are published, after the commit, as a
feed for streams (``feed_path``, ``streaming.ingest.stream_totals``).
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import ledger as lg
from ..operators import messages as msg
from ..operators import mutate as mu
from ..operators import thresholds as th
from ..operators import ordering
from ..schemas import DEFAULT_RULES, DEFAULT_THRESHOLDS, RULES, TABLES, THRESHOLDS
from ..sources import logged
from ..sources.commits import CommitLog
from ..sources.tables import BATCH_NAME, read_bucketed, write_bucketed

# Student key of each table, for the co-located (bucketed) layout.
BUCKET_KEYS = {"students": "id", "penalties": "student_id", "notes": "student_id", "totals": "student_id"}

# Signed corrections of a student's total: their sum is the total, and the sum of ``rows`` the number of ledger rows.
TOTALS = StructType([StructField("student_id", StringType()), StructField("points", LongType()), StructField("rows", LongType())])

# Log entries of a table after which its entries are merged into one of each kind (the base is left alone).
LOG_ENTRIES = 64


class AlreadyCommitted(Exception):
    """The batch of this name is part of the state."""


def sums(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed corrections for ledger rows that come (1) or go (-1)."""
    return rows.groupBy("student_id").agg((F.sum("points") * sign).cast("bigint").alias("points"), (F.count(F.lit(1)) * sign).cast("bigint").alias("rows"))


class Transaction:
    """Writes that become visible together. Nothing that was there before is overwritten."""

    def __init__(self, store: LedgerStore, batch: str | None = None):
        if batch is not None and not BATCH_NAME.fullmatch(batch):
            raise ValueError(f"batch name {batch!r} must be letters, digits, '_', '-' or '.', not starting with '.' or '_'")
        if batch is not None and store.has_batch(batch):
            raise AlreadyCommitted(batch)
        self.store, self.spark, self.batch = store, store.spark, batch
        n, record = store.log.latest()
        self.number, self.name = n + 1, uuid.uuid4().hex
        self.tables = copy.deepcopy(record["tables"]) if record else {}
        self.streams = dict(record["streams"]) if record else {}
        self.changes: list[DataFrame] = []
        self.rebased = False  # the totals hold the changes already

    def _path(self, table: str, kind: str) -> str:
        """A folder of this attempt's own: a failed one leaves nothing that a retry could meet."""
        return f"{self.store.root}/{table}/{kind}-{self.number:012d}-{self.name[:12]}-{uuid.uuid4().hex[:6]}"

    def _state(self, table: str) -> dict:
        return self.tables.setdefault(table, logged.empty_state())

    def _entry(self, table: str, kind: str, path: str, **more) -> dict:
        # the row count is read from the written files' footers
        rows = self.spark.read.parquet(path).count()
        entry = {"kind": kind, "path": path, "n": self.number, "rows": rows, "bytes": self.store.log.files.bytes_under(path), **more}
        if rows:
            self._state(table)["log"].append(entry)
        return entry

    def _rebase(self, table: str, df: DataFrame) -> None:
        """``df`` becomes the base of ``table``, with an empty log."""
        path, key = self._path(table, "base"), self.store.bucket_key(table)
        out = df.select(*self.store.schema(table).fieldNames())
        if key:
            write_bucketed(out, path, key, self.store.buckets)
        else:
            out.write.parquet(path)
        self.tables[table] = {"base": path, "buckets": self.store.buckets if key else None, "log": []}

    def replace(self, table: str, df: DataFrame) -> None:
        """``df`` becomes the whole table. For the ledger, the totals are made anew; their change is the difference."""
        former = self.store.totals() if table == "penalties" else None
        self._rebase(table, df)
        if former is not None:
            self._rebase("totals", sums(self.store.table(table, self.tables)))
            self.changes += [self.store.table("totals", self.tables), former.select("student_id", (-F.col("points")).alias("points"), (-F.col("rows")).alias("rows"))]
            self.rebased = True

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows; returns them as written."""
        schema, path = self.store.schema(table), self._path(table, "append")
        rows.select(*schema.fieldNames(), F.lit(self.number).cast("bigint").alias("_n")).write.parquet(path)
        self._entry(table, "append", path)
        written = self.spark.read.parquet(path)
        if table == "penalties":
            self.changes.append(sums(written))
        return written

    def delete(self, table: str, keys: DataFrame, by: str, change: DataFrame | None = None) -> None:
        """Remove the rows that ``keys`` name (by the columns of ``by``). ``change``: the corrections of the totals, if known."""
        cols, path = logged.DELETE_COLUMNS[by], self._path(table, f"delete-{by}")
        keys.select(*cols).distinct().withColumn("_gone", F.lit(self.number).cast("bigint")).write.parquet(path)
        if not self._entry(table, "delete", path, by=by)["rows"] or table != "penalties":
            return
        if change is None:
            names = self.spark.read.parquet(path).select(*cols)
            if by == "student_id":  # all of a student's rows: the negative of the kept total
                change = self.store.totals().join(names, cols, "left_semi").select("student_id", (-F.col("points")).alias("points"), (-F.col("rows")).alias("rows"))
            else:
                change = sums(self.store.table(table).select("id", "student_id", "occurred_on", "points").join(names, cols, "left_semi"), -1)
        self.changes.append(change)

    def upsert(self, table: str, touched: DataFrame) -> None:
        """Rows that are inserted or updated take the place of those of the same id."""
        self.delete(table, self.append(table, touched), "id")

    def _merge_log(self, table: str) -> None:
        """One entry of each kind in place of many; rows that are deleted already are left out."""
        state, schema = self.tables[table], self.store.schema(table)
        merged = []
        rows = logged.appended(self.spark, state, schema)
        if rows is not None:
            path = self._path(table, "append")
            logged.without_deleted(self.spark, state, schema, rows).write.parquet(path)
            merged.append(("append", path, {}))
        for by, cols in logged.DELETE_COLUMNS.items():
            paths = [e["path"] for e in state["log"] if e["kind"] == "delete" and e["by"] == by]
            if paths and state["base"]:
                path = self._path(table, f"delete-{by}")
                self.spark.read.parquet(*paths).groupBy(*cols).agg(F.max("_gone").alias("_gone")).write.parquet(path)
                merged.append(("delete", path, {"by": by}))
        state["log"] = []
        for kind, path, more in merged:
            self._entry(table, kind, path, **more)

    def commit(self) -> int:
        """Write the corrections of the totals, then the manifest record, which makes all of it visible; returns its number."""
        change = None
        if self.changes:
            total = self.changes[0]
            for c in self.changes[1:]:
                total = total.unionByName(c)
            total = total.groupBy("student_id").agg(F.sum("points").alias("points"), F.sum("rows").alias("rows")).where("points <> 0 or rows <> 0")
            path = self._path("totals", "append")
            total.select("student_id", F.col("points").cast("bigint"), F.col("rows").cast("bigint"), F.lit(self.number).cast("bigint").alias("_n")).write.parquet(path)
            if self.rebased:
                change = path
            elif self._entry("totals", "append", path)["rows"]:
                change = path
        if len(self._state("totals")["log"]) > LOG_ENTRIES:
            self._rebase("totals", self.store.totals(self.tables))
        for table in TABLES:
            if table in self.tables and len(self.tables[table]["log"]) > LOG_ENTRIES:
                self._merge_log(table)
        if self.batch is not None:
            self.store.log.files.write(f"{self.store.root}/_batches/{self.batch}/{self.name}.json", json.dumps({"number": self.number}))
        self.store.log.append(self.number, {"name": self.name, "batch": self.batch, "tables": self.tables, "streams": self.streams, "change": change})
        self.store.publish()
        return self.number


@dataclass
class LedgerStore:
    """Tables under ``root``. With ``buckets``, the bases of students, ledger
    and notes are bucketed on the student key with that many buckets, so
    totals, cascades and roster joins over them run without a shuffle
    (appended rows are plain files until ``compact``)."""

    spark: SparkSession
    root: str
    buckets: int | None = None
    log: CommitLog = field(init=False)

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        self.log = CommitLog(self.spark, f"{self.root}/_manifest")

    # -- state ------------------------------------------------------------------
    def schema(self, table: str) -> StructType:
        return TOTALS if table == "totals" else TABLES[table]

    def bucket_key(self, table: str) -> str | None:
        return BUCKET_KEYS.get(table) if self.buckets else None

    def _tables(self) -> dict:
        _, record = self.log.latest()
        return record["tables"] if record else {}

    def _base(self, name: str, state: dict) -> DataFrame | None:
        if state["base"] is None:
            return None
        if state["buckets"]:
            return read_bucketed(self.spark, state["base"], BUCKET_KEYS[name], state["buckets"], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(state["base"])

    def table(self, name: str, tables: dict | None = None) -> DataFrame:
        """The current state of ``name`` (an empty table before the first commit)."""
        state = (self._tables() if tables is None else tables).get(name, logged.empty_state())
        return logged.rows_of(self.spark, state, self.schema(name), self._base(name, state))

    def totals(self, tables: dict | None = None) -> DataFrame:
        """Kept totals of the students that have ledger rows: student_id, points, rows. The ledger is not read."""
        t = self.table("totals", tables).groupBy("student_id").agg(F.sum("points").alias("points"), F.sum("rows").alias("rows"))
        return t.where(F.col("rows") > 0).select("student_id", F.col("points").cast("bigint"), F.col("rows").cast("bigint"))

    def has_batch(self, batch: str) -> bool:
        """Whether the named batch is part of the state. A name's folder holds one note for each attempt; the attempt
        whose record bears its name has committed. Neither depends on the store's age."""
        folder = f"{self.root}/_batches/{batch}"
        for note in self.log.files.names(folder):
            if note.startswith(".") or not note.endswith(".json"):
                continue
            record = self.log.read(json.loads(self.log.files.read(f"{folder}/{note}"))["number"])
            if record is not None and record["name"] == note.removesuffix(".json"):
                return True
        return False

    def feed_path(self) -> str:
        """Published corrections of the totals, a folder for each commit that had any."""
        return f"{self.root}/_feed"

    def publish(self) -> None:
        """Put the corrections of committed records into the feed, each once: a folder appears there whole, by renaming.
        Left undone by a failure, it is made up for by the next commit (or call)."""
        files, feed = self.log.files, self.feed_path()
        done = int(files.read(f"{feed}/_published") or 0)
        newest = done
        for n, record in self.log.since(done):
            target = f"{feed}/n={n}"
            if record["change"] and not files.exists(target):
                draft = f"{feed}/.{uuid.uuid4().hex}"
                self.spark.read.parquet(record["change"]).select(*TOTALS.fieldNames()).write.parquet(draft)
                files.rename(draft, target)
            newest = n
        if newest > done:
            files.write(f"{feed}/_published", str(newest))

    def commit(self, name: str, df: DataFrame) -> int:
        """``df`` (computed from the current state, or anything) becomes the whole table ``name``."""
        t = Transaction(self)
        t.replace(name, df)
        return t.commit()

    def compact(self, name: str) -> int:
        """Fold the log of ``name`` into a new base; the rows stay as they are."""
        t = Transaction(self)
        state = t.tables.get(name, logged.empty_state())
        if not state["log"]:
            return t.number - 1
        t._rebase(name, self.table(name) if name != "totals" else self.totals())
        return t.commit()

    def append(self, name: str, rows: DataFrame, batch: str) -> int | None:
        """Add ``rows`` to ``name`` once for each ``batch`` name; None when the batch is there already."""
        try:
            t = Transaction(self, batch)
        except AlreadyCommitted:
            return None
        t.append(name, rows)
        return t.commit()

    def open(self, as_of: str) -> None:
        """A4: seed default rules / thresholds when empty (also when all were deleted before)."""
        t = Transaction(self)
        for name, schema, defaults in (
            ("rules", RULES, [(i, ti, p, 1, s, as_of, as_of) for i, ti, p, s in DEFAULT_RULES]),
            ("thresholds", THRESHOLDS, [(i, m, lab, tpl, s, as_of, as_of) for i, m, lab, tpl, s in DEFAULT_THRESHOLDS]),
        ):
            if mu.is_empty(self.table(name)):
                t.append(name, self.spark.createDataFrame(defaults, schema))
        if t.number == 1 or t.tables != self._tables():
            t.commit()

    # -- changes ------------------------------------------------------------------
    def _upsert(self, table: str, merged: tuple[DataFrame, DataFrame], batch: str | None = None) -> DataFrame:
        """Commit what a merge (with ``op``) touched; returns the rejects."""
        new, bad = merged
        try:
            t = Transaction(self, batch)
        except AlreadyCommitted:
            return bad
        t.upsert(table, new.where("op is not null").drop("op"))
        t.commit()
        return bad

    def upsert_students(self, requests: DataFrame, as_of: str) -> DataFrame:
        """C1; returns the rejected requests."""
        return self._upsert("students", mu.upsert_students(self.table("students"), requests, as_of, with_op=True))

    def update_students(self, requests: DataFrame, as_of: str) -> DataFrame:
        """Existing students only; returns the requests that a rule rejects (an unknown id is no error)."""
        merged, bad = mu.upsert_students(self.table("students"), requests, as_of, with_op=True)
        return self._upsert("students", (merged.where("op = 'updated'"), bad))

    def import_roster(self, roster: DataFrame, as_of: str) -> int:
        """Returns ``imported`` (rows after the required-field filter)."""
        new, imported = mu.import_students(self.table("students"), roster, as_of, with_op=True)
        n = int(imported.first()["imported"])
        self._upsert("students", (new, None))
        return n

    def delete_students(self, keys: DataFrame) -> None:
        """C4 with cascade to ledger and notes (D7), in one commit."""
        t = Transaction(self)
        ids = keys.select("id")
        t.delete("students", ids, "id")
        for child in ("penalties", "notes"):
            t.delete(child, ids.select(F.col("id").alias("student_id")), "student_id")
        t.commit()

    def upsert_rules(self, requests: DataFrame, as_of: str, batch: str) -> DataFrame:
        """C5; ``batch`` names the request batch (part of generated ids, here and below)."""
        return self._upsert("rules", mu.upsert_rules(self.table("rules"), requests, as_of, batch, with_op=True))

    def upsert_thresholds(self, requests: DataFrame, as_of: str, batch: str) -> DataFrame:
        """C7."""
        return self._upsert("thresholds", mu.upsert_thresholds(self.table("thresholds"), requests, as_of, batch, with_op=True))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Delete rows of ``table`` by id; students go with their ledger rows and notes."""
        if table == "students":
            return self.delete_students(keys)
        t = Transaction(self)
        t.delete(table, keys, "id")
        t.commit()

    def stream_number(self, stream: str) -> int:
        """The number of the stream's last committed micro-batch, -1 before the first."""
        _, record = self.log.latest()
        return record["streams"].get(stream, -1) if record else -1

    def assign(self, requests: DataFrame, as_of: str, batch: str, stream: tuple[str, int] | None = None,
               rejects_path: str | None = None) -> DataFrame:
        """Append the accepted rows to the ledger; returns the rejects. ``batch`` names the batch: it is part
        of every id, and a retry with the same name adds nothing, also after later commits. ``stream``: the stream
        and number of a micro-batch; one that is not beyond the stream's last committed number adds nothing.
        ``rejects_path``: where the rejects are written, before the commit."""
        decided = mu.assign_penalties(requests, self.table("rules"), self.table("students"), as_of, batch)
        bad = mu.rejected_penalties(decided)
        if rejects_path is not None:
            bad.write.mode("overwrite").parquet(rejects_path)
        try:
            t = Transaction(self, None if stream else batch)
        except AlreadyCommitted:
            return bad
        if stream:
            if t.streams.get(stream[0], -1) >= stream[1]:
                return bad
            t.streams[stream[0]] = stream[1]
        t.append("penalties", mu.accepted_penalties(decided))
        t.commit()
        return bad

    def reset(self, requests: DataFrame) -> DataFrame:
        """L4 / C11: remove the ranges; returns per-request deleted counts."""
        t = Transaction(self)
        covered = mu.covered_days(self.table("penalties"), requests)
        path = t._path("penalties", "reset")
        covered.write.parquet(path)
        covered = self.spark.read.parquet(path)
        t.delete("penalties", covered, "student_day", covered.groupBy("student_id").agg(
            (-F.sum("points")).cast("bigint").alias("points"), (-F.sum("rows")).cast("bigint").alias("rows")))
        t.commit()
        return mu.reset_counts(requests, covered)

    def upsert_notes(self, requests: DataFrame, as_of: str, batch: str) -> DataFrame:
        """C12; returns the rejected requests."""
        return self._upsert("notes", mu.upsert_notes(self.table("notes"), requests, self.table("students"), as_of, batch, with_op=True))

    # -- reads --------------------------------------------------------------------
    def summary(self) -> DataFrame:
        """E1 from the kept totals: every student with the sum of their points, 0 without rows."""
        return lg.with_points(self.table("students"), self.totals())

    def students(self) -> DataFrame:
        """F1."""
        return ordering.sorted_rows(self.table("students"), "students")

    def rules(self) -> DataFrame:
        """F2."""
        return ordering.sorted_rows(self.table("rules"), "rules")

    def thresholds(self) -> DataFrame:
        """F3."""
        return ordering.sorted_rows(self.table("thresholds"), "thresholds")

    def history(self, student_id: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """One student's ledger rows in the inclusive range, newest first; a missing student id is an error."""
        return ordering.sorted_rows(lg.penalties_for_student(self.table("penalties"), student_id, date_from, date_to), "penalties")

    def notes(self, student_id: str) -> DataFrame:
        """One student's notes, newest first; a missing student id is an error."""
        return ordering.sorted_rows(lg.notes_for_student(self.table("notes"), student_id), "notes")

    def threshold_status(self) -> DataFrame:
        """Each student's badge."""
        return th.threshold_status(self.summary(), self.table("thresholds"))

    # -- messages -----------------------------------------------------------------
    def _outbox(self, batch: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/_outbox/batch={batch}/_handed_over")

    def outbox(self, batch: str | int) -> DataFrame | None:
        """All rows of the send batch that have been handed over, None before the first."""
        _, record = self._outbox(str(batch)).latest()
        return self.spark.read.parquet(*record["parts"]) if record else None

    def send(self, requests: DataFrame, sender: str, batch_id: int | str) -> tuple[str, DataFrame]:
        """L1 / A5: hand over the outbox rows of a send batch; returns (folder of the rows handed over now, rejects).
        Rows of this batch that an earlier call handed over are left out, so that a repeated or overlapping call
        sends nothing twice. Ids carry the batch's name, so only this batch's own rows are looked at."""
        batch = str(batch_id)
        if not BATCH_NAME.fullmatch(batch):
            raise ValueError(f"batch name {batch!r}")
        prepared = msg.prepare_messages(requests, self.table("students"), self.table("penalties"), self.table("thresholds"), totals=self.totals())
        rows = msg.message_outbox(prepared, sender, f"send-{batch}")
        handed = self._outbox(batch)
        n, record = handed.latest()
        parts = record["parts"] if record else []
        if parts:
            rows = msg.not_yet_sent(rows, self.spark.read.parquet(*parts))
        path = f"{self.root}/_outbox/batch={batch}/part-{n + 1:06d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(path)
        handed.append(n + 1, {"parts": [*parts, path]})
        return path, msg.message_rejects(prepared)
