"""Structured Streaming: penalty requests as a stream, and running totals.

S1 ``stream_assign``: every micro-batch of requests runs the *same* batch
operator as ``assign_penalties`` (validation -> current rule copied onto the
row -> student must exist), with rules and students re-read per micro-batch
so "the rule as it is at insert time" holds. Each batch is written to its
own ``batch=<id>`` folder with overwrite, so a replayed batch after a
failure replaces its own output instead of duplicating it.
``stream_assign_into`` puts the accepted rows into a ``LedgerStore`` instead:
the store's commit records the stream's name and the micro-batch's number, so
a replay after any commit adds nothing.

S2 ``stream_totals``: running points per student. State holds one row per
student (bounded by the roster, not by the ledger), so no watermark is
needed; each trigger writes only the students it changed (update mode). The
input may be signed: a row with negative ``rows`` takes earlier rows back, so
totals also go down, and a student without any row left is no longer listed.
``LedgerStore.feed_path`` is such an input (``read_total_changes``). A
record after each trigger names what makes up the current totals: a snapshot
and the few batches since; a reader looks at nothing older.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import assign_penalties
from ..plans.store import TOTALS, LedgerStore
from ..sources.commits import CommitLog
from ..sources.tables import write_snapshot

# Batches of running totals after which they are folded into a snapshot.
TOTALS_FOLD = 16

_TOTALS = "student_id string, points bigint, rows bigint, as_of_batch bigint"


def read_parquet_stream(spark: SparkSession, directory: str, file_glob: str, schema=None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``directory`` limited to files matching ``file_glob``.

    The schema is explicit (taken from a matching file when not given), as a
    streaming source does not infer one.
    """
    if schema is None:
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(directory).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def stream_assign(requests: DataFrame, rules_loader: Callable[[], DataFrame],
                  students_loader: Callable[[], DataFrame], out_dir: str, checkpoint_dir: str,
                  as_of: str | Callable[[int], str], stream: str, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Start the ingest query; decided requests land in ``out_dir/batch=<id>``
    (accepted rows have a NULL ``reject_reason``). ``stream`` names the stream;
    with the micro-batch's number it is part of every generated id."""
    run_batch = assign_batch_writer(rules_loader, students_loader, out_dir, as_of, stream)
    w = requests.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def assign_batch_writer(rules_loader: Callable[[], DataFrame], students_loader: Callable[[], DataFrame],
                        out_dir: str, as_of: str | Callable[[int], str], stream: str) -> Callable[[DataFrame, int], None]:
    """The per-micro-batch function of S1: the batch assign operator over the
    rules and students as they are now, written to ``batch=<id>`` with
    overwrite (a replayed batch id replaces its own output)."""

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        stamp = as_of(batch_id) if callable(as_of) else as_of
        batch.persist()  # the size check, the key set and the joins read the source once
        try:
            decided = assign_penalties(batch, rules_loader(), students_loader(), stamp, f"{stream}-{batch_id}")
            decided.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")
        finally:
            batch.unpersist()

    return run_batch


def store_batch_writer(store: LedgerStore, as_of: str | Callable[[int], str], stream: str) -> Callable[[DataFrame, int], None]:
    """The per-micro-batch function of S1 into a store. Rejects are written first (a replay replaces them), then the
    accepted rows are committed together with the micro-batch's number."""

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        if store.stream_number(stream) >= batch_id:
            return  # replayed after its commit
        stamp = as_of(batch_id) if callable(as_of) else as_of
        batch.persist()
        try:
            store.assign(batch, stamp, f"{stream}-{batch_id}", stream=(stream, batch_id),
                         rejects_path=f"{store.root}/_stream_rejects/stream={stream}/batch={batch_id}")
        finally:
            batch.unpersist()

    return run_batch


def stream_assign_into(store: LedgerStore, requests: DataFrame, checkpoint_dir: str, as_of: str | Callable[[int], str],
                       stream: str, available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """S1 into a store: accepted rows join its ledger (and totals) by one commit a micro-batch; rejects land under
    ``_stream_rejects``. ``stream`` names the stream; its rows are added once, however often it is restarted from
    ``checkpoint_dir`` (a new checkpoint needs a new name)."""
    w = requests.writeStream.foreachBatch(store_batch_writer(store, as_of, stream)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def read_assigned(spark: SparkSession, out_dir: str) -> DataFrame:
    """All decided requests written by ``stream_assign`` (all batches)."""
    return spark.read.parquet(out_dir)


def read_total_changes(spark: SparkSession, feed_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A store's published corrections (student_id, points, rows; signed) as a stream."""
    r = spark.readStream.schema(TOTALS).option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{feed_path}/n=*")


def stream_totals(ledger: DataFrame, out_root: str, checkpoint_dir: str, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Running ``points`` and ``rows`` per student.

    ``ledger`` has ``student_id`` and ``points``; with a column ``rows`` its rows
    are signed corrections (points and row counts to add, negative ones to
    take back), without it each row counts once.

    Update mode: each trigger emits only the students whose totals changed in
    that micro-batch (their new absolute totals), written to
    ``out_root/batch=<id>`` with overwrite, so a trigger writes in proportion
    to its input, not to the roster. Every ``TOTALS_FOLD`` batches the totals
    are folded into a snapshot. A batch counts once its record is there; a
    replay of a recorded one does nothing."""
    rows = F.sum("rows") if "rows" in ledger.columns else F.count(F.lit(1))
    totals = ledger.groupBy("student_id").agg(F.sum("points").alias("points"), rows.cast("bigint").alias("rows"))
    w = (totals.writeStream.outputMode("update").foreachBatch(totals_batch_writer(out_root, checkpoint_dir))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def totals_batch_writer(out_root: str, checkpoint_dir: str) -> Callable[[DataFrame, int], None]:
    """The per-micro-batch function of S2."""
    root = out_root.rstrip("/")

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, f"{root}/_totals")
        n, last = log.latest()
        if last is not None:
            if last["checkpoint"] != checkpoint_dir:
                raise ValueError(f"{root} holds the totals of the stream with checkpoint {last['checkpoint']}")
            if last["batch"] >= batch_id:
                return
        path = f"{root}/batch={batch_id}"
        batch.withColumn("as_of_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(path)
        snapshot, since = (last["snapshot"], [*last["since"], path]) if last else (None, [path])
        if len(since) >= TOTALS_FOLD:
            folded = f"{root}/_totals_snapshots/to={batch_id}-{uuid.uuid4().hex[:12]}"
            _latest(spark, [snapshot, *since]).withColumn("as_of_batch", F.lit(batch_id).cast("bigint")).write.parquet(folded)
            snapshot, since = folded, []
        log.append(n + 1, {"batch": batch_id, "checkpoint": checkpoint_dir, "snapshot": snapshot, "since": since})

    return run_batch


def _latest(spark: SparkSession, paths: list[str | None]) -> DataFrame:
    """Per student the row of the latest batch (``max_by`` aggregates partially, so a student in every batch is reduced
    inside each task); students without a row left are left out."""
    d = spark.read.schema(_TOTALS).parquet(*(p for p in paths if p))
    latest = F.max_by(F.struct("points", "rows"), F.col("as_of_batch"))
    return d.groupBy("student_id").agg(latest.alias("_t")).select("student_id", "_t.points", "_t.rows").where(F.col("rows") > 0)


def read_stream_totals(spark: SparkSession, out_root: str) -> DataFrame:
    """Current totals from ``stream_totals``: the last snapshot and the batches
    since, as the latest record names them. At most ``TOTALS_FOLD`` folders
    are read, whatever the stream's age, and no unfinished one."""
    _, last = CommitLog(spark, f"{out_root.rstrip('/')}/_totals").latest()
    if last is None:
        return spark.createDataFrame([], TOTALS)
    return _latest(spark, [last["snapshot"], *last["since"]])


def compact_stream_totals(spark: SparkSession, out_root: str, snapshot_root: str) -> int:
    """Write the current totals as one snapshot version (for readers that want
    a single table); returns the version written."""
    return write_snapshot(read_stream_totals(spark, out_root), snapshot_root, "totals")
