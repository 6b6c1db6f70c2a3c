"""Outgoing messages: student lookup, recipients, rendered text, outbox rows.

The reference sends one request at a time to a gateway; here a batch of send
requests becomes an *outbox* DataFrame with one row per distinct recipient
(idempotent key = batch + request seq + position), plus a quarantine of rejected
requests. Delivery itself is outside the library.

Plan: the ledger is pre-aggregated once (``cumulative_points``), thresholds
go through the bounded-broadcast lookup, the request join is an equi-join
AQE sizes at run time, and recipients are a narrow ``posexplode`` of an
array of at most two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import default_message, gen_id, js_trim, normalize_phone
from .guards import restrict_to_keys
from .ledger import cumulative_points, with_points
from .thresholds import best_threshold
from .validate import first_reason, issues_of, non_empty, target_field


def distinct_recipients(target, student_phone, parent_phone) -> Column:
    """H1: normalised numbers for the target (student first, then parent),
    NULLs dropped, duplicates after normalisation removed, order kept."""
    t = F.col(target) if isinstance(target, str) else target
    s = F.when(t.isin("student", "both"), normalize_phone(student_phone))
    p = F.when(t.isin("parent", "both"), normalize_phone(parent_phone))
    return F.array_distinct(F.array_compact(F.array(s, p)))


def sms_student_lookup(requests: DataFrame, students: DataFrame) -> DataFrame:
    """Each request with its student's columns (``_found`` false when the
    student does not exist)."""
    s = students.select(F.col("id").alias("_sid"), F.lit(True).alias("_found"),
                        *[c for c in students.columns if c != "id"])
    j = requests.join(s, F.col("student_id") == F.col("_sid"), "left").drop("_sid")
    return j.withColumn("_found", F.coalesce("_found", F.lit(False)))


def prepare_messages(requests: DataFrame, students: DataFrame, penalties: DataFrame,
                     thresholds: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Every request with ``issues``, ``reject_reason`` (NULL when accepted),
    the message ``text`` and the ``recipients`` array.

    A request without ``message`` gets the default message (I8) of its
    student: the best reached threshold's template (message tie rule) or
    the default text, rendered with the student's name and total.
    Reject order: schema -> student_not_found -> no_recipient. A text that is
    blank after rendering and trimming is never sent: it is a schema issue
    (``message:empty``), as a blank given message is.
    A small batch narrows roster and ledger to its students first
    (``restrict_to_keys``); a batch for everyone aggregates the ledger once.
    Kept ``totals`` (student_id, points), if given, stand in for the ledger.
    """
    if totals is None:
        students, penalties = restrict_to_keys([(students, "id"), (penalties, "student_id")], requests, "student_id")
        pointed = cumulative_points(students, penalties)
    else:
        students, totals = restrict_to_keys([(students, "id"), (totals, "student_id")], requests, "student_id")
        pointed = with_points(students, totals)
    totals = best_threshold(pointed, thresholds)
    j = sms_student_lookup(requests, totals)
    rendered = default_message("threshold_template", "name", "points", "threshold_min_points", "threshold_label")
    text = js_trim(F.coalesce(F.col("message"), rendered))
    # nothing is composed for a student that does not exist: the lookup rejects the request
    composed = F.when(F.col("message").isNull() & ~F.col("_found"), F.lit(None)).otherwise(text == "")
    issues = issues_of(*non_empty("student_id"), *target_field("target"), (composed, "message:empty"))
    recips = distinct_recipients("target", "student_phone", "parent_phone")
    return j.select(
        "seq", "student_id", "target", issues.alias("issues"), text.alias("text"), recips.alias("recipients"),
        first_reason(
            (F.size(issues) > 0, "schema"),
            (~F.col("_found"), "student_not_found"),
            (F.size(recips) == 0, "no_recipient"),
        ).alias("reject_reason"),
    )


def message_outbox(prepared: DataFrame, sender: str, batch: str) -> DataFrame:
    """A5: one row per accepted request and distinct recipient:
    ``outbox_id, seq, student_id, pos, to, from, text``."""
    ok = prepared.where(F.col("reject_reason").isNull())
    ex = ok.select("seq", "student_id", "text", F.posexplode("recipients").alias("pos", "to"))
    return ex.select(
        gen_id("sms", F.lit(batch), "seq", "pos").alias("outbox_id"), "seq", "student_id", "pos", "to",
        normalize_phone(F.lit(sender)).alias("from"), "text")


def not_yet_sent(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    """The outbox rows whose ``outbox_id`` is not among those handed over
    before (``sent``): a batch that is repeated, or one that overlaps it,
    sends nothing twice."""
    return outbox.join(sent.select("outbox_id").distinct(), "outbox_id", "left_anti").select(*outbox.columns)


def message_rejects(prepared: DataFrame) -> DataFrame:
    """Rejected send requests with their first reason and all schema issues."""
    return (prepared.where(F.col("reject_reason").isNotNull())
            .select("seq", "student_id", "reject_reason", F.array_join("issues", ",").alias("issues")))


def write_outbox(outbox: DataFrame, root: str, batch_id: int) -> str:
    """Sink of A5: the outbox rows of one send batch into ``<root>/batch=<id>``,
    overwritten on a retry (rows carry their idempotent ``outbox_id``), so a
    deliverer can pick up each batch once. Returns the folder written."""
    path = f"{root.rstrip('/')}/batch={batch_id}"
    outbox.write.mode("overwrite").parquet(path)
    return path
