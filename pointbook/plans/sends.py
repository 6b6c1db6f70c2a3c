"""Named queries: the send path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import default_message, normalize_phone, render_template
from ..operators import messages as msg
from ..operators import thresholds as th
from ..sources import standin as si
from . import oracles as o
from .registry import query
from .totals import _totals


# == messages =================================================================


def _prepared(spark, sf):
    return msg.prepare_messages(si.sms_requests(spark, sf), si.students(spark, sf), si.penalties(spark, sf),
                                si.thresholds(spark, sf))


@query("message_outbox", f"SELECT * FROM {o.sms_outbox()} x")
def q_message_outbox(spark, sf):
    """A5 (flagship): ledger -> totals -> best threshold -> default message ->
    distinct recipients -> one outbox row per recipient."""
    return msg.message_outbox(_prepared(spark, sf), o.SENDER, o.BATCH).withColumn("pos", F.col("pos").cast("bigint"))


@query("message_rejects", f"""
SELECT seq, student_id, CASE WHEN issues <> '' THEN 'schema' WHEN NOT found THEN 'student_not_found'
 ELSE 'no_recipient' END AS reject_reason, issues
FROM {o.sms_prepared()} q WHERE issues <> '' OR NOT found OR (sp IS NULL AND pp IS NULL)""")
def q_message_rejects(spark, sf):
    """J7 + D6 + H1 rejects: schema, unknown student, no recipient."""
    return msg.message_rejects(_prepared(spark, sf))


@query("distinct_recipients", f"""
SELECT seq, student_id, CASE WHEN sp IS NULL THEN COALESCE(pp, '') WHEN pp IS NULL OR pp = sp THEN sp
 ELSE sp || ',' || pp END AS recipients, CAST((sp IS NOT NULL)::INT + (pp IS NOT NULL AND (sp IS NULL OR pp <> sp))::INT AS BIGINT) AS n
FROM {o.sms_prepared()} q WHERE found""")
def q_distinct_recipients(spark, sf):
    """H1: normalised, de-duplicated recipient numbers per send request."""
    s = si.students(spark, sf)
    j = msg.sms_student_lookup(si.sms_requests(spark, sf), s).where(F.col("_found"))
    r = msg.distinct_recipients("target", "student_phone", "parent_phone")
    return j.select("seq", "student_id", F.array_join(r, ",").alias("recipients"), F.size(r).cast("bigint").alias("n"))


@query("sms_student_lookup", """
SELECT r.seq, r.student_id, s.name, s.student_phone, s.parent_phone, s.id IS NOT NULL AS found
FROM sms_requests r LEFT JOIN students s ON s.id = r.student_id""")
def q_sms_student_lookup(spark, sf):
    """Send requests with their student (``found`` false when unknown)."""
    j = msg.sms_student_lookup(si.sms_requests(spark, sf), si.students(spark, sf))
    return j.select("seq", "student_id", "name", "student_phone", "parent_phone", F.col("_found").alias("found"))


@query("normalize_phone", f"""
SELECT id, {o.sql_norm_phone('student_phone')} AS student_phone_n, {o.sql_norm_phone('parent_phone')} AS parent_phone_n
FROM students""")
def q_normalize_phone(spark, sf):
    """I6 over every roster phone."""
    s = si.students(spark, sf)
    return s.select("id", normalize_phone("student_phone").alias("student_phone_n"),
                    normalize_phone("parent_phone").alias("parent_phone_n"))


@query("render_template", f"""
SELECT id AS student_id, threshold_id,
 {o.sql_render('threshold_template', 'name', 'CAST(points AS VARCHAR)', 'CAST(threshold_min_points AS VARCHAR)',
  'threshold_label')} AS text
FROM {o.BEST} b WHERE threshold_id IS NOT NULL""")
def q_render_template(spark, sf):
    """The reached threshold's own template rendered for each student who
    reached one (single pass; unknown variables empty; no fallback text)."""
    from ..functions import message_variables

    b = th.best_threshold(_totals(spark, sf), si.thresholds(spark, sf)).where(F.col("threshold_id").isNotNull())
    v = message_variables("name", "points", "threshold_min_points", "threshold_label")
    return b.select(F.col("id").alias("student_id"), "threshold_id",
                    render_template("threshold_template", v).alias("text"))


@query("default_message", f"""
SELECT id AS student_id, {o.js_trim(o.sql_render(f"COALESCE(NULLIF(threshold_template, ''), {o.DEFAULT_TPL})",
  "COALESCE(name, '')", "CAST(points AS VARCHAR)", "COALESCE(CAST(threshold_min_points AS VARCHAR), '')",
  "COALESCE(threshold_label, '')"))} AS text
FROM {o.BEST} b""")
def q_default_message(spark, sf):
    """I8: default message per student (best threshold's template or the fallback)."""
    b = th.best_threshold(_totals(spark, sf), si.thresholds(spark, sf))
    return b.select(F.col("id").alias("student_id"),
                    default_message("threshold_template", "name", "points", "threshold_min_points",
                                    "threshold_label").alias("text"))
