"""Named queries: table mutations (C1-C13), cascade (D7), edit-or-add (D8), counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages as msg
from ..operators import mutate as mu
from ..sources import standin as si
from . import oracles as o
from .registry import query

_OK_STUDENTS = f"(SELECT * FROM student_upserts WHERE {o.STUDENT_ISSUES} = '')"
_FIELDS = ["name", "grade", "student_phone", "parent_phone"]


def _roster_rows_sql() -> str:
    t = o.js_trim
    return f"""(SELECT seq, {t("COALESCE(CAST(id AS VARCHAR), '')")} AS id, {t("COALESCE(name, '')")} AS name,
 NULLIF({t("COALESCE(grade, '')")}, '') AS grade, NULLIF({t("COALESCE(student_phone, '')")}, '') AS student_phone,
 NULLIF({t("COALESCE(parent_phone, '')")}, '') AS parent_phone FROM roster_import) x"""


_IMPORT_ROWS = f"(SELECT * FROM {_roster_rows_sql()} WHERE id <> '' AND name <> '')"


@query("upsert_students", f"""
SELECT * FROM {o.sql_merge('students', o.sql_last(_OK_STUDENTS), o.STUDENT_COLS, _FIELDS)} m""")
def q_upsert_students(spark, sf):
    """Validated student upserts merged into the roster (last request per id wins)."""
    new, _ = mu.upsert_students(si.students(spark, sf), si.student_upserts(spark, sf), o.AS_OF)
    return new


@query("edit_or_add", f"""
SELECT DISTINCT u.id, CASE WHEN s.id IS NOT NULL THEN 'updated' ELSE 'inserted' END AS op
FROM {_OK_STUDENTS} u LEFT JOIN students s ON s.id = u.id""")
def q_edit_or_add(spark, sf):
    """Per upserted id, whether the upsert updates or inserts."""
    from ..operators.validate import split_valid, validate_students

    ok, _ = split_valid(validate_students(si.student_upserts(spark, sf)))
    return mu.edit_or_add(si.students(spark, sf), ok)


@query("import_students", f"""
SELECT * FROM {o.sql_merge('students', o.sql_last(_IMPORT_ROWS), o.STUDENT_COLS, _FIELDS)} m""")
def q_import_students(spark, sf):
    """Roster import: normalise -> required fields -> '' to NULL ->
    last duplicate wins -> merge."""
    new, _ = mu.import_students(si.students(spark, sf), si.roster_import(spark, sf), o.AS_OF)
    return new


@query("update_students", f"""
SELECT s.id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE s.name END AS name,
 CASE WHEN n.id IS NOT NULL THEN n.grade ELSE s.grade END AS grade,
 CASE WHEN n.id IS NOT NULL THEN n.student_phone ELSE s.student_phone END AS student_phone,
 CASE WHEN n.id IS NOT NULL THEN n.parent_phone ELSE s.parent_phone END AS parent_phone, s.created_at,
 CASE WHEN n.id IS NOT NULL THEN '{o.AS_OF}' ELSE s.updated_at END AS updated_at
FROM students s LEFT JOIN {o.sql_last(_OK_STUDENTS)} n ON n.id = s.id""")
def q_update_students(spark, sf):
    """Updates of existing students only; unknown ids are a no-op."""
    return mu.update_students(si.students(spark, sf), si.student_upserts(spark, sf), o.AS_OF)


def _deleted(spark, sf):
    return mu.delete_students(si.students(spark, sf), si.penalties(spark, sf), si.notes(spark, sf),
                              si.student_deletes(spark, sf))


@query("delete_students", "SELECT * FROM students WHERE id NOT IN (SELECT id FROM student_deletes)")
def q_delete_students(spark, sf):
    """C4: students removed by id."""
    return _deleted(spark, sf)[0]


@query("cascade_delete", "SELECT * FROM penalties WHERE student_id NOT IN (SELECT id FROM student_deletes)")
def q_cascade_delete(spark, sf):
    """D7 (via C4): ledger rows of deleted students removed."""
    return _deleted(spark, sf)[1]


@query("cascade_delete_notes", "SELECT * FROM notes WHERE student_id NOT IN (SELECT id FROM student_deletes)")
def q_cascade_delete_notes(spark, sf):
    """D7 (via C4): notes of deleted students removed."""
    return _deleted(spark, sf)[2]


@query("upsert_rules", f"""
SELECT * FROM {o.sql_merge('rules', o.sql_last(f"(SELECT * FROM {o.RULES_CHECKED} r WHERE issues = '')"),
                           o.RULE_COLS, ['title', 'points', 'is_active', 'sort_order'])} m""")
def q_upsert_rules(spark, sf):
    """Coerced rule upserts merged (generated ids for empty ones)."""
    new, _ = mu.upsert_rules(si.rules(spark, sf), si.rule_upserts(spark, sf), o.AS_OF, o.BATCH)
    return new


@query("delete_rules", "SELECT * FROM rules WHERE id NOT IN (SELECT id FROM rule_deletes)")
def q_delete_rules(spark, sf):
    """Rules removed (ledger rows keep their frozen copies)."""
    return mu.delete_by_keys(si.rules(spark, sf), si.rule_deletes(spark, sf))


@query("upsert_thresholds", f"""
SELECT * FROM {o.sql_merge('thresholds', o.sql_last(f"(SELECT * FROM {o.THRESHOLDS_CHECKED} t WHERE issues = '')"),
                           o.THRESHOLD_COLS, ['min_points', 'label', 'message_template', 'sort_order'])} m""")
def q_upsert_thresholds(spark, sf):
    """Coerced threshold upserts merged."""
    new, _ = mu.upsert_thresholds(si.thresholds(spark, sf), si.threshold_upserts(spark, sf), o.AS_OF, o.BATCH)
    return new


def current_thresholds(spark, sf):
    """The thresholds after the event-derived threshold upserts."""
    return mu.upsert_thresholds(si.thresholds(spark, sf), si.threshold_upserts(spark, sf), o.AS_OF, o.BATCH)[0]


@query("delete_thresholds", f"""
SELECT * FROM {o.THRESHOLDS_CURRENT} t WHERE id NOT IN (SELECT id FROM {o.THRESHOLDS_CURRENT} x WHERE message_template = '')""")
def q_delete_thresholds(spark, sf):
    """Thresholds with an empty template removed by id (from the current table)."""
    cur = current_thresholds(spark, sf)
    return mu.delete_by_keys(cur, cur.where(F.col("message_template") == "").select("id"))


@query("delete_penalties", "SELECT * FROM penalties WHERE id NOT IN (SELECT id FROM penalty_deletes)")
def q_delete_penalties(spark, sf):
    """Ledger rows removed by id."""
    return mu.delete_by_keys(si.penalties(spark, sf), si.penalty_deletes(spark, sf))


_RESET_OK = f"(SELECT * FROM {o.RESETS_CHECKED} r WHERE issues = '')"


@query("reset_penalties", f"""
SELECT * FROM penalties p WHERE NOT EXISTS (SELECT 1 FROM {_RESET_OK} r
 WHERE r.student_id = p.student_id AND p.occurred_on BETWEEN r."from" AND r."to")""")
def q_reset_penalties(spark, sf):
    """C11: ledger after every valid range reset."""
    return mu.reset_penalties(si.penalties(spark, sf), si.reset_requests(spark, sf))[0]


@query("reset_counts", f"""
SELECT r.seq, r.student_id, CASE WHEN r.issues <> '' THEN 'schema' END AS reject_reason,
 CAST(COALESCE(h.n, 0) AS BIGINT) AS deleted
FROM {o.RESETS_CHECKED} r LEFT JOIN (
 SELECT seq, count(*) AS n FROM (SELECT p.id, min(r.seq) AS seq FROM penalties p JOIN {_RESET_OK} r
  ON r.student_id = p.student_id AND p.occurred_on BETWEEN r."from" AND r."to" GROUP BY p.id) f GROUP BY seq
) h ON h.seq = r.seq""")
def q_reset_counts(spark, sf):
    """C11 + E3: rows deleted per reset request (first covering request counts)."""
    return mu.reset_penalties(si.penalties(spark, sf), si.reset_requests(spark, sf))[1]


_NOTES_OK = f"(SELECT * FROM {o.NOTES_CHECKED} n WHERE issues = '')"
_NOTES_R = f"""(SELECT u.*, n.id IS NOT NULL AS nx, s.id IS NOT NULL AS sx FROM {_NOTES_OK} u
 LEFT JOIN notes n ON n.id = u.id LEFT JOIN students s ON s.id = u.student_id)"""
_NOTES_NET = f"""(SELECT r.id, arg_min(r.student_id, r.seq) AS student_id, arg_max(r.noted_on, r.seq) AS noted_on,
 arg_max(r.content, r.seq) AS content
 FROM {_NOTES_R} r LEFT JOIN (SELECT id, min(seq) AS fseq FROM {_NOTES_R} x WHERE NOT nx AND sx GROUP BY id) f ON f.id = r.id
 WHERE r.nx OR r.seq >= f.fseq GROUP BY r.id)"""


@query("upsert_notes", f"""
SELECT * FROM {o.sql_merge('notes', _NOTES_NET, o.NOTE_COLS, ['noted_on', 'content'], ['student_id'])} m""")
def q_upsert_notes(spark, sf):
    """Note upserts; a note's student never changes on conflict; new notes
    need an existing student."""
    new, _ = mu.upsert_notes(si.notes(spark, sf), si.note_upserts(spark, sf), si.students(spark, sf), o.AS_OF, o.BATCH)
    return new


@query("delete_notes", "SELECT * FROM notes WHERE id NOT IN (SELECT id FROM note_deletes)")
def q_delete_notes(spark, sf):
    """Notes removed by id."""
    return mu.delete_by_keys(si.notes(spark, sf), si.note_deletes(spark, sf))


@query("affected_counts", f"""
SELECT 'imported' AS metric, CAST(count(*) AS BIGINT) AS n FROM {_IMPORT_ROWS} i
UNION ALL SELECT 'deleted', CAST(count(*) AS BIGINT) FROM penalties p WHERE EXISTS (SELECT 1 FROM {_RESET_OK} r
 WHERE r.student_id = p.student_id AND p.occurred_on BETWEEN r."from" AND r."to")
UNION ALL SELECT 'sent', CAST(count(*) AS BIGINT) FROM {o.sms_outbox()} x""")
def q_affected_counts(spark, sf):
    """Rows imported (after the required-field filter, duplicates
    included), ledger rows deleted by resets, messages put in the outbox."""
    _, imported = mu.import_students(si.students(spark, sf), si.roster_import(spark, sf), o.AS_OF)
    _, counts = mu.reset_penalties(si.penalties(spark, sf), si.reset_requests(spark, sf))
    prepared = msg.prepare_messages(si.sms_requests(spark, sf), si.students(spark, sf), si.penalties(spark, sf),
                                    si.thresholds(spark, sf))
    sent = msg.message_outbox(prepared, o.SENDER, o.BATCH).agg(F.count(F.lit(1)).alias("n"))
    return (imported.select(F.lit("imported").alias("metric"), F.col("imported").cast("bigint").alias("n"))
            .unionByName(counts.agg(F.coalesce(F.sum("deleted"), F.lit(0)).cast("bigint").alias("n")).select(F.lit("deleted").alias("metric"), "n"))
            .unionByName(sent.select(F.lit("sent").alias("metric"), F.col("n").cast("bigint"))))
