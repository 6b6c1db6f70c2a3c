"""Named queries: admissibility checks (J1-J8) and penalty assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate as mu
from ..operators import validate as va
from ..sources import standin as si
from . import oracles as o
from .registry import query


def _issues():
    return F.array_join(F.col("issues"), ",").alias("issues")


@query("validate_students", f"SELECT seq, id, {o.STUDENT_ISSUES} AS issues FROM student_upserts")
def q_validate_students(spark, sf):
    """J1 over student upsert requests."""
    return va.validate_students(si.student_upserts(spark, sf)).select("seq", "id", _issues())


@query("validate_rules", f"SELECT seq, id, title, points, is_active, sort_order, issues FROM {o.RULES_CHECKED} r")
def q_validate_rules(spark, sf):
    """J2 + I5 coercion over rule upsert requests (ids generated when empty)."""
    v = va.validate_rules(si.rule_upserts(spark, sf), o.BATCH)
    return v.select("seq", "id", "title", "points", "is_active", "sort_order", _issues())


@query("validate_penalties", f"SELECT seq, issues FROM {o.PENALTIES_CHECKED} p")
def q_validate_penalties(spark, sf):
    """J3 over assign requests."""
    return va.validate_penalties(si.penalty_requests(spark, sf)).select("seq", _issues())


@query("validate_resets", f"SELECT seq, issues FROM {o.RESETS_CHECKED} r")
def q_validate_resets(spark, sf):
    """J4 over range-reset requests."""
    return va.validate_resets(si.reset_requests(spark, sf)).select("seq", _issues())


@query("validate_thresholds", f"""
SELECT seq, id, label, min_points, message_template, sort_order, issues FROM {o.THRESHOLDS_CHECKED} t""")
def q_validate_thresholds(spark, sf):
    """J5 + coercion over threshold upsert requests."""
    v = va.validate_thresholds(si.threshold_upserts(spark, sf), o.BATCH)
    return v.select("seq", "id", "label", "min_points", "message_template", "sort_order", _issues())


@query("validate_notes", f"SELECT seq, id, issues FROM {o.NOTES_CHECKED} n")
def q_validate_notes(spark, sf):
    """J6 over note upsert requests (ids generated when empty)."""
    return va.validate_notes(si.note_upserts(spark, sf), o.BATCH).select("seq", "id", _issues())


_SMS_ISSUES = o.sql_issues(o.sql_non_empty("student_id") + [("target IS NULL", "target:required"), ("target NOT IN ('student', 'parent', 'both')", "target:enum")]
                           + o.sql_non_empty("message"))


@query("validate_sms", f"SELECT seq, {_SMS_ISSUES} AS issues FROM sms_requests")
def q_validate_sms(spark, sf):
    """J7 over send requests."""
    return va.validate_sms(si.sms_requests(spark, sf)).select("seq", _issues())


def _blank(c: str) -> str:
    return f"COALESCE({o.js_trim(c)}, '') = ''"


def _unchosen(c: str) -> str:
    return f"COALESCE({c}, '') = ''"


# Each form's checks, and its requests.
_FORMS = {
    "students": ("student_upserts", si.student_upserts, [(_blank("id"), "id:blank"), (_blank("name"), "name:blank")]),
    "penalties": ("penalty_requests", si.penalty_requests, [(_unchosen("student_id"), "student_id:blank"), (_unchosen("rule_id"), "rule_id:blank")]),
    "notes": ("note_upserts", si.note_upserts, [(_unchosen("student_id"), "student_id:blank"), (_blank("content"), "content:blank")]),
    "sms": ("sms_requests", si.sms_requests, [(_unchosen("student_id"), "student_id:blank"), (f"message IS NOT NULL AND {_blank('message')}", "message:blank")]),
    "resets": ("reset_requests", si.reset_requests, [(_unchosen("student_id"), "student_id:blank"), ('"from" > "to"', "range:reversed")]),
}


def _precheck(form: str) -> None:
    view, loader, checks = _FORMS[form]

    @query("precheck" if form == "students" else f"precheck_{form}", f"SELECT seq, {o.sql_issues(checks)} AS precheck FROM {view}")
    def q(spark, sf):
        return va.precheck(loader(spark, sf), form).select("seq", F.array_join("precheck", ",").alias("precheck"))

    q.__doc__ = f"J8: the client's checks of the {form} form."


for _form in _FORMS:
    _precheck(_form)


@query("history_rejects", f"""
SELECT seq, student_id, {o.sql_issues(o.sql_non_empty('student_id'))} AS issues FROM range_requests WHERE COALESCE(student_id, '') = ''""")
def q_history_rejects(spark, sf):
    """B1 / B2: history requests without a student id are errors."""
    return va.missing_student(si.range_requests(spark, sf)).select("seq", "student_id", _issues())


# == assignment ===============================================================

def _decided(spark, sf):
    return mu.assign_penalties(si.penalty_requests(spark, sf), si.rules(spark, sf), si.students(spark, sf),
                               o.AS_OF, o.BATCH)


@query("assign_penalties", f"""
SELECT {', '.join(o.PENALTY_COLS)} FROM {o.ASSIGN_DECIDED} d WHERE reject_reason IS NULL""")
def q_assign_penalties(spark, sf):
    """Validated requests -> current rule title/points frozen on the row ->
    student must exist -> ledger rows to append."""
    return mu.accepted_penalties(_decided(spark, sf))


@query("assign_rejects", f"""
SELECT seq, student_id, rule_id, occurred_on, reject_reason, issues FROM {o.ASSIGN_DECIDED} d
WHERE reject_reason IS NOT NULL""")
def q_assign_rejects(spark, sf):
    """C9 quarantine: schema -> rule_not_found -> student_not_found."""
    return mu.rejected_penalties(_decided(spark, sf))


@query("penalty_rule_snapshot", """
SELECT p.seq, p.rule_id, r.title AS rule_title, r.points, r.id IS NOT NULL AS rule_found
FROM penalty_requests p LEFT JOIN rules r ON r.id = p.rule_id""")
def q_penalty_rule_snapshot(spark, sf):
    """Each request enriched with its rule's current title and points."""
    j = mu.rule_snapshot(si.penalty_requests(spark, sf), si.rules(spark, sf))
    return j.select("seq", "rule_id", "rule_title", "points", F.col("_rid").isNotNull().alias("rule_found"))


@query("student_fk_check", """
SELECT p.seq, p.student_id, EXISTS (SELECT 1 FROM students s WHERE s.id = p.student_id) AS student_exists
FROM penalty_requests p""")
def q_student_fk_check(spark, sf):
    """D3: requests flagged by whether their student exists (one join)."""
    from ..operators.ledger import with_student_found

    return with_student_found(si.penalty_requests(spark, sf).select("seq", "student_id"), si.students(spark, sf))
