"""Named queries: scans and snapshots (A1-A4), filters and lookups (B*), the
roster-ledger join (D1), totals and counts (E2, E4), and list orders (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators import mutate as mu
from ..operators import ordering as od
from ..operators import thresholds as th
from ..schemas import DEFAULT_RULES, RULES
from ..session import scratch_path
from ..sources import normalize_roster, read_snapshot, roster_required_fields, table_scan, write_snapshot
from ..sources import standin as si
from . import oracles as o
from .changes import current_thresholds
from .registry import query



# == scans, snapshots, seeds (A*) ============================================

@query("table_scan", "SELECT * FROM students")
def q_table_scan(spark, sf):
    """A1: the roster written as a stored table, scanned with its fixed schema."""
    root = scratch_path(spark, "tables")
    v = write_snapshot(si.students(spark, sf), root, "students")
    return table_scan(spark, f"{root}/students/v={v}", "students")


@query("snapshot_write", "SELECT * FROM penalties")
def q_snapshot_write(spark, sf):
    """A3: two committed versions of the ledger; the reader takes the latest."""
    root = scratch_path(spark, "tables")
    p = si.penalties(spark, sf)
    write_snapshot(p.where(F.col("points") > 0), root, "penalties")
    write_snapshot(p, root, "penalties")
    return read_snapshot(spark, root, "penalties")


@query("roster_read", f"""
SELECT seq, {o.js_trim("COALESCE(CAST(id AS VARCHAR), '')")} AS id, {o.js_trim("COALESCE(name, '')")} AS name,
 {o.js_trim("COALESCE(grade, '')")} AS grade, {o.js_trim("COALESCE(student_phone, '')")} AS student_phone,
 {o.js_trim("COALESCE(parent_phone, '')")} AS parent_phone FROM roster_import""")
def q_roster_read(spark, sf):
    """A2: roster rows mapped to columns, missing cells '' and values trimmed."""
    return normalize_roster(si.roster_import(spark, sf))


_SEED_ROWS = " UNION ALL ".join(
    f"SELECT '{i}' AS id, '{t}' AS title, CAST({p} AS BIGINT) AS points, CAST(1 AS BIGINT) AS is_active, "
    f"CAST({s} AS BIGINT) AS sort_order, '{o.AS_OF}' AS created_at, '{o.AS_OF}' AS updated_at"
    for i, t, p, s in DEFAULT_RULES)


@query("seed_if_empty", f"""
SELECT * FROM rules UNION ALL SELECT * FROM ({_SEED_ROWS}) d WHERE NOT EXISTS (SELECT 1 FROM rules)""")
def q_seed_if_empty(spark, sf):
    """A4: default rules added only when the rules table is empty."""
    defaults = spark.createDataFrame(
        [(i, t, p, 1, s, o.AS_OF, o.AS_OF) for i, t, p, s in DEFAULT_RULES], RULES)
    return mu.seed_if_empty(si.rules(spark, sf), defaults)


@query("seed_emptied_rules", f"""
SELECT * FROM (SELECT * FROM rules WHERE id NOT IN (SELECT rule_id FROM penalties)) r
UNION ALL SELECT * FROM ({_SEED_ROWS}) d WHERE NOT EXISTS (SELECT 1 FROM rules WHERE id NOT IN (SELECT rule_id FROM penalties))""")
def q_seed_emptied_rules(spark, sf):
    """A4, the insert branch: every rule that the ledger names is deleted, which leaves none, and the defaults come back."""
    used = si.penalties(spark, sf).select(F.col("rule_id").alias("id"))
    defaults = spark.createDataFrame([(i, t, p, 1, s, o.AS_OF, o.AS_OF) for i, t, p, s in DEFAULT_RULES], RULES)
    return mu.seed_if_empty(mu.delete_by_keys(si.rules(spark, sf), used), defaults)


# == filters and lookups (B*) ================================================

@query("penalties_in_range", """
SELECT r.seq AS request_seq, p.* FROM penalties p JOIN range_requests r ON r.student_id = p.student_id
 AND p.occurred_on BETWEEN COALESCE(NULLIF(r."from", ''), '0000-01-01') AND COALESCE(NULLIF(r."to", ''), '9999-12-31')""")
def q_penalties_in_range(spark, sf):
    """B1: each history request's ledger rows (empty/NULL bounds unbounded)."""
    return ledger.penalties_in_range(si.penalties(spark, sf), si.range_requests(spark, sf))


@query("ledger_total", """
SELECT r.seq AS request_seq, r.student_id, CAST(COALESCE(SUM(p.points), 0) AS BIGINT) AS total
FROM range_requests r LEFT JOIN penalties p ON r.student_id = p.student_id
 AND p.occurred_on BETWEEN COALESCE(NULLIF(r."from", ''), '0000-01-01') AND COALESCE(NULLIF(r."to", ''), '9999-12-31')
GROUP BY r.seq, r.student_id""")
def q_ledger_total(spark, sf):
    """Total of each history request's rows (0 when none)."""
    return ledger.ledger_total(si.penalties(spark, sf), si.range_requests(spark, sf))


@query("notes_for_student", f"""
SELECT * FROM notes WHERE student_id IN (SELECT student_id FROM {o.STATUS} s WHERE threshold_id IS NOT NULL)""")
def q_notes_for_student(spark, sf):
    """B2 (set form): notes of every student at or over a threshold."""
    status = th.threshold_status(ledger.cumulative_points(si.students(spark, sf), si.penalties(spark, sf)),
                                 si.thresholds(spark, sf))
    return ledger.notes_for_students(si.notes(spark, sf), th.exceeded_students(status), key="student_id")


@query("lookup_by_keys", "SELECT * FROM students WHERE id IN (SELECT student_id FROM penalty_requests)")
def q_lookup_by_keys(spark, sf):
    """B3 (set form): the students named by assign requests."""
    return ledger.lookup_by_keys(si.students(spark, sf), si.penalty_requests(spark, sf), key="id",
                                 keys_col="student_id")


@query("active_rules", "SELECT * FROM rules WHERE is_active <> 0")
def q_active_rules(spark, sf):
    """Rules offered for assignment."""
    return ledger.active_rules(si.rules(spark, sf))


@query("roster_required_fields", f"""
SELECT * FROM (SELECT seq, {o.js_trim("COALESCE(CAST(id AS VARCHAR), '')")} AS id, {o.js_trim("COALESCE(name, '')")} AS name,
 {o.js_trim("COALESCE(grade, '')")} AS grade, {o.js_trim("COALESCE(student_phone, '')")} AS student_phone,
 {o.js_trim("COALESCE(parent_phone, '')")} AS parent_phone FROM roster_import) r WHERE id <> '' AND name <> ''""")
def q_roster_required_fields(spark, sf):
    """Roster rows with a non-empty id and name after trimming."""
    return roster_required_fields(normalize_roster(si.roster_import(spark, sf)))


def _view(table, loader):
    cols = ", ".join(ledger.VIEW_COLUMNS[table])
    src = o.THRESHOLDS_CURRENT + " t" if table == "thresholds" else table

    @query(f"{table[:-1] if table != 'penalties' else 'penalty'}_view", f"SELECT {cols} FROM {src}")
    def q(spark, sf):
        return ledger.client_view(loader(spark, sf), table)

    q.__doc__ = f"B8: client projection of {table}."
    return q


for _t, _loader in [("students", si.students), ("rules", si.rules), ("thresholds", current_thresholds),
                    ("notes", si.notes), ("penalties", si.penalties)]:
    _view(_t, _loader)


# == joins and counts ==========================================================

@query("students_left_join_penalties", """
SELECT s.id AS student_id, s.name, s.grade, s.student_phone, s.parent_phone, s.created_at, s.updated_at,
 p.id AS penalty_id, p.rule_id, p.rule_title, p.points, p.occurred_on, p.memo, p.created_at AS penalty_created_at
FROM students s LEFT JOIN penalties p ON p.student_id = s.id""")
def q_students_left_join_penalties(spark, sf):
    """Every student with each ledger row (students without rows once)."""
    return ledger.students_left_join_penalties(si.students(spark, sf), si.penalties(spark, sf))


@query("row_count", f"""
SELECT 'rules' AS table_name, CAST(count(*) AS BIGINT) AS n FROM rules
UNION ALL SELECT 'thresholds', CAST(count(*) AS BIGINT) FROM {o.THRESHOLDS_CURRENT} t""")
def q_row_count(spark, sf):
    """COUNT(*) of rules and thresholds."""
    r = ledger.row_count(si.rules(spark, sf)).select(F.lit("rules").alias("table_name"), F.col("n").cast("bigint"))
    t = ledger.row_count(current_thresholds(spark, sf)).select(F.lit("thresholds").alias("table_name"),
                                                          F.col("n").cast("bigint"))
    return r.unionByName(t)


# == list orders (F*) ==========================================================

_NOCASE = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("students_sorted", f"SELECT * FROM students ORDER BY {_NOCASE.format(c='name')}, id")
def q_students_sorted(spark, sf):
    """the whole roster by name (NOCASE), then id."""
    return od.sorted_rows(si.students(spark, sf), "students")


@query("rules_sorted", f"SELECT * FROM rules ORDER BY sort_order, {_NOCASE.format(c='title')}, id")
def q_rules_sorted(spark, sf):
    """rules by sort_order, then title (NOCASE)."""
    return od.sorted_rows(si.rules(spark, sf), "rules")


@query("thresholds_sorted", f"SELECT * FROM {o.THRESHOLDS_CURRENT} t ORDER BY sort_order, min_points, id")
def q_thresholds_sorted(spark, sf):
    """current thresholds by sort_order, then min_points."""
    return od.sorted_rows(current_thresholds(spark, sf), "thresholds")


@query("penalties_sorted", "SELECT * FROM penalties ORDER BY occurred_on DESC, created_at DESC, id")
def q_penalties_sorted(spark, sf):
    """the whole ledger, most recent rows first (occurred_on, created_at desc)."""
    return od.sorted_rows(si.penalties(spark, sf), "penalties")


@query("notes_sorted", "SELECT * FROM notes ORDER BY noted_on DESC, created_at DESC, id")
def q_notes_sorted(spark, sf):
    """all notes, most recent first (noted_on, created_at desc)."""
    return od.sorted_rows(si.notes(spark, sf), "notes")


@query("summary_sorted", f"SELECT * FROM {o.TOTALS} t ORDER BY {_NOCASE.format(c='name')}, id")
def q_summary_sorted(spark, sf):
    """cumulative summary by name (NOCASE)."""
    return od.sorted_rows(ledger.cumulative_points(si.students(spark, sf), si.penalties(spark, sf)), "summary")


@query("thresholds_by_min", f"""
SELECT id, min_points, label, message_template, sort_order FROM (SELECT *, row_number() OVER
 (PARTITION BY min_points ORDER BY sort_order ASC, id ASC) AS rn FROM {o.THRESHOLDS_CURRENT} t) x WHERE rn = 1""")
def q_thresholds_by_min(spark, sf):
    """current thresholds in min_points order with ties collapsed (message
    rule), the list the message lookup scans."""
    return th.collapse_ties(current_thresholds(spark, sf), th.KEEP_FIRST)
