"""Table schemas, request schemas and the fixed values of the domain.

Dates stay STRING (``yyyy-MM-dd`` text checked by a digit pattern only, so
``2024-99-99`` is a legal value and ranges compare lexically); timestamps are
STRING ``yyyy-MM-dd HH:mm:ss`` UTC; integers are BIGINT.
"""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _s(name: str, nullable: bool = True) -> StructField:
    return StructField(name, StringType(), nullable)


def _l(name: str, nullable: bool = True) -> StructField:
    return StructField(name, LongType(), nullable)


STUDENTS = StructType([
    _s("id", False), _s("name", False), _s("grade"), _s("student_phone"), _s("parent_phone"),
    _s("created_at", False), _s("updated_at", False),
])

RULES = StructType([
    _s("id", False), _s("title", False), _l("points", False), _l("is_active", False),
    _l("sort_order", False), _s("created_at", False), _s("updated_at", False),
])

PENALTIES = StructType([
    _s("id", False), _s("student_id", False), _s("rule_id", False), _s("rule_title", False),
    _l("points", False), _s("occurred_on", False), _s("memo"), _s("created_at", False),
])

THRESHOLDS = StructType([
    _s("id", False), _l("min_points", False), _s("label", False), _s("message_template", False),
    _l("sort_order", False), _s("created_at", False), _s("updated_at", False),
])

NOTES = StructType([
    _s("id", False), _s("student_id", False), _s("noted_on", False), _s("content", False),
    _s("created_at", False), _s("updated_at", False),
])

TABLES = {
    "students": STUDENTS,
    "rules": RULES,
    "penalties": PENALTIES,
    "thresholds": THRESHOLDS,
    "notes": NOTES,
}

# Request batches. ``seq`` is the arrival order (a file has no row order in
# Spark, so every batch that needs "last one wins" carries it explicitly).
STUDENT_UPSERTS = StructType([
    _l("seq"), _s("id"), _s("name"), _s("grade"), _s("student_phone"), _s("parent_phone"),
])
RULE_UPSERTS = StructType([
    _l("seq"), _s("id"), _s("title"), _s("points"), _s("is_active"), _s("sort_order"),
])
PENALTY_REQUESTS = StructType([
    _l("seq"), _s("student_id"), _s("rule_id"), _s("occurred_on"), _s("memo"),
])
RESET_REQUESTS = StructType([_l("seq"), _s("student_id"), _s("from"), _s("to")])
THRESHOLD_UPSERTS = StructType([
    _l("seq"), _s("id"), _s("min_points"), _s("label"), _s("message_template"), _s("sort_order"),
])
NOTE_UPSERTS = StructType([
    _l("seq"), _s("id"), _s("student_id"), _s("noted_on"), _s("content"),
])
SMS_REQUESTS = StructType([_l("seq"), _s("student_id"), _s("target"), _s("message")])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference application's for identical output)
# ---------------------------------------------------------------------------

# Roster sheet header -> column (id, name, grade, student phone, parent phone).
ROSTER_HEADERS = {
    "ID": "id",
    "이름": "name",
    "학년": "grade",
    "학생전화": "student_phone",
    "보호자전화": "parent_phone",
}

# Default rules, inserted only when the rules table is empty:
# (id, title, points, sort_order); is_active defaults to 1.
DEFAULT_RULES = [
    ("rule_late", "지각", 1, 1),
    ("rule_phone", "휴대폰 사용", 2, 2),
    ("rule_sleep", "수면", 2, 3),
]

# Default thresholds, inserted only when the thresholds table is empty:
# (id, min_points, label, message_template, sort_order). The message prefix is
# the generic center tag of the default message (the reference's own prefix
# names its operator and is not reproduced).
DEFAULT_THRESHOLDS = [
    ("th_5", 5, "주의",
     "[센터] {name} 학생 벌점 누적 {points}점입니다. 학습태도 점검 부탁드립니다.", 1),
    ("th_10", 10, "경고",
     "[센터] {name} 학생 벌점 누적 {points}점으로 기준치를 초과했습니다. 센터로 연락 부탁드립니다.", 2),
]

# Message template used when no threshold is reached or its template is empty.
DEFAULT_MESSAGE_TEMPLATE = "[센터] {name} 학생 벌점 누적 {points}점입니다."

# Badge shown for a student below every threshold.
BADGE_NORMAL = "정상"

# Unbounded range ends used when a range bound is missing or empty.
RANGE_MIN = "0000-01-01"
RANGE_MAX = "9999-12-31"

# Send targets.
TARGETS = ("student", "parent", "both")

# Id prefixes of generated keys.
ID_PREFIX_RULE = "rule"
ID_PREFIX_THRESHOLD = "th"
ID_PREFIX_PENALTY = "pen"
ID_PREFIX_NOTE = "note"
