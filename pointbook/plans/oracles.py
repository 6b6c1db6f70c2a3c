"""DuckDB SQL for the correctness check: stand-in views as CTEs + one query each.

The CTEs rebuild the stand-in inputs of ``sources.standin`` from the driver's
tables independently of the Spark code, so a mismatch in either shows up.
"""

from __future__ import annotations

# Name of the request batches that the queries apply.
BATCH = "b-2024-03"

_K8 = "lpad(CAST(c_custkey AS VARCHAR), 8, '0')"

VIEWS = {
    "students": f"""
SELECT CAST(c_custkey AS VARCHAR) AS id,
 CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE lower(c_name) END AS name,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS grade,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '10' || {_K8} ELSE '010-' || {_K8} END AS student_phone,
 CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '010 ' || {_K8}
  ELSE '+82 10-' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0') END AS parent_phone,
 '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at
FROM customer""",
    "rules": """
SELECT 'rule_' || event_type AS id, event_type AS title,
 CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE -1 END AS BIGINT) AS points,
 CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS BIGINT) AS is_active,
 CAST(CASE WHEN event_type IN ('click','view') THEN 1 ELSE 2 END AS BIGINT) AS sort_order,
 '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at
FROM (SELECT DISTINCT event_type FROM events) e""",
    "thresholds": """
SELECT id, min_points, label, message_template, sort_order,
 '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at FROM (VALUES
 ('th_5', CAST(5 AS BIGINT), 'L5', '[X] {name} at {points}', CAST(1 AS BIGINT)),
 ('th_70a', CAST(70 AS BIGINT), 'L70A', '{label}: {name} {points}/{threshold}{nope}', CAST(3 AS BIGINT)),
 ('th_70b', CAST(70 AS BIGINT), 'L70B', '{label}: {name} {points}/{threshold}', CAST(2 AS BIGINT)),
 ('th_85', CAST(85 AS BIGINT), 'L85', '', CAST(4 AS BIGINT)),
 ('th_95', CAST(95 AS BIGINT), 'L95', ' {nope} ', CAST(5 AS BIGINT))) AS t(id, min_points, label, message_template, sort_order)""",
    "penalties": """
SELECT 'pen_' || CAST(e.event_id AS VARCHAR) AS id, CAST(e.user_id AS VARCHAR) AS student_id,
 'rule_' || e.event_type AS rule_id, e.event_type AS rule_title,
 CAST(CASE e.event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE -1 END AS BIGINT) AS points,
 substr(CAST(e.ts AS VARCHAR), 1, 10) AS occurred_on,
 CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE e.props END AS memo, substr(CAST(e.ts AS VARCHAR), 1, 19) AS created_at
FROM events e""",
    "penalty_requests": """
SELECT e.event_id AS seq,
 CASE WHEN e.event_id % 97 = 0 THEN 'ghost' WHEN e.event_id % 101 = 0 THEN '' ELSE CAST(e.user_id AS VARCHAR) END AS student_id,
 CASE WHEN e.event_id % 89 = 0 THEN 'rule_none' ELSE 'rule_' || e.event_type END AS rule_id,
 CASE WHEN e.event_id % 83 = 0 THEN '2024-1-1' WHEN e.event_id % 79 = 0 THEN '2024-99-99' ELSE substr(CAST(e.ts AS VARCHAR), 1, 10) END AS occurred_on,
 e.props AS memo FROM events e""",
    "notes": """
SELECT 'note_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS student_id,
 '2024-01-' || lpad(CAST(1 + turn AS VARCHAR), 2, '0') AS noted_on, text AS content,
 '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at FROM conversations""",
    "roster_import": """
SELECT c_custkey AS seq, CASE WHEN c_custkey % 71 = 0 THEN '' WHEN c_custkey % 73 = 0 THEN NULL ELSE '  ' || CAST(c_custkey AS VARCHAR) END AS id,
  CASE WHEN c_custkey % 67 = 0 THEN '' WHEN c_custkey % 79 = 0 THEN NULL ELSE c_name || ' ' END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'G2' END AS grade, CAST(NULL AS VARCHAR) AS student_phone, '01012345678' AS parent_phone
  FROM customer
UNION ALL SELECT c_custkey + 1000000, CAST(c_custkey AS VARCHAR), 'dup ' || c_name, 'G3', '', ''
  FROM customer WHERE c_custkey % 30 = 0
UNION ALL SELECT c_custkey + 2000000, 'new' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 100 = 0 THEN ' ' ELSE c_name END, 'G1', '', ''
  FROM customer WHERE c_custkey % 50 = 0""",
    "student_upserts": "SELECT * FROM roster_import",
    "range_requests": """
SELECT c_custkey AS seq, CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 61 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS student_id,
 CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE '2024-01-' || lpad(CAST(c_custkey % 20 + 1 AS VARCHAR), 2, '0') END AS "from",
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS "to"
FROM customer""",
    "reset_requests": """
SELECT c_custkey AS seq, CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 61 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS student_id,
 CASE WHEN c_custkey % 17 = 0 THEN '2024-1-5' ELSE '2024-01-' || lpad(CAST(c_custkey % 20 + 1 AS VARCHAR), 2, '0') END AS "from",
 '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS "to"
FROM customer""",
    "rule_upserts": """
SELECT CAST(1 AS BIGINT) AS seq, 'rule_' || event_type AS id, upper(substr(event_type, 1, 1)) || substr(event_type, 2, 100) AS title,
 CASE event_type WHEN 'click' THEN ' 2 ' WHEN 'view' THEN '1e1' WHEN 'error' THEN '2.5' WHEN 'signup' THEN '' ELSE '-3' END AS points,
 CASE WHEN event_type = 'view' THEN '0' ELSE NULL END AS is_active,
 CASE WHEN event_type = 'error' THEN 'x' ELSE '5' END AS sort_order
FROM (SELECT DISTINCT event_type FROM events) e
UNION ALL
SELECT CAST(2 AS BIGINT), CASE WHEN event_type = 'click' THEN 'rule_click' ELSE '' END, event_type || '_late', '3', NULL, NULL
FROM (SELECT DISTINCT event_type FROM events) e""",
    "threshold_upserts": """
SELECT n AS seq,
 CASE WHEN event_type = 'signup' THEN 'th_70a' WHEN event_type = 'purchase' THEN '' ELSE 'th_' || event_type END AS id,
 CAST(n % 97 AS VARCHAR) AS min_points,
 CASE WHEN event_type = 'error' THEN '' ELSE upper(event_type) END AS label,
 CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN '{label} {name}' ELSE '{name} ' || event_type END AS message_template,
 CASE WHEN event_type = 'view' THEN '1' ELSE NULL END AS sort_order
FROM (SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type) e""",
    "note_upserts": """
SELECT conv_id * 100 + turn AS seq,
 CASE WHEN turn % 2 = 1 THEN '' ELSE 'note_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) END AS id,
 CASE WHEN turn % 2 = 0 THEN CAST(conv_id + 1 AS VARCHAR) WHEN conv_id % 19 = 3 THEN '' WHEN conv_id % 19 = 5 THEN 'ghost' ELSE CAST(conv_id AS VARCHAR) END AS student_id,
 CASE WHEN turn % 2 = 0 THEN '2024-02-01' WHEN role = 'assistant' AND conv_id % 2 = 0 THEN '2024-2-1' ELSE '2024-02-02' END AS noted_on,
 CASE WHEN conv_id % 23 = 4 THEN '' WHEN turn % 2 = 1 THEN text ELSE text || ' (edited)' END AS content
FROM conversations""",
    "sms_requests": """
SELECT c_custkey AS seq,
 CASE WHEN c_custkey % 47 = 0 THEN 'ghost' WHEN c_custkey % 53 = 0 THEN '' WHEN c_custkey % 107 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS student_id,
 CASE WHEN c_custkey % 41 = 0 THEN 'teacher' WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'student' WHEN c_custkey % 5 = 2 THEN 'parent' ELSE 'both' END AS target,
 CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN ' ' || chr(9) || chr(12288)
  WHEN c_custkey % 10 = 9 THEN '  notice ' || CAST(c_custkey AS VARCHAR) || chr(10) END AS message FROM customer""",
    "student_deletes": "SELECT id FROM students WHERE grade IS NULL",
    "rule_deletes": "SELECT id FROM rules WHERE is_active = 0",
    "penalty_deletes": "SELECT 'pen_' || CAST(seq AS VARCHAR) AS id FROM penalty_requests WHERE rule_id = 'rule_none'",
    "note_deletes": """
SELECT 'note_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id FROM conversations WHERE role = 'system'""",
}

# JavaScript trim as an RE2 pattern (same class as functions.text).
JS_WS = r"[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def js_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '\\A{JS_WS}+|{JS_WS}+\\z', '', 'g')"


def with_views(body: str) -> str:
    """Prefix ``body`` with every stand-in view as a CTE (unused ones cost nothing)."""
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in VIEWS.items())
    return f"WITH {ctes}\n{body.strip()}"


def sql_norm_phone(x: str) -> str:
    """I6 in DuckDB SQL."""
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"(CASE WHEN {d} IS NULL OR {d} = '' THEN NULL WHEN {d} LIKE '0%' THEN {d} ELSE '0' || {d} END)"


def sql_render(tpl: str, name: str, points: str, threshold: str, label: str) -> str:
    """I7 in DuckDB SQL: split on placeholders, interleave values (single pass)."""
    parts = f"regexp_split_to_array({tpl}, '\\{{\\w+\\}}')"
    keys = f"regexp_extract_all({tpl}, '\\{{(\\w+)\\}}', 1)"
    val = (f"CASE {keys}[i] WHEN 'name' THEN {name} WHEN 'points' THEN {points} "
           f"WHEN 'threshold' THEN {threshold} WHEN 'label' THEN {label} ELSE '' END")
    return (f"(CASE WHEN {tpl} IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, len({parts}) + 1), "
            f"lambda i: {parts}[i] || coalesce({val}, '')), '') END)")


def sql_gen_id(prefix: str, *parts: str, batch: str = BATCH) -> str:
    """I11 in DuckDB SQL, for rows of the named batch."""
    texts = [f"CAST({p} AS VARCHAR)" for p in (f"'{batch}'", *parts)]
    keyed = " || ".join(f"COALESCE(CAST(length({t}) AS VARCHAR) || ':' || {t}, 'n')" for t in texts)
    return f"('{prefix}_' || substr(sha256({keyed}), 1, 32))"


TOTALS = """(SELECT s.*, CAST(COALESCE(p.sum_points, 0) AS BIGINT) AS points FROM students s
 LEFT JOIN (SELECT student_id, SUM(points) AS sum_points FROM penalties GROUP BY student_id) p ON p.student_id = s.id)"""
TH_LAST = """(SELECT id, min_points, label, message_template, sort_order FROM (SELECT *, row_number() OVER
 (PARTITION BY min_points ORDER BY sort_order DESC, id DESC) AS rn FROM thresholds) x WHERE rn = 1)"""
TH_FIRST = """(SELECT id, min_points, label, message_template, sort_order FROM (SELECT *, row_number() OVER
 (PARTITION BY min_points ORDER BY sort_order ASC, id ASC) AS rn FROM thresholds) x WHERE rn = 1)"""
BEST = f"""(SELECT t.*, h.id AS threshold_id, h.min_points AS threshold_min_points, h.label AS threshold_label,
 h.message_template AS threshold_template, h.sort_order AS threshold_sort_order
 FROM {TOTALS} t ASOF LEFT JOIN {TH_FIRST} h ON t.points >= h.min_points)"""
STATUS = f"""(SELECT t.id AS student_id, t.name, t.points, h.id AS threshold_id,
 CASE WHEN h.id IS NULL THEN '정상' WHEN h.label = '' THEN '>=' || CAST(h.min_points AS VARCHAR) ELSE h.label END AS badge
 FROM {TOTALS} t ASOF LEFT JOIN {TH_LAST} h ON t.points >= h.min_points)"""

DEFAULT_TPL = "'[센터] {name} 학생 벌점 누적 {points}점입니다.'"
SENDER = "02-1234-5678"


def sms_prepared() -> str:
    """Send requests with text, both candidate numbers and validity."""
    rendered = sql_render(f"COALESCE(NULLIF(b.threshold_template, ''), {DEFAULT_TPL})", "COALESCE(b.name, '')",
                          "CAST(b.points AS VARCHAR)", "COALESCE(CAST(b.threshold_min_points AS VARCHAR), '')",
                          "COALESCE(b.threshold_label, '')")
    return f"""(SELECT r.seq, r.student_id, r.target,
 {js_trim(f"COALESCE(r.message, {rendered})")} AS text,
 CASE WHEN r.target IN ('student', 'both') THEN {sql_norm_phone('b.student_phone')} END AS sp,
 CASE WHEN r.target IN ('parent', 'both') THEN {sql_norm_phone('b.parent_phone')} END AS pp,
 concat_ws(',', CASE WHEN r.student_id IS NULL THEN 'student_id:required' END,
  CASE WHEN r.student_id = '' THEN 'student_id:empty' END,
  CASE WHEN r.target IS NULL THEN 'target:required' END,
  CASE WHEN r.target NOT IN ('student', 'parent', 'both') THEN 'target:enum' END,
  CASE WHEN (r.message IS NOT NULL OR b.id IS NOT NULL) AND {js_trim(f"COALESCE(r.message, {rendered})")} = '' THEN 'message:empty' END) AS issues,
 b.id IS NOT NULL AS found
 FROM sms_requests r LEFT JOIN {BEST} b ON b.id = r.student_id)"""


def sms_outbox(batch: str = BATCH) -> str:
    return f"""(SELECT {sql_gen_id('sms', 'seq', 'pos', batch=batch)} AS outbox_id, seq, student_id, pos, "to",
 {sql_norm_phone(f"'{SENDER}'")} AS "from", text FROM (
 SELECT seq, student_id, CAST(0 AS BIGINT) AS pos, sp AS "to", text FROM {sms_prepared()} q
  WHERE issues = '' AND found AND sp IS NOT NULL
 UNION ALL
 SELECT seq, student_id, CAST(CASE WHEN sp IS NULL THEN 0 ELSE 1 END AS BIGINT), pp, text FROM {sms_prepared()} q
  WHERE issues = '' AND found AND pp IS NOT NULL AND (sp IS NULL OR pp <> sp)) o)"""


AS_OF = "2024-02-01 00:00:00"


def sql_to_integer(x: str) -> str:
    """I5 in DuckDB SQL."""
    t = js_trim(x)
    d = f"TRY_CAST({t} AS DOUBLE)"
    pat = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {t} = '' THEN CAST(0 AS BIGINT) "
            f"WHEN regexp_full_match({t}, '{pat}') AND {d} = floor({d}) AND abs({d}) <= 9007199254740991 "
            f"THEN CAST({d} AS BIGINT) END)")


def sql_ymd(x: str) -> str:
    return f"COALESCE(regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false)"


def sql_non_empty(f: str, q: str | None = None) -> list[tuple[str, str]]:
    c = q or f'"{f}"'
    return [(f"{c} IS NULL", f"{f}:required"), (f"{c} = ''", f"{f}:empty")]


def sql_ymd_field(f: str, q: str | None = None) -> list[tuple[str, str]]:
    c = q or f'"{f}"'
    return [(f"{c} IS NULL", f"{f}:required"), (f"{c} IS NOT NULL AND NOT {sql_ymd(c)}", f"{f}:format")]


def sql_issues(checks: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in checks) + ")"


def sql_last(src: str, key: str = "id", seq: str = "seq") -> str:
    """Last request per key by seq."""
    return (f"(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {seq} DESC) "
            f"AS rn_ FROM {src}) z WHERE rn_ = 1)")


def sql_merge(base: str, net: str, cols: list[str], update_cols: list[str], keep_cols: list[str] = (),
              key: str = "id") -> str:
    """Full outer merge of one-row-per-key changes into a table (C1 pattern)."""
    out = []
    for c in cols:
        if c == key:
            out.append(f"COALESCE(b.{key}, n.{key}) AS {key}")
        elif c in update_cols:
            out.append(f"CASE WHEN n.{key} IS NOT NULL THEN n.{c} ELSE b.{c} END AS {c}")
        elif c in keep_cols:
            out.append(f"CASE WHEN b.{key} IS NOT NULL THEN b.{c} ELSE n.{c} END AS {c}")
        elif c == "created_at":
            out.append(f"CASE WHEN b.{key} IS NOT NULL THEN b.created_at ELSE '{AS_OF}' END AS created_at")
        elif c == "updated_at":
            out.append(f"CASE WHEN n.{key} IS NOT NULL THEN '{AS_OF}' ELSE b.updated_at END AS updated_at")
        else:
            out.append(f"b.{c} AS {c}")
    return f"(SELECT {', '.join(out)} FROM {base} b FULL OUTER JOIN {net} n ON b.{key} = n.{key})"


STUDENT_COLS = ["id", "name", "grade", "student_phone", "parent_phone", "created_at", "updated_at"]
RULE_COLS = ["id", "title", "points", "is_active", "sort_order", "created_at", "updated_at"]
THRESHOLD_COLS = ["id", "min_points", "label", "message_template", "sort_order", "created_at", "updated_at"]
NOTE_COLS = ["id", "student_id", "noted_on", "content", "created_at", "updated_at"]
PENALTY_COLS = ["id", "student_id", "rule_id", "rule_title", "points", "occurred_on", "memo", "created_at"]

STUDENT_ISSUES = sql_issues(sql_non_empty("id") + sql_non_empty("name"))

RULES_COERCED = f"""(SELECT seq, CASE WHEN COALESCE(id, '') = '' THEN {sql_gen_id('rule', 'title', 'seq')} ELSE id END AS id,
 title, points AS points_text, {sql_to_integer('points')} AS points,
 CASE WHEN is_active IS NULL THEN CAST(1 AS BIGINT) ELSE {sql_to_integer('is_active')} END AS is_active,
 CASE WHEN sort_order IS NULL THEN CAST(0 AS BIGINT) ELSE {sql_to_integer('sort_order')} END AS sort_order
 FROM rule_upserts)"""
RULES_CHECKED = f"""(SELECT *, {sql_issues(sql_non_empty('id') + sql_non_empty('title') + [
    ('points IS NULL', 'points:not_integer'), ('is_active IS NULL', 'is_active:not_integer'),
    ('sort_order IS NULL', 'sort_order:not_integer')])} AS issues FROM {RULES_COERCED} r)"""

THRESHOLDS_COERCED = f"""(SELECT seq, CASE WHEN COALESCE(id, '') = '' THEN {sql_gen_id('th', 'label', 'seq')} ELSE id END AS id,
 label, {sql_to_integer('min_points')} AS min_points, COALESCE(message_template, '') AS message_template,
 CASE WHEN sort_order IS NULL THEN CAST(0 AS BIGINT) ELSE {sql_to_integer('sort_order')} END AS sort_order
 FROM threshold_upserts)"""
THRESHOLDS_CHECKED = f"""(SELECT *, {sql_issues(sql_non_empty('id') + sql_non_empty('label') + [
    ('min_points IS NULL', 'min_points:not_integer'), ('sort_order IS NULL', 'sort_order:not_integer')])} AS issues
 FROM {THRESHOLDS_COERCED} t)"""

NOTES_CHECKED = f"""(SELECT seq, id, student_id, noted_on, content, {sql_issues(sql_non_empty('id') + sql_non_empty('student_id')
    + sql_ymd_field('noted_on') + sql_non_empty('content'))} AS issues FROM
 (SELECT seq, CASE WHEN COALESCE(id, '') = '' THEN {sql_gen_id('note', 'student_id', 'noted_on', 'seq')} ELSE id END AS id,
  student_id, noted_on, content FROM note_upserts) n)"""

PENALTIES_CHECKED = f"""(SELECT *, {sql_issues(sql_non_empty('student_id') + sql_non_empty('rule_id')
    + sql_ymd_field('occurred_on'))} AS issues FROM penalty_requests)"""

RESETS_CHECKED = f"""(SELECT *, {sql_issues(sql_non_empty('student_id') + sql_ymd_field('from')
    + sql_ymd_field('to'))} AS issues FROM reset_requests)"""

def assign_decided(batch: str = BATCH) -> str:
    """Every request of the named batch with its decision."""
    return f"""(SELECT p.seq, {sql_gen_id('pen', 'p.seq', 'p.student_id', 'p.rule_id', 'p.occurred_on', batch=batch)} AS id,
 p.student_id, p.rule_id, r.title AS rule_title, r.points, p.occurred_on, p.memo, '{AS_OF}' AS created_at,
 CASE WHEN p.issues <> '' THEN 'schema' WHEN r.id IS NULL THEN 'rule_not_found'
  WHEN s.id IS NULL THEN 'student_not_found' END AS reject_reason, p.issues
 FROM {PENALTIES_CHECKED} p LEFT JOIN rules r ON r.id = p.rule_id LEFT JOIN students s ON s.id = p.student_id)"""


ASSIGN_DECIDED = assign_decided()


# Thresholds as they stand after the event-derived threshold upserts.
THRESHOLDS_CURRENT = sql_merge("thresholds", sql_last(f"(SELECT * FROM {THRESHOLDS_CHECKED} t WHERE issues = '')"),
                               THRESHOLD_COLS, ["min_points", "label", "message_template", "sort_order"])
