"""Ledger queries: filters, lookups, joins and aggregates over the five tables.

Scale notes
-----------
* The ledger (``penalties``) is the only table that grows without bound.
  Totals aggregate it *before* it meets the roster: the partial aggregate
  collapses each task's rows to one per student (so a student holding a
  third of the ledger costs one row per task in the shuffle), and the
  roster join then sees one row per student on both sides.
* Joins between unbounded tables carry no static broadcast hint: adaptive
  execution measures the materialised sides and broadcasts only a side that
  is proven small, else keeps the sort-merge join (with skew splitting).
  Explicit broadcasts (``operators.guards``) follow a bounded row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RANGE_MAX, RANGE_MIN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- filters / lookups (B*) ---------------------------------------------------

def range_bounds(from_col, to_col) -> tuple[Column, Column]:
    """Missing or empty bounds mean unbounded (JavaScript ``||`` defaults)."""
    lo = F.coalesce(F.nullif(_c(from_col), F.lit("")), F.lit(RANGE_MIN))
    hi = F.coalesce(F.nullif(_c(to_col), F.lit("")), F.lit(RANGE_MAX))
    return lo, hi


def penalties_in_range(penalties: DataFrame, requests: DataFrame, split_hot: bool = True,
                       **hot_kw) -> DataFrame:
    """B1 (set form): ledger rows of each request's student with ``occurred_on``
    inside the request's inclusive text range.

    ``requests``: ``(seq, student_id, from, to)``. Dates compare as text (the
    reference compares strings); ``from > to`` selects nothing. The join is an
    equi-join on ``student_id`` with the range as a residual condition: a
    small request batch is broadcast (no shuffle of the ledger); a large one
    is shuffled with hot students joined map-side (``operators.skew``).
    """
    from .skew import join_ledger_with_requests

    lo, hi = range_bounds("from", "to")
    r = requests.select(F.col("seq").alias("request_seq"), F.col("student_id").alias("_rsid"),
                        lo.alias("_lo"), hi.alias("_hi"))
    j = join_ledger_with_requests(penalties, r, "student_id", "_rsid", "inner",
                                  extra=F.col("occurred_on").between(F.col("_lo"), F.col("_hi")),
                                  split_hot=split_hot, **hot_kw)
    return j.drop("_rsid", "_lo", "_hi")


def month_of(day) -> Column:
    """Ledger partition key: the ``yyyy-MM`` prefix of the date text (kept as
    text, like the date itself, so odd-but-legal dates keep their rows)."""
    return F.substring(_c(day), 1, 7)


def penalties_for_student(penalties: DataFrame, student_id: str | None, date_from: str | None = None,
                          date_to: str | None = None, month_col: str | None = None) -> DataFrame:
    """B1 (single request, the reference's own form): one student's ledger rows
    in the inclusive text range; a missing or empty bound is unbounded, a
    missing or empty student id is an error.

    All predicates are literals, so they reach the Parquet scan as pushed
    filters; with a ledger written partitioned by ``month_col`` (see
    ``write_ledger_snapshot``) the derived month bounds also prune whole
    partitions (Catalyst cannot derive them from a string range itself).
    """
    require_student_id(student_id)
    lo = date_from or RANGE_MIN
    hi = date_to or RANGE_MAX
    cond = (F.col("student_id") == F.lit(student_id)) & F.col("occurred_on").between(F.lit(lo), F.lit(hi))
    if month_col:
        cond = cond & F.col(month_col).between(F.lit(lo[:7]), F.lit(hi[:7]))
    return penalties.where(cond)


def ledger_total(penalties: DataFrame, requests: DataFrame) -> DataFrame:
    """Total points of the rows B1 lists, per request; no rows -> 0.

    The ledger is summed per (student, day), and a request's total is the
    difference of the running totals at its bounds (``operators.ranges``):
    linear in days and requests, also for a student with many of both. A
    small batch only aggregates the students it names."""
    from .guards import restrict_to_keys
    from .ranges import by_day, totals_at

    lo, hi = range_bounds("from", "to")
    r = requests.select(F.col("seq").alias("request_seq"), "student_id", lo.alias("_lo"), hi.alias("_hi"))
    (penalties,) = restrict_to_keys([(penalties, "student_id")], requests, "student_id")
    t = totals_at(by_day(penalties), r, ["points"])
    return t.select("request_seq", "student_id",
                    F.coalesce(F.col("points_to") - F.col("points_below"), F.lit(0)).cast("bigint").alias("total"))


def require_student_id(student_id: str | None) -> str:
    """A history or note list is asked for one student; without an id it is an error."""
    if not student_id:
        raise ValueError("student_id is required")
    return student_id


def notes_for_student(notes: DataFrame, student_id: str | None) -> DataFrame:
    """B2 (single request): one student's notes; a missing student id is an error."""
    return notes.where(F.col("student_id") == require_student_id(student_id))


def notes_for_students(notes: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """B2 (set form): notes of the students in ``keys``."""
    return notes.join(keys.select(F.col(key).alias("student_id")).distinct(), "student_id", "left_semi")


def lookup_by_keys(df: DataFrame, keys: DataFrame, key: str = "id", keys_col: str | None = None) -> DataFrame:
    """B3 (set form): rows of ``df`` whose ``key`` is in ``keys``. A small batch of
    keys is broadcast; a larger one is made distinct first, so that a key
    repeated in a third of it is one row a task in the shuffle."""
    from .guards import small_enough

    k = keys.select(F.col(keys_col or key).alias(key))
    small = small_enough(k)
    k = k.distinct()
    return df.join(F.broadcast(k) if small else k, key, "left_semi").select(*df.columns)


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules with a truthy (non-zero) ``is_active``."""
    return rules.where(F.col("is_active") != 0)


# Client views (B8): the columns the client keeps of each table.
VIEW_COLUMNS = {
    "students": ["id", "name", "grade", "student_phone", "parent_phone"],
    "rules": ["id", "title", "points", "is_active", "sort_order"],
    "thresholds": ["id", "min_points", "label", "message_template", "sort_order"],
    "notes": ["id", "student_id", "noted_on", "content"],
    "penalties": ["id", "student_id", "rule_id", "rule_title", "points", "occurred_on", "memo", "created_at"],
}


def client_view(df: DataFrame, table: str) -> DataFrame:
    """Projection of a table to the fields the client uses."""
    return df.select(*VIEW_COLUMNS[table])


# -- joins (D1, D3, D7, D8) ---------------------------------------------------

def students_left_join_penalties(students: DataFrame, penalties: DataFrame, split_hot: bool = True,
                                 **hot_kw) -> DataFrame:
    """Every student with each of their ledger rows (students without rows
    appear once with NULL ledger columns).

    Written as ``ledger JOIN students`` plus ``students without ledger rows``
    rather than ``students LEFT JOIN ledger``: in a left outer join only the
    left side of a skewed key can be split at run time, and here the skew
    (one student with a third of the ledger) is on the ledger side. With
    ``split_hot`` the rows of hot students (``operators.skew.hot_keys``,
    ``hot_kw`` passed on) are joined map-side and never shuffled."""
    from .skew import hot_keys, join_splitting_hot_keys

    p = penalties.select(
        F.col("student_id").alias("_psid"), F.col("id").alias("penalty_id"), "rule_id", "rule_title",
        "points", "occurred_on", "memo", F.col("created_at").alias("penalty_created_at"))
    s = students.withColumnRenamed("id", "student_id")
    hot = hot_keys(p, "_psid", **hot_kw) if split_hot else None
    with_rows = join_splitting_hot_keys(p, s, "_psid", "student_id", hot).drop("_psid")
    has_rows = penalties.select(F.col("student_id").alias("_psid")).distinct()
    without = s.join(has_rows, F.col("student_id") == F.col("_psid"), "left_anti")
    for c in p.columns:
        if c != "_psid":
            without = without.withColumn(c, F.lit(None).cast(p.schema[c].dataType))
    return with_rows.unionByName(without)


def with_student_found(df: DataFrame, students: DataFrame, col: str = "student_id", flag: str = "student_exists") -> DataFrame:
    """D3: ``df`` with a flag that tells whether its student exists: one join,
    with ``df`` on the side of which AQE splits a hot student."""
    keys = students.select(F.col("id").alias("_sid"), F.lit(True).alias("_found"))
    return df.join(keys, F.col(col) == F.col("_sid"), "left").select(*df.columns, F.coalesce("_found", F.lit(False)).alias(flag))


def student_fk_check(df: DataFrame, students: DataFrame, col: str = "student_id") -> tuple[DataFrame, DataFrame]:
    """D3: ``(kept, rejected)`` - rows whose student exists, and the rest; both
    of the one flagged join (``with_student_found`` serves both at once)."""
    flagged = with_student_found(df, students, col, "_exists")
    return flagged.where("_exists").drop("_exists"), flagged.where("NOT _exists").drop("_exists")


def cascade_delete(children: DataFrame, deleted_parent_ids: DataFrame, col: str = "student_id") -> DataFrame:
    """Drop the child rows of deleted parents."""
    return children.join(deleted_parent_ids.select(F.col("id").alias(col)), col, "left_anti")


# -- aggregates (E*) ----------------------------------------------------------

def cumulative_points(students: DataFrame, penalties: DataFrame) -> DataFrame:
    """Every student with ``points`` = sum of their ledger points, 0 without rows.

    Pre-aggregates the ledger (partial + final aggregate on ``student_id``)
    and left-joins the per-student sums, which Catalyst does not do by
    itself for a join-then-group query.
    """
    return with_points(students, penalties.groupBy("student_id").agg(F.sum("points").alias("points")))


def with_points(students: DataFrame, totals: DataFrame) -> DataFrame:
    """Every student with their ``points`` of ``totals`` (one row a student at most), 0 without."""
    t = totals.select(F.col("student_id").alias("_sid"), F.col("points").alias("_sum"))
    j = students.join(t, F.col("id") == F.col("_sid"), "left")
    return j.select(*students.columns, F.coalesce(F.col("_sum"), F.lit(0)).cast("bigint").alias("points"))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """``COUNT(*)`` as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(name))
