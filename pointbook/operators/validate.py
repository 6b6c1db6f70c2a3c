"""Admissibility checks (J1-J8) on request batches.

Each check returns the batch with an ``issues array<string>`` column listing
*every* failed rule of a row (``field:reason``), and, where the reference
coerces values before checking them, the coerced typed columns. Valid rows
are those with ``size(issues) = 0``; the rest go to a quarantine.

Reasons: ``required`` (NULL), ``empty`` (``''``), ``format`` (date text),
``not_integer`` (number coercion failed), ``enum`` (value outside the set),
``blank`` (only white space, client-side checks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gen_id, is_ymd, js_trim, to_integer
from ..schemas import (ID_PREFIX_NOTE, ID_PREFIX_RULE, ID_PREFIX_THRESHOLD, TARGETS)


def issues_of(*checks: tuple[Column, str]) -> Column:
    """``array<string>`` of the codes whose condition is true."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The code of the first true condition, NULL when none holds."""
    return F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in checks])


def non_empty(field: str) -> list[tuple[Column, str]]:
    """``z.string().min(1)``."""
    c = F.col(f"`{field}`")
    return [(c.isNull(), f"{field}:required"), (c == "", f"{field}:empty")]


def ymd_field(field: str) -> list[tuple[Column, str]]:
    """``z.string().regex(/^\\d{4}-\\d{2}-\\d{2}$/)``."""
    c = F.col(f"`{field}`")
    return [(c.isNull(), f"{field}:required"), (c.isNotNull() & ~is_ymd(c), f"{field}:format")]


def _with_issues(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    return df.withColumn("issues", issues_of(*checks))


def _generated_id(prefix: str, batch: str, *parts: str) -> Column:
    """The given id; a missing or empty one is generated (I11) from the batch's name and the row's parts."""
    return F.when(F.coalesce(F.col("id"), F.lit("")) == "", gen_id(prefix, F.lit(batch), *parts)).otherwise(F.col("id"))


def validate_students(df: DataFrame) -> DataFrame:
    """Id and name non-empty; grade and phones optional, nullable.
    White-space-only values pass (the server does not trim)."""
    return _with_issues(df, non_empty("id") + non_empty("name"))


def validate_rules(df: DataFrame, batch: str) -> DataFrame:
    """J2 with the reference's coercion: id generated when missing or empty,
    ``points = Number(points)`` (required), ``is_active`` default 1,
    ``sort_order`` default 0, all integers."""
    d = df.withColumn("id", _generated_id(ID_PREFIX_RULE, batch, "title", "seq"))
    pts = to_integer("points")
    act = F.when(F.col("is_active").isNull(), F.lit(1).cast("bigint")).otherwise(to_integer("is_active"))
    so = F.when(F.col("sort_order").isNull(), F.lit(0).cast("bigint")).otherwise(to_integer("sort_order"))
    d = d.select(*[c for c in d.columns if c not in ("points", "is_active", "sort_order")],
                 F.col("points").alias("points_text"), pts.alias("points"), act.alias("is_active"),
                 so.alias("sort_order"))
    return _with_issues(d, non_empty("id") + non_empty("title") + [
        (F.col("points").isNull(), "points:not_integer"),
        (F.col("is_active").isNull(), "is_active:not_integer"),
        (F.col("sort_order").isNull(), "sort_order:not_integer"),
    ])


def validate_penalties(df: DataFrame) -> DataFrame:
    """student_id and rule_id non-empty; occurred_on date text; memo optional."""
    return _with_issues(df, non_empty("student_id") + non_empty("rule_id") + ymd_field("occurred_on"))


def validate_resets(df: DataFrame) -> DataFrame:
    """student_id non-empty; from and to date text (from > to is allowed)."""
    return _with_issues(df, non_empty("student_id") + ymd_field("from") + ymd_field("to"))


def validate_thresholds(df: DataFrame, batch: str) -> DataFrame:
    """J5 with coercion: id generated when missing or empty; ``min_points``
    required integer; label non-empty; template NULL -> ``''``; ``sort_order``
    default 0. (A NULL template is treated as absent, like every NULL.)"""
    d = df.withColumn("id", _generated_id(ID_PREFIX_THRESHOLD, batch, "label", "seq"))
    mp = to_integer("min_points")
    so = F.when(F.col("sort_order").isNull(), F.lit(0).cast("bigint")).otherwise(to_integer("sort_order"))
    d = d.select(*[c for c in d.columns if c not in ("min_points", "sort_order", "message_template")],
                 mp.alias("min_points"), F.coalesce("message_template", F.lit("")).alias("message_template"),
                 so.alias("sort_order"))
    return _with_issues(d, non_empty("id") + non_empty("label") + [
        (F.col("min_points").isNull(), "min_points:not_integer"),
        (F.col("sort_order").isNull(), "sort_order:not_integer"),
    ])


def validate_notes(df: DataFrame, batch: str) -> DataFrame:
    """Id generated when missing or empty; student_id and content non-empty;
    noted_on date text."""
    d = df.withColumn("id", _generated_id(ID_PREFIX_NOTE, batch, "student_id", "noted_on", "seq"))
    return _with_issues(d, non_empty("id") + non_empty("student_id") + ymd_field("noted_on")
                        + non_empty("content"))


def validate_sms(df: DataFrame) -> DataFrame:
    """J7, the server's rules: student_id non-empty; target one of student /
    parent / both; message non-empty (white space alone passes here; a
    missing message does not). A send batch composes missing messages first
    (``messages.prepare_messages``)."""
    return _with_issues(df, non_empty("student_id") + target_field("target") + non_empty("message"))


def target_field(field: str) -> list[tuple[Column, str]]:
    """``z.enum(["student", "parent", "both"])``."""
    t = F.col(f"`{field}`")
    return [(t.isNull(), f"{field}:required"), (t.isNotNull() & ~t.isin(*TARGETS), f"{field}:enum")]


def precheck(df: DataFrame, form: str) -> DataFrame:
    """The client's stricter checks before a request is posted.

    ``form``: ``students`` (id and name non-blank after trim), ``penalties``
    (student and rule chosen), ``notes`` (student chosen, content non-blank),
    ``sms`` (student chosen, message non-blank; a missing one is composed),
    ``resets`` (student chosen, ``from <= to``). What is chosen from a list
    is only tested for being there, what is typed is trimmed first.
    """
    def blank(c):
        return F.coalesce(js_trim(F.col(f"`{c}`")), F.lit("")) == ""

    def unchosen(c):
        return F.coalesce(F.col(f"`{c}`"), F.lit("")) == ""

    checks = {
        "students": [(blank("id"), "id:blank"), (blank("name"), "name:blank")],
        "penalties": [(unchosen("student_id"), "student_id:blank"), (unchosen("rule_id"), "rule_id:blank")],
        "notes": [(unchosen("student_id"), "student_id:blank"), (blank("content"), "content:blank")],
        "sms": [(unchosen("student_id"), "student_id:blank"),
                (F.col("message").isNotNull() & blank("message"), "message:blank")],
        "resets": [(unchosen("student_id"), "student_id:blank"),
                   (F.coalesce(F.col("from") > F.col("to"), F.lit(False)), "range:reversed")],
    }[form]
    return df.withColumn("precheck", issues_of(*checks))


def missing_student(df: DataFrame) -> DataFrame:
    """B1 / B2: history and note requests without a student id, which are
    errors, with their reason (``student_id:required`` or ``:empty``)."""
    return split_valid(_with_issues(df, non_empty("student_id")))[1]


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)`` by the ``issues`` column."""
    return df.where(F.size("issues") == 0), df.where(F.size("issues") > 0)
