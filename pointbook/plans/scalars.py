"""Named queries: scalar functions (I1-I5, I9-I12) applied over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (empty_to_null, gen_id, is_ymd, js_trim, nocase, null_to_empty, nullish_default,
                         to_integer, utc_now, ymd)
from ..sources import standin as si
from ..sources.tables import read_driver_table
from . import oracles as o
from .registry import query


@query("js_trim", f"""
SELECT seq, {o.js_trim('id')} AS id_trimmed, {o.js_trim('name')} AS name_trimmed, {o.js_trim('content')} AS content_trimmed
FROM (SELECT seq, id, name, CAST(NULL AS VARCHAR) AS content FROM roster_import
 UNION ALL SELECT seq, id, CAST(NULL AS VARCHAR), content FROM note_upserts) u""")
def q_js_trim(spark, sf):
    """JavaScript trim over roster ids/names and whole note texts."""
    r = si.roster_import(spark, sf).select("seq", "id", "name", F.lit(None).cast("string").alias("content"))
    n = si.note_upserts(spark, sf).select("seq", "id", F.lit(None).cast("string").alias("name"), "content")
    u = r.unionByName(n)
    return u.select("seq", js_trim("id").alias("id_trimmed"), js_trim("name").alias("name_trimmed"),
                    js_trim("content").alias("content_trimmed"))


@query("null_to_empty", """
SELECT seq, COALESCE(student_phone, '') AS student_phone, COALESCE(grade, '') AS grade FROM roster_import""")
def q_null_to_empty(spark, sf):
    """``String(x ?? "")`` over roster cells."""
    r = si.roster_import(spark, sf)
    return r.select("seq", null_to_empty("student_phone").alias("student_phone"), null_to_empty("grade").alias("grade"))


@query("empty_to_null", """
SELECT seq, NULLIF(grade, '') AS grade, NULLIF(parent_phone, '') AS parent_phone FROM roster_import""")
def q_empty_to_null(spark, sf):
    """``x || null`` over roster cells."""
    r = si.roster_import(spark, sf)
    return r.select("seq", empty_to_null("grade").alias("grade"), empty_to_null("parent_phone").alias("parent_phone"))


@query("nullish_default", """
SELECT seq, id, COALESCE(is_active, '1') AS is_active, COALESCE(sort_order, '0') AS sort_order,
 COALESCE(memo, '') AS memo FROM (SELECT seq, id, is_active, sort_order, CAST(NULL AS VARCHAR) AS memo FROM rule_upserts) r""")
def q_nullish_default(spark, sf):
    """I4: ``x ?? default`` over optional request fields."""
    r = si.rule_upserts(spark, sf).withColumn("memo", F.lit(None).cast("string"))
    return r.select("seq", "id", nullish_default("is_active", "1").alias("is_active"),
                    nullish_default("sort_order", "0").alias("sort_order"), nullish_default("memo", "").alias("memo"))


@query("to_integer", f"""
SELECT seq, id, points AS points_text, {o.sql_to_integer('points')} AS points FROM rule_upserts
UNION ALL SELECT seq, id, min_points, {o.sql_to_integer('min_points')} FROM threshold_upserts
UNION ALL SELECT seq, student_id, memo, {o.sql_to_integer('memo')} FROM penalty_requests""")
def q_to_integer(spark, sf):
    """``Number(x)`` + integer check over request fields and whole memo texts."""
    a = si.rule_upserts(spark, sf).select("seq", "id", F.col("points").alias("points_text"))
    b = si.threshold_upserts(spark, sf).select("seq", "id", F.col("min_points").alias("points_text"))
    c = si.penalty_requests(spark, sf).select("seq", F.col("student_id").alias("id"), F.col("memo").alias("points_text"))
    u = a.unionByName(b).unionByName(c)
    return u.select("seq", "id", "points_text", to_integer("points_text").alias("points"))


@query("is_ymd", f"SELECT seq, occurred_on, {o.sql_ymd('occurred_on')} AS ok FROM penalty_requests")
def q_is_ymd(spark, sf):
    """Date-text pattern over assign requests."""
    r = si.penalty_requests(spark, sf)
    return r.select("seq", "occurred_on", is_ymd("occurred_on").alias("ok"))


@query("ymd", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def q_ymd(spark, sf):
    """Event timestamps as ``yyyy-MM-dd`` text."""
    e = read_driver_table(spark, sf, "events").select("event_id", "ts")
    return e.select("event_id", ymd("ts").alias("day"))


@query("gen_id", f"""
SELECT seq, {o.sql_gen_id('pen', 'seq', 'student_id', 'rule_id', 'occurred_on')} AS id FROM penalty_requests""")
def q_gen_id(spark, sf):
    """Deterministic ledger ids of assign requests."""
    r = si.penalty_requests(spark, sf)
    return r.select("seq", gen_id("pen", F.lit(o.BATCH), "seq", "student_id", "rule_id", "occurred_on").alias("id"))


@query("utc_now", f"SELECT id, '{o.AS_OF}' AS updated_at FROM students")
def q_utc_now(spark, sf):
    """The write timestamp as an explicit ``as_of`` parameter."""
    return si.students(spark, sf).select("id", utc_now(o.AS_OF).alias("updated_at"))


@query("nocase", """
SELECT id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name_key FROM students""")
def q_nocase(spark, sf):
    """NOCASE sort key (ASCII folding only) over the roster."""
    return si.students(spark, sf).select("id", nocase("name").alias("name_key"))
