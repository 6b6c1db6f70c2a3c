"""Stand-in inputs: the driver's test tables shaped into the ledger schemas.

These functions only give rows in the schemas the operators expect (the
``students`` roster from ``customer``, the ledger from ``events``, notes from
``conversations``, and request batches derived from the same rows). They do
none of the operators' work; every operator runs on them through its own code
and would run unchanged on real tables of the same schemas.

Every function takes ``(spark, sf_dir)`` and is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_driver_table

EPOCH = "2024-01-01 00:00:00"


def _k():
    return F.col("c_custkey")


def _pad8(c):
    return F.lpad(c.cast("string"), 8, "0")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster: one student per customer, with every phone shape the send path meets."""
    c = read_driver_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = _k()
    return c.select(
        k.cast("string").alias("id"),
        F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name")).alias("name"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("grade"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .when(k % 3 == 0, F.concat(F.lit("10"), _pad8(k)))
         .otherwise(F.concat(F.lit("010-"), _pad8(k))).alias("student_phone"),
        F.when(k % 13 == 0, F.lit(""))
         .when(k % 5 == 0, F.concat(F.lit("010 "), _pad8(k)))
         .otherwise(F.concat(F.lit("+82 10-"), _pad8(F.col("c_nationkey")))).alias("parent_phone"),
        F.lit(EPOCH).alias("created_at"),
        F.lit(EPOCH).alias("updated_at"),
    )


def _rule_points(t):
    return (F.when(t.isin("click", "view"), 1).when(t == "signup", 2)
            .when(t == "error", 3).otherwise(-1)).cast("bigint")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules: one per event type (inactive rule, negative points, sort ties)."""
    e = read_driver_table(spark, sf_dir, "events").select("event_type").distinct()
    t = F.col("event_type")
    return e.select(
        F.concat(F.lit("rule_"), t).alias("id"),
        t.alias("title"),
        _rule_points(t).alias("points"),
        F.when(t == "purchase", 0).otherwise(1).cast("bigint").alias("is_active"),
        F.when(t.isin("click", "view"), 1).otherwise(2).cast("bigint").alias("sort_order"),
        F.lit(EPOCH).alias("created_at"),
        F.lit(EPOCH).alias("updated_at"),
    )


# Fixed test configuration: equal min_points (tie direction), an empty
# template, an unknown variable, a template that renders blank.
THRESHOLD_ROWS = [
    ("th_5", 5, "L5", "[X] {name} at {points}", 1),
    ("th_70a", 70, "L70A", "{label}: {name} {points}/{threshold}{nope}", 3),
    ("th_70b", 70, "L70B", "{label}: {name} {points}/{threshold}", 2),
    ("th_85", 85, "L85", "", 4),
    ("th_95", 95, "L95", " {nope} ", 5),
]


def thresholds(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Thresholds: a configuration table of five rows (the domain's own size),
    as an inline table (a local relation whose size the plan itself proves)."""
    def q(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    rows = ", ".join(
        f"({q(i)}, CAST({m} AS BIGINT), {q(lab)}, {q(tpl)}, CAST({so} AS BIGINT), {q(EPOCH)}, {q(EPOCH)})"
        for (i, m, lab, tpl, so) in THRESHOLD_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, min_points, label, message_template, sort_order, "
                     f"created_at, updated_at)")


def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger: one row per event, rule title and points frozen on the row."""
    return penalties_from_events(read_driver_table(spark, sf_dir, "events"))


def penalties_from_events(e: DataFrame) -> DataFrame:
    """Row-wise shaping of event rows into ledger rows (works on streams too)."""
    t = F.col("event_type")
    return e.select(
        F.concat(F.lit("pen_"), F.col("event_id").cast("string")).alias("id"),
        F.col("user_id").cast("string").alias("student_id"),
        F.concat(F.lit("rule_"), t).alias("rule_id"),
        t.alias("rule_title"),
        _rule_points(t).alias("points"),
        F.date_format("ts", "yyyy-MM-dd").alias("occurred_on"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("props")).alias("memo"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def penalty_requests_from_events(e: DataFrame) -> DataFrame:
    """Row-wise shaping of event rows into penalty requests (works on streams too)."""
    i = F.col("event_id")
    return e.select(
        i.alias("seq"),
        F.when(i % 97 == 0, F.lit("ghost")).when(i % 101 == 0, F.lit(""))
         .otherwise(F.col("user_id").cast("string")).alias("student_id"),
        F.when(i % 89 == 0, F.lit("rule_none")).otherwise(F.concat(F.lit("rule_"), F.col("event_type"))).alias("rule_id"),
        F.when(i % 83 == 0, F.lit("2024-1-1")).when(i % 79 == 0, F.lit("2024-99-99"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("occurred_on"),
        F.col("props").alias("memo"),
    )


def penalty_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assign requests: unknown / empty students, unknown rules, bad and odd dates."""
    return penalty_requests_from_events(read_driver_table(spark, sf_dir, "events"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes: one per conversation turn (conversation = student, turn = day)."""
    c = read_driver_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.select(
        F.concat(F.lit("note_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("student_id"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0")).alias("noted_on"),
        F.col("text").alias("content"),
        F.lit(EPOCH).alias("created_at"),
        F.lit(EPOCH).alias("updated_at"),
    )


def roster_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster file rows (English headers), one for each customer and more: blanks
    around values, duplicate ids later in the file, empty, blank and missing
    ids and names, empty cells, new ids; ``seq`` = file order."""
    c = read_driver_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = _k()
    a = c.select(
        k.alias("seq"), F.when(k % 71 == 0, F.lit("")).when(k % 73 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("  "), k.cast("string"))).alias("id"),
        F.when(k % 67 == 0, F.lit("")).when(k % 79 == 0, F.lit(None).cast("string")).otherwise(F.concat("c_name", F.lit(" "))).alias("name"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.lit("G2")).alias("grade"),
        F.lit(None).cast("string").alias("student_phone"), F.lit("01012345678").alias("parent_phone"))
    b = c.where(k % 30 == 0).select(
        (k + 1000000).alias("seq"), k.cast("string").alias("id"), F.concat(F.lit("dup "), F.col("c_name")).alias("name"),
        F.lit("G3").alias("grade"), F.lit("").alias("student_phone"), F.lit("").alias("parent_phone"))
    n = c.where(k % 50 == 0).select(
        (k + 2000000).alias("seq"), F.concat(F.lit("new"), k.cast("string")).alias("id"),
        F.when(k % 100 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"),
        F.lit("G1").alias("grade"), F.lit("").alias("student_phone"), F.lit("").alias("parent_phone"))
    return a.unionByName(b).unionByName(n)


def student_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student upsert requests: the roster rows as posted one by one (no trim)."""
    return roster_import(spark, sf_dir)


def _student_or_missing(k):
    """The customer's student id; of some requests it is empty or missing."""
    return F.when(k % 59 == 0, F.lit(None).cast("string")).when(k % 61 == 0, F.lit("")).otherwise(k.cast("string"))


def range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History requests, one per student: NULL / empty / set bounds, some reversed."""
    c = read_driver_table(spark, sf_dir, "customer").select("c_custkey")
    k = _k()
    day = lambda x: F.concat(F.lit("2024-01-"), F.lpad(x.cast("string"), 2, "0"))
    return c.select(
        k.alias("seq"), _student_or_missing(k).alias("student_id"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, F.lit(""))
         .otherwise(day(k % 20 + 1)).alias("from"),
        F.when(k % 4 == 0, F.lit("")).otherwise(day(k % 28 + 1)).alias("to"),
    )


def reset_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-reset requests, one per student; some bounds malformed, some reversed."""
    c = read_driver_table(spark, sf_dir, "customer").select("c_custkey")
    k = _k()
    day = lambda x: F.concat(F.lit("2024-01-"), F.lpad(x.cast("string"), 2, "0"))
    return c.select(
        k.alias("seq"), _student_or_missing(k).alias("student_id"),
        F.when(k % 17 == 0, F.lit("2024-1-5")).otherwise(day(k % 20 + 1)).alias("from"),
        day(k % 28 + 1).alias("to"),
    )


def rule_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule upserts with numbers as text: blanks, exponents, fractions, empty,
    a generated id, and two updates of one rule (the later wins)."""
    e = read_driver_table(spark, sf_dir, "events").select("event_type").distinct()
    t = F.col("event_type")
    a = e.select(
        F.lit(1).cast("bigint").alias("seq"), F.concat(F.lit("rule_"), t).alias("id"),
        F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 100)).alias("title"),
        F.when(t == "click", F.lit(" 2 ")).when(t == "view", F.lit("1e1")).when(t == "error", F.lit("2.5"))
         .when(t == "signup", F.lit("")).otherwise(F.lit("-3")).alias("points"),
        F.when(t == "view", F.lit("0")).otherwise(F.lit(None).cast("string")).alias("is_active"),
        F.when(t == "error", F.lit("x")).otherwise(F.lit("5")).alias("sort_order"))
    b = e.select(
        F.lit(2).cast("bigint").alias("seq"),
        F.when(t == "click", F.lit("rule_click")).otherwise(F.lit("")).alias("id"),
        F.concat(t, F.lit("_late")).alias("title"), F.lit("3").alias("points"),
        F.lit(None).cast("string").alias("is_active"), F.lit(None).cast("string").alias("sort_order"))
    return a.unionByName(b)


def threshold_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold upserts derived from event counts: an update of an existing id,
    a generated id, an empty label, NULL and custom templates."""
    e = read_driver_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    t = F.col("event_type")
    return e.select(
        F.col("n").alias("seq"),
        F.when(t == "signup", F.lit("th_70a")).when(t == "purchase", F.lit("")).otherwise(F.concat(F.lit("th_"), t)).alias("id"),
        (F.col("n") % 97).cast("string").alias("min_points"),
        F.when(t == "error", F.lit("")).otherwise(F.upper(t)).alias("label"),
        F.when(t == "click", F.lit(None).cast("string")).when(t == "view", F.lit("{label} {name}"))
         .otherwise(F.concat(F.lit("{name} "), t)).alias("message_template"),
        F.when(t == "view", F.lit("1")).otherwise(F.lit(None).cast("string")).alias("sort_order"),
    )


def note_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note upserts, one for each conversation turn: edits of the notes of even
    turns that also try to move them to another student, and new notes with
    generated ids of odd turns; malformed dates, empty contents, missing and
    unknown students."""
    c = read_driver_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.col("turn") % 2 == 1
    conv = F.col("conv_id")
    return c.select(
        (conv * 100 + F.col("turn")).alias("seq"),
        F.when(odd, F.lit("")).otherwise(F.concat(F.lit("note_"), conv.cast("string"), F.lit("_"), F.col("turn").cast("string"))).alias("id"),
        F.when(odd & (conv % 19 == 3), F.lit("")).when(odd & (conv % 19 == 5), F.lit("ghost"))
         .when(odd, conv.cast("string")).otherwise((conv + 1).cast("string")).alias("student_id"),
        F.when(odd & (F.col("role") == "assistant") & (conv % 2 == 0), F.lit("2024-2-1")).when(odd, F.lit("2024-02-02")).otherwise(F.lit("2024-02-01")).alias("noted_on"),
        F.when(conv % 23 == 4, F.lit("")).when(odd, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" (edited)"))).alias("content"))


def sms_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send requests, one for each customer: every target and a wrong and a
    missing one; default, given, empty and blank messages; unknown, empty and
    missing students."""
    c = read_driver_table(spark, sf_dir, "customer").select("c_custkey")
    k = _k()
    return c.select(
        k.alias("seq"),
        F.when(k % 47 == 0, F.lit("ghost")).when(k % 53 == 0, F.lit("")).when(k % 107 == 0, F.lit(None).cast("string"))
         .otherwise(k.cast("string")).alias("student_id"),
        F.when(k % 41 == 0, F.lit("teacher")).when(k % 43 == 0, F.lit(None).cast("string"))
         .when(k % 5 == 1, F.lit("student")).when(k % 5 == 2, F.lit("parent")).otherwise(F.lit("both")).alias("target"),
        F.when(k % 31 == 0, F.lit("")).when(k % 37 == 0, F.lit(" \t\u3000")).when(k % 10 == 9, F.concat(F.lit("  notice "), k.cast("string"), F.lit("\n")))
         .otherwise(F.lit(None).cast("string")).alias("message"))


# -- delete key sets ---------------------------------------------------------

def student_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students to delete: those without a grade."""
    return students(spark, sf_dir).where(F.col("grade").isNull()).select("id")


def rule_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules to delete: the inactive ones."""
    return rules(spark, sf_dir).where(F.col("is_active") == 0).select("id")


def penalty_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows to delete: those whose request named an unknown rule."""
    return (penalty_requests(spark, sf_dir).where(F.col("rule_id") == "rule_none")
            .select(F.concat(F.lit("pen_"), F.col("seq").cast("string")).alias("id")))


def note_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to delete: the system turns."""
    c = read_driver_table(spark, sf_dir, "conversations").where(F.col("role") == "system")
    return c.select(F.concat(F.lit("note_"), F.col("conv_id").cast("string"), F.lit("_"),
                             F.col("turn").cast("string")).alias("id"))
