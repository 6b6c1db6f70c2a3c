"""Range totals and range coverage of a ledger by day, without pairs of days and requests.

Both start from the ledger summed by (student, day), so that a student with a
third of the ledger is one row a day.

* ``totals_at``: running totals by day, looked up at the bounds of the
  requests. Bounds are made distinct first; days and bounds of a student are
  then sorted together once, so a student with n days and m bounds costs
  (n + m) log (n + m). The total of a range is the difference at its ends.
* ``first_covering``: which request covers each day first. A student's days
  are numbered; a range of days is cut into aligned blocks of 1, 2, 4, ...
  days (at most two of each size), the least request of each block is kept,
  and each day looks at the one block of each size that holds it. That is
  (days + requests) log days rows, and no step sees days times requests.

Dates are text and compare as text. ``from > to`` is an empty range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_day(penalties: DataFrame) -> DataFrame:
    """``points`` and ``rows`` of each student and day."""
    return penalties.groupBy("student_id", "occurred_on").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("rows"))


def _bounds(requests: DataFrame, student: str, low: str, high: str) -> DataFrame:
    """The distinct bounds of non-empty ranges: (student_id, occurred_on, side), side 0 before and 2 after the day's own rows."""
    ok = requests.where(F.col(low) <= F.col(high))
    one = lambda c, side: ok.select(F.col(student).alias("student_id"), F.col(c).alias("occurred_on"), F.lit(side).alias("side"))
    return one(low, 0).unionByName(one(high, 2)).distinct()


def totals_at(daily: DataFrame, requests: DataFrame, values: list[str], student: str = "student_id", low: str = "_lo", high: str = "_hi") -> DataFrame:
    """``requests`` with, for each of ``values`` (columns of ``daily``, one row a student and day), ``<value>_below``
    (its total on days before ``low``) and ``<value>_to`` (on days up to ``high``); NULL for an empty range."""
    bounds = _bounds(requests, student, low, high)
    for v in values:
        bounds = bounds.withColumn(v, F.lit(0).cast("bigint"))
    days = daily.select("student_id", "occurred_on", F.lit(1).alias("side"), *(F.col(v).cast("bigint").alias(v) for v in values))
    w = Window.partitionBy("student_id").orderBy("occurred_on", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = days.unionByName(bounds.select(*days.columns))
    seen = seen.select("student_id", "occurred_on", "side", *(F.sum(v).over(w).alias(v) for v in values)).where("side <> 1")
    # one row a student and bound, whatever the number of requests that share it
    at = lambda side, name: seen.where(F.col("side") == side).select(
        F.col("student_id").alias(f"_s{side}"), F.col("occurred_on").alias(f"_d{side}"), *(F.col(v).alias(f"{v}_{name}") for v in values))
    filled = F.col(low) <= F.col(high)
    out = requests.join(at(0, "below"), filled & (F.col(student) == F.col("_s0")) & (F.col(low) == F.col("_d0")), "left")
    out = out.join(at(2, "to"), filled & (F.col(student) == F.col("_s2")) & (F.col(high) == F.col("_d2")), "left")
    return out.drop("_s0", "_d0", "_s2", "_d2")


def first_covering(daily: DataFrame, requests: DataFrame, seq: str = "_rseq", student: str = "_rsid", low: str = "_lo", high: str = "_hi") -> DataFrame:
    """The rows of ``daily`` (one a student and day) whose day some request covers, with the least ``seq`` of those."""
    w = Window.partitionBy("student_id")
    days = daily.withColumn("_at", F.row_number().over(w.orderBy("occurred_on")) - 1).withColumn("_days", F.count(F.lit(1)).over(w))
    ranged = totals_at(daily.withColumn("one", F.lit(1)), requests.select(seq, student, low, high), ["one"], student, low, high)
    # days [a, b) of the student, by their numbers
    ranged = ranged.select(F.col(student).alias("student_id"), F.col(seq), F.col("one_below").alias("a"), F.col("one_to").alias("b")).where("a < b")
    sized = ranged.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("b").cast("double"))).cast("int"))))
    sized = sized.selectExpr("student_id", f"`{seq}`", "level", "shiftright(a + shiftleft(1L, level) - 1, level) AS a", "shiftright(b, level) AS b").where("a < b")
    odd = lambda c: F.when(F.col(c) % 2 == 1, F.col("a") if c == "a" else F.col("b") - 1)
    blocks = sized.withColumn("block", F.explode(F.array_compact(F.array(odd("a"), odd("b")))))
    least = blocks.groupBy("student_id", "level", "block").agg(F.min(seq).alias(seq))
    held = days.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_days").cast("double"))).cast("int"))))
    held = held.withColumn("block", F.expr("shiftright(CAST(_at AS BIGINT), level)"))
    found = held.join(least, ["student_id", "level", "block"])
    first = [F.first(c).alias(c) for c in daily.columns if c not in ("student_id", "occurred_on")]
    return found.groupBy("student_id", "occurred_on").agg(*first, F.min(seq).alias(seq))
