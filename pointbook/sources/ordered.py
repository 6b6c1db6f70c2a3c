"""The order of rows in files, read in splits by many tasks.

Spark tells of each row its file and the start of its split, and reads a split
from front to back; so (file name, split start, place in the split) is the
order of a sequential read. Counting rows by split and adding the counts up
over the splits (a table with one row a split) numbers them all.

CSV needs one thing more: a line break inside quotes ends no record. Whether a
line begins inside quotes depends on all lines before it, yet each line only
maps two states (outside, inside) to two states, and such maps compose: a line
either leaves the state as it is, swaps it, or sets it whatever it was. The
state at a line is thus that of the last line that sets it, swapped once for
each line since that swaps. That is found inside each split first, then over
the splits, so no task reads more than its splits.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, BLOCK, AT = "_file", "_block", "_at"

# Quoted text up to its closing quote (quotes inside are doubled), and complete fields with the comma behind them.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
# Lines that end inside quotes: begun outside, or begun inside.
_OPENS = rf'\A{_FIELDS}"{_INSIDE}\z'
_STAYS = rf'\A{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?\z'


def _placed(df: DataFrame, at: Column) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in df.columns), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), at.alias(AT))


def _bases(splits: DataFrame, count: str) -> DataFrame:
    """The number of rows in all splits before each one. One row a split: the only window over all rows of a table here."""
    w = Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_base", F.coalesce(F.sum(count).over(w), F.lit(0)))


def number_rows(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` (a bare file scan) with ``seq``: its rows' numbers in file order, from 0."""
    cols = [c for c in df.columns if c != seq]
    placed = _placed(df.select(*(F.col(f"`{c}`") for c in cols)) if seq in df.columns else df, F.monotonically_increasing_id())
    splits = _bases(placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_rows")), "_rows")
    w = Window.partitionBy(FILE, BLOCK).orderBy(AT)
    out = placed.withColumn("_k", F.row_number().over(w) - 1).join(splits, [FILE, BLOCK])
    return out.select(*(F.col(f"`{c}`") for c in cols), (F.col("_base") + F.col("_k")).cast("bigint").alias(seq))


def _state(last: str, swaps: str, entering: Column | None = None) -> Column:
    """Inside (true) or outside: set by the last line that sets it and swapped since, or, without one, NULL or from ``entering``."""
    flipped = lambda v, n: F.when(n % 2 == 1, ~v).otherwise(v)
    known = flipped(F.col(f"{last}.set"), F.col(swaps) - F.col(f"{last}.swaps"))
    return F.coalesce(known, flipped(entering, F.col(swaps))) if entering is not None else known


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, record number from 0 over all files, text) of lines (file, split, place, ``line``), blank records left out."""
    opens, stays = F.col("line").rlike(_OPENS), F.col("line").rlike(_STAYS)
    marked = lines.withColumn("_opens", opens).withColumn("_stays", stays)
    marked = marked.withColumn("_swap", (F.col("_opens") & ~F.col("_stays")).cast("int"))
    within = Window.partitionBy(FILE, BLOCK).orderBy(AT)
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_swaps_to", F.sum("_swap").over(upto))
    sets = F.when(F.col("_opens") == F.col("_stays"), F.struct(F.col("_opens").alias("set"), F.col("_swaps_to").alias("swaps")))
    marked = marked.withColumn("_sets", sets)
    marked = (marked.withColumn("_last", F.last("_sets", ignorenulls=True).over(before))
              .withColumn("_swaps", F.coalesce(F.sum("_swap").over(before), F.lit(0)))
              .withColumn("_last_to", F.last("_sets", ignorenulls=True).over(upto)))

    # one row a split: how it maps the state, and how many records begin in it for either state at its beginning
    starts = lambda inside: F.sum((~_state("_last", "_swaps", F.lit(inside))).cast("int"))
    splits = marked.groupBy(FILE, BLOCK).agg(
        F.max_by(F.struct(F.col("_last_to"), F.col("_swaps_to")), F.col(AT)).alias("_end"),
        starts(False).alias("_starts_out"), starts(True).alias("_starts_in"))
    ordered = Window.partitionBy(FILE).orderBy(BLOCK)
    splits = splits.select(FILE, BLOCK, "_starts_out", "_starts_in", F.col("_end._swaps_to").alias("_n"),
                           _state("_end._last_to", "_end._swaps_to").alias("_sets_to"))
    splits = splits.withColumn("_all", F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    sets = F.when(F.col("_sets_to").isNotNull(), F.struct(F.col("_sets_to").alias("set"), F.col("_all").alias("swaps")))
    ahead = ordered.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_set", sets)
    splits = splits.withColumn("_prior", F.last("_set", ignorenulls=True).over(ahead)).withColumn("_flips", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    splits = splits.withColumn("_enters", _state("_prior", "_flips", F.lit(False)))  # a file begins outside
    splits = splits.withColumn("_starts", F.when(F.col("_enters"), F.col("_starts_in")).otherwise(F.col("_starts_out")))
    splits = _bases(splits, "_starts").select(FILE, BLOCK, "_enters", "_base")

    known = marked.join(splits, [FILE, BLOCK]).withColumn("_in", _state("_last", "_swaps", F.col("_enters")))
    known = known.withColumn("_out", F.when(F.col("_in"), F.col("_stays")).otherwise(F.col("_opens")))
    number = F.col("_base") + F.sum((~F.col("_in")).cast("int")).over(upto) - 1
    known = known.select(FILE, BLOCK, AT, "line", "_in", "_out", number.cast("bigint").alias("record"))
    whole = known.where(~F.col("_in") & ~F.col("_out")).select(FILE, "record", F.col("line").alias("text"))
    # the lines of a record that spans several, in order (also over splits)
    parts = known.where(F.col("_in") | F.col("_out")).groupBy(FILE, "record").agg(F.array_sort(F.collect_list(F.struct(BLOCK, AT, "line"))).alias("_p"))
    joined = parts.select(FILE, "record", F.array_join(F.col("_p.line"), "\n").alias("text"))
    text = F.regexp_replace("text", r"\r\z", "")
    return whole.unionByName(joined).withColumn("text", text).where(F.trim("text") != "")


def read_csv_in_order(spark: SparkSession, path: str, seq: str = "seq") -> DataFrame:
    """A CSV file with a header row, or several, as text columns and ``seq``: the records' numbers in file order (headers
    and blank records have one too, but are no rows). Files may order their columns differently; a column that one lacks is NULL there."""
    lines = _placed(spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line"), F.monotonically_increasing_id())
    records = csv_records(lines)
    heads = records.groupBy(FILE).agg(F.min_by("text", "record").alias("head"), F.min("record").alias("first"))
    out = None
    # one row a file here; one pass over the records for each different header, usually one
    for head in sorted({r.head for r in heads.select("head").distinct().collect()}):
        names = next(csv.reader(io.StringIO(head.lstrip("﻿"))), [])
        mine = heads.where(F.col("head") == head)
        kind = ", ".join(f"c{i} string" for i in range(max(1, len(names))))
        rows = records.join(mine.select(FILE, "first"), FILE).where(F.col("record") > F.col("first"))
        # the headers of this file and those before it are no rows
        parsed = rows.select(F.from_csv("text", kind, {"quote": '"', "escape": '"'}).alias("_r"), "record", FILE)
        cols = {n: F.col(f"_r.c{i}").alias(n) for i, n in reversed(list(enumerate(names))) if n and n != seq}
        part = parsed.select(*cols.values(), F.col("record").alias(seq))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], f"{seq} bigint")
