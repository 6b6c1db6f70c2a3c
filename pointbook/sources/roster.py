"""Roster files (A2): a header row with the sheet's column titles, all text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..functions import js_trim, null_to_empty
from ..schemas import ROSTER_HEADERS
from .ordered import number_rows, read_csv_in_order

ROSTER_COLUMNS = ["id", "name", "grade", "student_phone", "parent_phone"]


def read_roster_file(spark: SparkSession, path: str, fmt: str = "csv", seq_col: str | None = None) -> DataFrame:
    """Read a roster export (CSV with a header row, JSON lines, or Parquet), one file or several.

    Every column is read as text (no inference). Row order decides "last
    duplicate wins": it is ``seq_col`` if the file has one, else the order of
    the rows in the file, files by name (``sources.ordered``). Files are read in
    splits either way, also CSV with line breaks inside quotes; quotes are
    doubled inside quoted fields, as sheets export them. ``seq`` rises in that
    order.
    """
    if seq_col is None:
        if fmt == "csv":
            return read_csv_in_order(spark, path)
        if fmt == "json":
            return number_rows(spark.read.option("primitivesAsString", True).json(path))
        return number_rows(spark.read.parquet(path))
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("escape", '"').csv(path)
    elif fmt == "json":
        df = spark.read.option("primitivesAsString", True).json(path)
    else:
        df = spark.read.parquet(path)
    # a numeric order, also when the file carries it as text (JSON read as strings)
    return df.withColumnRenamed(seq_col, "seq").withColumn("seq", F.col("seq").cast("long"))


def _js_string(df: DataFrame, name: str):
    """``String(x)`` of a cell: integral numbers print without a fraction
    (``123``, not Spark's ``123.0``); text stays as it is."""
    c = F.col(f"`{name}`")
    t = df.schema[name].dataType
    if isinstance(t, (DoubleType, FloatType, DecimalType)):
        d = c.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < F.lit(1e15)), d.cast("bigint").cast("string")).otherwise(
            c.cast("string"))
    return c


def normalize_roster(df: DataFrame) -> DataFrame:
    """A2: map the sheet headers (or the English names) to columns; a missing
    column or cell becomes ``""``; every value is stringified and trimmed
    with JavaScript's trim (I2 then I1)."""
    names = set(df.columns)
    out = [F.col("seq")] if "seq" in names else []
    for header, col in ROSTER_HEADERS.items():
        src = header if header in names else (col if col in names else None)
        v = _js_string(df, src) if src is not None else F.lit("")
        out.append(js_trim(null_to_empty(v)).alias(col))
    return df.select(*out)


def roster_required_fields(df: DataFrame) -> DataFrame:
    """Keep rows whose trimmed id and name are non-empty."""
    return df.where((F.col("id") != "") & (F.col("name") != ""))
