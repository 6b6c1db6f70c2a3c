"""Request batches: the reference's one-row API calls, read as DataFrames.

Each kind has a fixed schema (``schemas.*_UPSERTS`` / ``*_REQUESTS``); values
arrive as text where the reference coerces them (``points``, ``min_points``,
``is_active``, ``sort_order``), so the validation operators see exactly what
a client sent. ``seq`` gives the arrival order; a file without it gets one
from ``monotonically_increasing_id`` (unique, increasing within a file split;
give ``seq`` explicitly when order across files matters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

KINDS = {
    "student_upserts": schemas.STUDENT_UPSERTS,
    "rule_upserts": schemas.RULE_UPSERTS,
    "penalty_requests": schemas.PENALTY_REQUESTS,
    "reset_requests": schemas.RESET_REQUESTS,
    "threshold_upserts": schemas.THRESHOLD_UPSERTS,
    "note_upserts": schemas.NOTE_UPSERTS,
    "sms_requests": schemas.SMS_REQUESTS,
}


def read_requests(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """Read a batch of ``kind`` requests (JSON lines, CSV with header, or Parquet)
    with its fixed schema; a missing ``seq`` is filled in."""
    schema = KINDS[kind]
    r = spark.read.schema(schema)
    if fmt == "json":
        df = r.json(path)
    elif fmt == "csv":
        df = r.option("header", True).csv(path)
    else:
        df = r.parquet(path)
    return df.withColumn("seq", F.coalesce(F.col("seq"), F.monotonically_increasing_id()))


def stream_requests(spark: SparkSession, directory: str, kind: str, fmt: str = "json",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The same batches as a file stream (new files in ``directory`` are new
    micro-batches); ``seq`` must be present in the files."""
    r = spark.readStream.schema(KINDS[kind])
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).load(directory)
