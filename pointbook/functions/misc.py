"""Phones, dates, ids and badge labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BADGE_NORMAL
from .text import _c

# Fixed value: the admissible date text (digits only, no calendar check).
YMD_PATTERN = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def normalize_phone(c) -> Column:
    """Keep ASCII digits; none left (or NULL/empty input) -> NULL; prefix ``0``
    unless the digits already start with ``0``."""
    d = F.regexp_replace(_c(c), r"[^0-9]", "")
    return (F.when(d.isNull() | (d == ""), F.lit(None).cast("string"))
            .when(d.startswith("0"), d)
            .otherwise(F.concat(F.lit("0"), d)))


def is_ymd(c) -> Column:
    """``^\\d{4}-\\d{2}-\\d{2}$`` on ASCII digits, no calendar check, no
    trailing newline (``\\z`` rather than Java's ``$``). NULL -> false."""
    return F.coalesce(_c(c).rlike(YMD_PATTERN), F.lit(False))


def ymd(c) -> Column:
    """A DATE / TIMESTAMP as ``yyyy-MM-dd`` text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def utc_now(as_of: str) -> Column:
    """The ``datetime('now')`` text, taken from an explicit ``as_of``
    parameter (``yyyy-MM-dd HH:mm:ss`` UTC) so replays are reproducible."""
    return F.lit(as_of)


def gen_id(prefix: str, *parts) -> Column:
    """Deterministic key ``prefix_<32 hex>`` (128 bits) from its parts.

    Each part is written as ``<length>:<text>`` and a NULL as ``n``, so
    different parts never give the same text; its SHA-256 is cut to 128 bits.
    A retried task or a replayed micro-batch makes the same ids. Callers put
    the batch's name first: ``seq`` restarts in every batch.
    """
    texts = [_c(p).cast("string") for p in parts]
    keyed = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(*keyed), 256), 1, 32))


def badge_label(hit_id, label, min_points) -> Column:
    """Threshold label, or ``>=min`` when the label is empty, or the
    normal badge when no threshold is reached."""
    return (F.when(_c(hit_id).isNull(), F.lit(BADGE_NORMAL))
            .when(F.coalesce(_c(label), F.lit("")) == "",
                  F.concat(F.lit(">="), _c(min_points).cast("string")))
            .otherwise(_c(label)))
