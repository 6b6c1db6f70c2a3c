"""String helpers: JavaScript-compatible trim, NULL/empty conversions, NOCASE keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters JavaScript's String.prototype.trim removes
# (ECMAScript WhiteSpace + LineTerminator): TAB LF VT FF CR, SPACE, NBSP,
# OGHAM SPACE MARK, U+2000..U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, BOM.
JS_WHITESPACE_CLASS = (
    r"[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
JS_TRIM_PATTERN = rf"\A{JS_WHITESPACE_CLASS}+|{JS_WHITESPACE_CLASS}+\z"

# Fixed value: SQLite NOCASE folds ASCII A-Z only.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Strip Unicode white space at both ends (Spark ``trim`` strips U+0020 only)."""
    return F.regexp_replace(_c(c), JS_TRIM_PATTERN, "")


def null_to_empty(c) -> Column:
    """``String(x ?? "")`` - NULL becomes the empty string, anything else text."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def empty_to_null(c) -> Column:
    """``x || null`` on strings - the empty string becomes NULL."""
    return F.nullif(_c(c), F.lit(""))


def nullish_default(c, default) -> Column:
    """I4: ``x ?? default``."""
    return F.coalesce(_c(c), default if isinstance(default, Column) else F.lit(default))


def nocase(c) -> Column:
    """Sort key equal to SQLite ``COLLATE NOCASE`` (ASCII letters folded only)."""
    return F.translate(_c(c), ASCII_UPPER, ASCII_LOWER)
