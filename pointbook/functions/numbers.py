"""Number coercion with JavaScript ``Number(x)`` + integer check semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .text import _c, js_trim

# Decimal literal accepted by JavaScript Number() (hex/octal/binary literals
# and Infinity are not accepted here: Infinity is never an integer, and the
# radix forms are a documented deviation).
DECIMAL_LITERAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
# Largest integer a double represents exactly (2^53 - 1).
MAX_SAFE_INTEGER = 9007199254740991


def to_integer(c, dtype=None) -> Column:
    """Coerce text to BIGINT like ``Number(x)`` followed by an integer check.

    ``''`` and all-blank -> 0; surrounding white space ignored; ``1e2`` -> 100;
    ``2.0`` -> 2; ``2.5``, ``abc``, ``1d``, ``NaN``, ``Infinity``, NULL -> NULL
    (= reject). Numeric input columns are checked for integrality only.
    """
    col = _c(c)
    if dtype is not None and isinstance(dtype, NumericType):
        d = col.cast("double")
        ok = d.isNotNull() & (d == F.floor(d)) & (F.abs(d) <= F.lit(MAX_SAFE_INTEGER))
        return F.when(ok, d.cast("bigint"))
    t = js_trim(col.cast(StringType()))
    num = t.try_cast("double")
    ok = t.rlike(DECIMAL_LITERAL) & (num == F.floor(num)) & (F.abs(num) <= F.lit(MAX_SAFE_INTEGER))
    return (F.when(col.isNull(), F.lit(None).cast("bigint"))
            .when(t == "", F.lit(0).cast("bigint"))
            .when(ok, num.cast("bigint")))
