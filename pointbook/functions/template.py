"""Single-pass ``{word}`` templating with per-row templates and variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT_MESSAGE_TEMPLATE
from .text import _c, js_trim

# A placeholder is ``{`` + ASCII word characters + ``}``.
PLACEHOLDER = r"\{\w+\}"
PLACEHOLDER_KEY = r"\{(\w+)\}"


def render_template(template, variables: Column) -> Column:
    """Replace every ``{word}`` (ASCII word characters) by ``variables[word]``,
    unknown words by ``""``.

    Single pass: the template is cut into the literal pieces between
    placeholders and the list of placeholder keys, then pieces and values are
    interleaved, so a value that itself contains ``{points}`` is never
    rescanned (chained ``replace`` calls would). ``variables`` is a
    ``map<string,string>`` column, so each row may carry its own template.
    """
    t = _c(template)
    pieces = F.split(t, PLACEHOLDER, -1)
    keys = F.regexp_extract_all(t, F.lit(PLACEHOLDER_KEY), 1)
    joined = F.zip_with(
        pieces, keys,
        lambda piece, key: F.concat(
            F.coalesce(piece, F.lit("")),
            F.when(key.isNull(), F.lit("")).otherwise(
                F.coalesce(F.try_element_at(variables, key), F.lit(""))),
        ),
    )
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(joined, ""))


def message_variables(name, points, min_points, label) -> Column:
    """The four template variables: name, points (as text, NULL -> 0), and the
    threshold / label of the reached threshold (empty when none is reached)."""
    return F.create_map(
        F.lit("name"), F.coalesce(_c(name), F.lit("")),
        F.lit("points"), F.coalesce(_c(points), F.lit(0)).cast("string"),
        F.lit("threshold"), F.coalesce(_c(min_points).cast("string"), F.lit("")),
        F.lit("label"), F.coalesce(_c(label), F.lit("")),
    )


def default_message(template, name, points, min_points, label) -> Column:
    """I8: the message of a student: the reached threshold's template, or the
    default text when none is reached or its template is empty; rendered with
    I7 and trimmed (I1) as it is before sending."""
    tpl = F.coalesce(F.nullif(_c(template), F.lit("")), F.lit(DEFAULT_MESSAGE_TEMPLATE))
    return js_trim(render_template(tpl, message_variables(name, points, min_points, label)))
