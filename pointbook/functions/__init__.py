"""Scalar Column expressions (all JVM-side built-ins, no Python UDF)."""

from .misc import badge_label, gen_id, is_ymd, normalize_phone, utc_now, ymd
from .numbers import to_integer
from .template import default_message, message_variables, render_template
from .text import empty_to_null, js_trim, nocase, null_to_empty, nullish_default

__all__ = [
    "badge_label", "default_message", "empty_to_null", "gen_id", "is_ymd", "js_trim",
    "message_variables", "nocase", "normalize_phone", "null_to_empty", "nullish_default",
    "render_template", "to_integer", "utc_now", "ymd",
]
