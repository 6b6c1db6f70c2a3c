"""Property tests: Spark expressions against small Python models of the
JavaScript semantics they reproduce, on generated inputs (one DataFrame per
example batch, so each example is a single Spark job)."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointbook.functions import js_trim, message_variables, normalize_phone, render_template, to_integer

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

# ECMAScript WhiteSpace + LineTerminator code points (the model's own list).
JS_WS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
         + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def py_trim(s):
    return None if s is None else s.strip(JS_WS)


def py_render(tpl, variables):
    return re.sub(r"\{(\w+)\}", lambda m: variables.get(m.group(1), ""), tpl, flags=re.ASCII)


def py_phone(p):
    if not p:
        return None
    d = re.sub(r"[^0-9]", "", p)
    if not d:
        return None
    return d if d.startswith("0") else "0" + d


def py_to_integer(s):
    """Number(s) for decimal text, then an integer check within 2^53-1."""
    if s is None:
        return None
    t = py_trim(s)
    if t == "":
        return 0
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t):
        return None
    try:
        v = float(t)
    except OverflowError:
        return None
    if math.isinf(v) or v != math.floor(v) or abs(v) > 9007199254740991:
        return None
    return int(v)


def collect(spark, values, expr_fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr_fn(F.col("v"))).collect()]


text = st.text(alphabet=st.sampled_from(list("ab_{} 1x") + list(JS_WS[:6]) + ["김", "　"]), max_size=24)


@SETTINGS
@given(st.lists(st.one_of(st.none(), text), min_size=1, max_size=150))
def test_trim_matches_js(spark, values):
    assert collect(spark, values, js_trim) == [py_trim(v) for v in values]


@SETTINGS
@given(st.lists(st.tuples(text, st.text(alphabet="ab{}_p", max_size=6), st.integers(-99, 999),
                          st.text(alphabet="L$1{}", max_size=4)), min_size=1, max_size=120))
def test_render_matches_js_single_pass(spark, cases):
    df = spark.createDataFrame([(i, t, n, p, lab) for i, (t, n, p, lab) in enumerate(cases)],
                               "i int, tpl string, name string, points bigint, label string")
    out = [r[0] for r in df.orderBy("i").select(
        render_template("tpl", message_variables("name", "points", F.lit(None), "label"))).collect()]
    want = [py_render(t, {"name": n, "points": str(p), "threshold": "", "label": lab}) for t, n, p, lab in cases]
    assert out == want


phone = st.one_of(st.none(), st.text(alphabet=list("0123456789-+ ()") + ["０", "１", "x"], max_size=16))


@SETTINGS
@given(st.lists(phone, min_size=1, max_size=150))
def test_phone_matches_js(spark, values):
    assert collect(spark, values, normalize_phone) == [py_phone(v) for v in values]


number_text = st.one_of(
    st.none(),
    st.integers(-10**17, 10**17).map(str),
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
    st.text(alphabet=list("0123456789+-.eE ") + ["　", "\t"], max_size=10),
)


@SETTINGS
@given(st.lists(number_text, min_size=1, max_size=150))
def test_to_integer_matches_js_number(spark, values):
    assert collect(spark, values, to_integer) == [py_to_integer(v) for v in values]


def test_assign_partitions_requests(spark):
    """accepted + rejected = requests, and no request is in both."""
    from pointbook.operators.mutate import accepted_penalties, assign_penalties, rejected_penalties
    from pointbook.sources import standin as si

    from conftest import SF_SMALL

    req = si.penalty_requests(spark, SF_SMALL)
    d = assign_penalties(req, si.rules(spark, SF_SMALL), si.students(spark, SF_SMALL), "2024-03-01 00:00:00", "b1")
    acc, rej = accepted_penalties(d), rejected_penalties(d)
    assert acc.count() + rej.count() == req.count()
    assert d.select("seq").distinct().count() == req.count()
