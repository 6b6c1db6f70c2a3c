"""Expression tests on hand-written edge rows (I1, I5-I9, NOCASE)."""

from pyspark.sql import functions as F

from pointbook.functions import (badge_label, default_message, gen_id, is_ymd, js_trim, message_variables,
                                 nocase, normalize_phone, render_template, to_integer)


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_js_trim_unicode_whitespace(spark):
    vals = ["\t 　﻿김 수　\n", "   ", " x ", "a b", None]
    assert one_col(spark, vals, js_trim) == ["김 수", "", "x", "a b", None]


def test_normalize_phone(spark):
    vals = [None, "", "---", "010-1234-5678", "1012345678", "+82 10-1234", "０１0"]
    assert one_col(spark, vals, normalize_phone) == [None, None, None, "01012345678", "01012345678",
                                                     "082101234", "0"]


def test_is_ymd(spark):
    vals = ["2024-01-01", "2024-99-99", "2024-1-1", "2024-01-01\n", "2024-01-01T00", "٢٠٢٤-٠١-٠١", None]
    assert one_col(spark, vals, is_ymd) == [True, True, False, False, False, False, False]


def test_to_integer(spark):
    vals = ["", " 4 ", "1e2", "2.0", "5.", "-1", "2.5", ".5", "abc", "1d", "NaN", "Infinity", "1e400", None,
            " 7　", "9007199254740993", "-0"]
    assert one_col(spark, vals, to_integer) == [0, 4, 100, 2, 5, -1, None, None, None, None, None, None, None,
                                                None, 7, None, 0]


def test_render_template_single_pass(spark):
    df = spark.createDataFrame(
        [(1, "[X] {name} p={points} {nope}{label}!", "{points}김", 7, "L$1"),
         (2, "{name}", "a{b}", 1, ""),
         (3, "no braces", "x", 1, ""),
         (4, "{name}{name}", "ab", 1, ""),
         (5, "", "x", 1, "")],
        "i int, tpl string, name string, points bigint, label string")
    out = df.orderBy("i").select(render_template("tpl", message_variables("name", "points", F.lit(None), "label")))
    assert [r[0] for r in out.collect()] == ["[X] {points}김 p=7 L$1!", "a{b}", "no braces", "abab", ""]


def test_default_message_fallback(spark):
    df = spark.createDataFrame(
        [(1, None, "kim", 3, None, None), (2, "", "lee", 90, 85, "L85"), (3, "{label}:{threshold} {name}", "park", 70, 70, "L70")],
        "i int, tpl string, name string, points bigint, mp bigint, label string")
    out = [r[0] for r in df.orderBy("i").select(default_message("tpl", "name", "points", "mp", "label")).collect()]
    assert out == ["[센터] kim 학생 벌점 누적 3점입니다.", "[센터] lee 학생 벌점 누적 90점입니다.", "L70:70 park"]


def test_badge_label(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "t", "", 5), (3, "t", "Warn", 5)],
                               "i int, tid string, label string, mp bigint")
    out = [r[0] for r in df.orderBy("i").select(badge_label("tid", "label", "mp")).collect()]
    assert out == ["정상", ">=5", "Warn"]


def test_nocase_order_ascii_only(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "A"), ("3", "a"), ("4", "B"), ("5", "À"), ("6", "à")], "id string, name string")
    got = [r.id for r in df.orderBy(nocase("name"), "id").collect()]
    assert got == ["2", "3", "1", "4", "5", "6"]


def test_gen_id_deterministic(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "s bigint, k string")
    ids = [r[0] for r in df.select(gen_id("pen", "s", "k")).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert all(i.startswith("pen_") and len(i) == 36 for i in ids)


def test_gen_id_parts_are_unambiguous(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("", "a"), (None, None), ("", "")], "x string, y string")
    assert df.select(gen_id("n", "x", "y").alias("id")).distinct().count() == 7
