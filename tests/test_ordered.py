"""File order from many splits: CSV with quoted line breaks, several files, other formats; against a sequential read."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pointbook.operators import mutate
from pointbook.schemas import STUDENTS
from pointbook.sources.ordered import _OPENS, _STAYS, number_rows, read_csv_in_order
from pointbook.sources.roster import normalize_roster, read_roster_file


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "200"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rng):
    return rng.choice(["", "plain", 'say "hi"', "two\nlines", "a,b", '"', '""\n"', "x" * rng.randint(1, 200), "\n\n", 'end"\n', "한글 이름", "5' tall", ",\n,", '",\n"'])


def sheet(rows, end="\r\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_many_splits_equals_sequential_read(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    rows = [[f"id{i % 40}", cell(rng), cell(rng), "z"] for i in range(150)]
    (tmp_path / "r.csv").write_text(sheet([["ID", "이름", "학년", "학생전화"], *rows], end), newline="")
    df = read_roster_file(spark, str(tmp_path / "r.csv"))
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "r.csv"))
    assert lines.rdd.getNumPartitions() > 20
    got = [[r["ID"], r["이름"] or "", r["학년"] or "", r["학생전화"]] for r in df.orderBy("seq").collect()]
    assert got == list(csv.reader(io.StringIO(sheet(rows, end), newline="")))


def test_two_files_and_headers(spark, tmp_path, small_splits):
    a = [[f"{i}", "line\nbreak" if i % 3 else "n", f"G{i}"] for i in range(40)]
    b = [["later\n" + str(i), f"{i}"] for i in range(30)]
    (tmp_path / "a.csv").write_text("﻿" + sheet([["ID", "이름", "학년"], *a]), newline="")
    (tmp_path / "b.csv").write_text("\n" + sheet([["이름", "ID"], [], *b]), newline="")
    df = normalize_roster(read_roster_file(spark, str(tmp_path)))
    got = [(r.id, r.name, r.grade) for r in df.orderBy("seq").collect()]
    assert got == [tuple(r) for r in a] + [(i, n, "") for n, i in b]
    # the last duplicate in file order wins
    new, imported = mutate.import_students(spark.createDataFrame([], STUDENTS), read_roster_file(spark, str(tmp_path)), "2024-01-01 00:00:00")
    assert imported.first().imported == 70
    assert {r.id: (r.name, r.grade) for r in new.collect()} == {str(i): (f"later\n{i}", None) if i < 30 else ("line\nbreak" if i % 3 else "n", f"G{i}") for i in range(40)}


def test_number_rows_of_json_and_parquet(spark, tmp_path, small_splits):
    names = [f"n{i}" for i in range(300)]
    (tmp_path / "j").mkdir()
    for f, part in (("1.json", names[:120]), ("2.json", names[120:])):
        (tmp_path / "j" / f).write_text("\n".join(f'{{"id": "{n}", "seq": 9}}' for n in part))
    got = read_roster_file(spark, str(tmp_path / "j"), "json").orderBy("seq").collect()
    assert [r.id for r in got] == names and [r.seq for r in got] == list(range(300))
    for i, part in enumerate((names[:100], names[100:])):
        spark.createDataFrame([(n,) for n in part], "id string").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    for i in range(2):
        got = number_rows(spark.read.parquet(str(tmp_path / f"p{i}"))).orderBy("seq").collect()
        assert [r.id for r in got] == (names[:100], names[100:])[i]


def test_a_file_of_one_open_quote_and_empty_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('ID,이름\n1,"never\nclosed\n2,b\n')
    assert len(read_csv_in_order(spark, str(tmp_path / "open.csv")).collect()) == 1
    (tmp_path / "empty.csv").write_text("\n\n")
    assert read_csv_in_order(spark, str(tmp_path / "empty.csv")).collect() == []
    (tmp_path / "head.csv").write_text("ID,이름\n")
    assert read_csv_in_order(spark, str(tmp_path / "head.csv")).collect() == []


def ends_inside(line, inside):
    """A character machine for one line."""
    state = "in" if inside else "start"
    i = 0
    while i < len(line):
        c = line[i]
        if state == "in":
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
        elif c == ",":
            state = "start"
        elif state == "start":
            state = "in" if c == '"' else "plain"
        i += 1
    return state == "in"


def test_line_maps_equal_a_character_machine(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('",ab') for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.col("line").rlike(_OPENS).alias("o"), F.col("line").rlike(_STAYS).alias("s"))
    for r in df.collect():
        assert (r.o, r.s) == (ends_inside(r.line, False), ends_inside(r.line, True)), r.line


