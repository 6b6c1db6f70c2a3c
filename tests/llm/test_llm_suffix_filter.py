"""The filter before op1's sort: it has as many places as the text needs, and only leaves out what no other row has."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark import SparkContext

from pointbook.llm import suffix_dedup

COLUMNS = "doc bigint, text_id bigint, body binary"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    some = lambda n: bytes(r.choices(b"abcdefgh ", k=n))
    shared = [some(120) for _ in range(6)]
    data = [(d, d + 1000, some(r.randint(0, 900)) + (r.choice(shared)[r.randint(0, 40):] if d % 3 == 0 else b"") + some(r.randint(0, 90))) for d in range(120)]
    data += [(200, 1, some(40)), (201, 2, b""), (202, 3, data[7][2]), (203, 4, shared[0] * 3)]
    return data, spark.createDataFrame(spark.sparkContext.parallelize(data, 5), COLUMNS)


def windows(rows):
    """Where the found segments' windows start."""
    return {(r.doc, r.text_id, i) for r in rows for i in range(r.place >> 8, (r.place >> 8) + (r.place & 255))}


def met(data):
    """Windows of pieces whose wider string two rows have."""
    got = suffix_dedup.Pieces.of(pa.array([b for *_, b in data], pa.binary()), 50)
    starts, n = [0], 0
    for *_, b in data:
        starts.append(n := n + len(b))
    of = defaultdict(set)
    for row, wide in zip(got.row.tolist(), got.wide.tolist()):
        of[wide].add(row)
    return {(*data[row][:2], first - starts[row] + i) for row, first, size, wide in zip(*(x.tolist() for x in (got.row, got.first, got.size, got.wide)))
            if len(of[wide]) > 1 for i in range(size)}


def removed(data):
    """The removed bytes of each text by brute force."""
    first = {}
    for d, _, b in sorted(data):
        for i in range(len(b) - 49):
            first.setdefault(b[i:i + 50], d)
    return {(d, t): gone for d, t, b in data if (gone := {k for i in range(len(b) - 49) if first[b[i:i + 50]] < d for k in range(i, i + 50)})}


def test_no_table_of_a_fixed_size_is_broadcast(spark, rows, monkeypatch):
    """A filter of 2^28 places fills up at some GB of text; then all segments were sent and sorted."""
    sent, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sent.append(value), real(self, value))[1])
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 4 << 10, raising=False)
    got = suffix_dedup.removed(rows[1]).collect()
    assert not sent
    assert {(r.doc, r.text_id): {k for s in r.cut for k in range(s.a, s.b)} for r in got} == removed(rows[0])


@pytest.mark.parametrize("parts", [1, 37])
def test_only_what_two_rows_have_is_sent(rows, parts):
    data, df = rows
    bits = suffix_dedup.answers(df, 50, parts)
    assert {r.part for r in bits.select("part").distinct().collect()} <= set(range(parts))
    want, got = met(data), suffix_dedup.found(df, 50, bits, parts, 3).collect()
    assert windows(got) == want and 0 < len(want) < sum(max(0, len(b) - 49) for *_, b in data) / 2
    # each task's distinct segments travel once
    assert len({r.body for r in got if r.body is not None}) == len({(r.id1, r.id2) for r in got})
    assert all((r.least, r.most, r.shard) == (None,) * 3 for r in got if r.body is None)


def test_what_is_not_answered_is_sent(rows):
    data, df = rows
    bits = suffix_dedup.answers(df, 50, 4)
    whole = {(d, t, i) for d, t, b in data for i in range(len(b) - 49)}
    assert windows(suffix_dedup.found(df, 50, bits.limit(0), 4, 2).collect()) == whole
    assert met(data) < windows(suffix_dedup.found(df, 50, bits.where("part = 1"), 4, 2).collect()) < whole
