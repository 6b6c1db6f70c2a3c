"""Hard negatives against brute force; bounds; odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointbook.llm import hard_negatives as hn
from pointbook.llm import queries as q
from pointbook.llm.vectors import integer_vectors


def brute(rows, every=50, relabel=7):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by whole numbers."""
    take = [(v, (l + 1) % 10 if v % relabel == 0 else l, [math.floor(256 * float(c)) for c in x]) for v, l, x in rows
            if l is not None and v is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, al, ax in take:
        if a % every:
            continue
        score = [(-sum(p * q for p, q in zip(ax, x)), v, l) for v, l, x in take if v != a]
        for s, p, _ in sorted(t for t in score if t[2] == al)[:5]:
            s = -s
            hard = sorted(t for t in score if t[2] != al and 50 * s <= -100 * t[0] <= 95 * s)[:3]
            out += [(a, p, r, v, s, -t) for r, (t, v, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    got = sorted(tuple(r) for r in q.QUERIES["op11_hard_negatives"](spark, f"/root/testdata/{sf}").collect())
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    assert got and got == brute([tuple(r) for r in rows])


ODD = [(0, 1, [0.5, -0.25, 0.1]), (1, 1, [0.5, -0.25, 0.1]), (2, 2, [0.4, 0.0, 0.1]), (3, 1, None), (4, None, [0.5, 0.1, 0.2]), (5, 1, [float("nan"), 0.0, 0.0]),
       (6, 3, [0.4, None, 0.1]), (8, 3, [0.4, 0.0, 0.1]), (9, 3, []), (10, 1, [0.5]), (50, 2, [0.4, 0.0, 0.1]), (50, 2, [0.4, 0.0, 0.1]), (11, 2, [0.3, 0.0, 0.1]),
       (12, 2, [float("inf"), 0.0, 0.0]), (13, 5, [0.29, 0.0, 0.1]), (13, 5, [0.29, 0.0, 0.1]), (None, 2, [0.4, 0.0, 0.1])]
SCHEMA = "vec_id long, label int, embedding array<float>, x string, slot string, score int, anchor string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "s", 1, "a") for r in ODD], SCHEMA)


def test_odd_rows(spark, odd):
    rows = integer_vectors(odd)
    assert rows.count() == 13 and rows.where("vec_id = 9").first().x == [] and rows.columns.count("x") == 1
    got = sorted(tuple(r) for r in hn.report(odd).collect())
    padded = [(v, l, x if x is None else list(x) + [0.0] * (3 - len(x))) for v, l, x in ODD if v is not None]
    assert got and got == brute(padded)
    assert {r[0] for r in got} >= {50} and len([r for r in got if r[0] == 50]) % 2 == 0  # the repeated anchor's results stand twice
    assert hn.report(odd.limit(0)).collect() == []
    assert hn.report(odd.where("vec_id = 9")).collect() == []


def test_groups_and_ties(spark):
    """Many equal vectors, two groups of anchors, a label that holds most rows."""
    rng = np.random.RandomState(1)
    rows = [(i, 0 if i % 3 else int(rng.randint(10)), (rng.randint(-2, 6, 8) / 16).tolist() if i % 2 else [0.25] * 8) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hn.mine(integer_vectors(df).withColumn("label", moved), F.col("vec_id") % 50 == 0, group=3)
    assert sorted(tuple(r)[:6] for r in got.collect()) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.RandomState(2)
    centres = rng.standard_normal((20, 64)) * 60
    x = np.floor(centres[rng.randint(20, size=3000)] + rng.standard_normal((3000, 64)) * 8).astype(np.int64)
    a, b = hn.Summaries(x[:50]), hn.Summaries(x)
    score = x[:50] @ x.T
    for am, ad, bm, bd in zip(a.means, a.devs, b.means, b.devs):
        mid, reach = am @ bm.T, ad @ bd.T
        assert (score <= mid + reach + 1e-3).all() and (score >= mid - reach - 1e-3).all()
    low = np.sort(score, axis=1)[:, -5].astype(float)
    i, j, s, scored = hn.bounded(a, slice(0, 50), b, np.ones(score.shape, bool), low, np.full(50, np.inf))
    want = {(p, q) for p, q in zip(*np.nonzero(score >= low[:, None]))}
    assert want <= set(zip(i, j)) and (s == score[i, j]).all() and scored < 0.5 * score.size


def test_large_components_are_exact(spark):
    rows = [(50, 1, [1e6, 1.0]), (1, 1, [1e6, 2.0]), (2, 2, [9e5, 3.0]), (3, 2, [8e5, 5e4])]
    got = sorted(tuple(r) for r in hn.report(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert got and got == brute(rows)
