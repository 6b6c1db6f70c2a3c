"""Whitening against a dense eigensolver and whole-number sums; inertia counts; odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointbook.llm import queries as q
from pointbook.llm import spectrum, whitening


def brute(rows, k=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} by exact sums and numpy's eigenvectors."""
    take = [(v, tuple(math.floor(256 * float(c)) for c in x)) for v, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    d = max((len(x) for _, x in take), default=0)
    take = [(v, x + (0,) * (d - len(x))) for v, x in take]
    fit = sorted({x for _, x in take})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float).reshape(n, d) - np.array(s) / max(n, 1)
    cov = y.T @ y / max(n, 1)
    e, axes = np.linalg.eigh(cov) if d else (np.zeros(0), np.zeros((0, 0)))
    order = [i for i in np.argsort(-e)[:k] if e[i] > 1e-9 * max(e.max(), 1e-300)]
    return {(v, c): (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), float((np.array(x) - np.array(s) / n) @ axes[:, i] / math.sqrt(e[i])), e[i] / np.trace(cov))
            for v, x in take for c, i in enumerate(order, 1)}


def check(got, want):
    assert len(got) == len(want)
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, dev, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(share, rel=1e-9) and 0 <= r.identity_error < 1e-9
        sign.setdefault(r.component, 1 if r.whitened * w >= 0 else -1)
        assert r.whitened == pytest.approx(sign[r.component] * w, rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    got = q.QUERIES["op12_whitening"](spark, f"/root/testdata/{sf}").collect()
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(got, brute([tuple(r) for r in rows]))


def test_odd_rows(spark):
    rows = [(1, [0.5, 0.25, 1.0]), (2, [0.5, 0.25, 1.0]), (2, [0.5, 0.25, 1.0]), (3, None), (4, [0.1, None, 0.2]), (5, [float("nan"), 0.0, 0.0]), (6, [-0.3, 0.7]),
            (7, []), (8, [0.9, -0.8, -0.0]), (9, [float("inf"), 1.0, 1.0]), (10, [20.0, -1.0, 3.5])]
    df = spark.createDataFrame([(v, x, "n", "w") for v, x in rows], "vec_id long, embedding array<double>, n string, w string")
    want = brute(rows)
    got = whitening.report(df).collect()
    assert sorted({r.component for r in got}) == [1, 2, 3]
    assert sorted((r.vec_id, r.component) for r in got) == sorted([*want, *((2, c) for c in (1, 2, 3))])
    check([r for i, r in enumerate(got) if (r.vec_id, r.component) not in {(x.vec_id, x.component) for x in got[:i]}], want)
    assert whitening.report(df.limit(0)).collect() == [] == whitening.report(df.where("vec_id in (1, 2)")).collect() == whitening.report(df.where("vec_id = 7")).collect()
    schema = dict(whitening.report(df.limit(0)).dtypes)
    assert schema == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def test_operator_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [0.5, 0.75], "c")], "vec_id long, embedding array<float>, w string")
    from pointbook.llm.vectors import integer_vectors
    vectors = integer_vectors(df)
    model, distinct = whitening.fit(vectors, 2)
    got = whitening.project(vectors, model, out="z")
    assert got.columns == ["vec_id", "w", "x", "z"] and got.count() == 3 and distinct.count() == 3
    assert whitening.report(df).where("vec_id is null").count() == 2


def test_deviation_beyond_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = whitening.report(df).collect()
    assert len(got) == 3 and {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 0} and all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_leading_pairs(seed):
    rng = np.random.RandomState(seed)
    n = int(rng.randint(1, 40))
    q_, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = np.sort(rng.gamma(1, 3, n))[::-1]
    if n > 5 and seed % 2:
        e[1] = e[2] = e[3]  # one eigenvalue three times
    if n > 5 and seed % 3 == 0:
        e[4] = e[5] * (1 + 1e-9)
        e = np.sort(e)[::-1]
    a = (q_ * e) @ q_.T
    a = (a + a.T) / 2
    values, axes = spectrum.leading(a, 6)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:6], rtol=1e-10, atol=1e-12 * e[0])
    assert np.allclose(axes @ axes.T, np.eye(len(values)), atol=1e-9) and np.linalg.norm(a @ axes.T - axes.T * values) < 1e-9 * e[0]


def test_inertia_counts():
    rng = np.random.RandomState(0)
    for n in (1, 2, 5, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in (*rng.standard_normal(10) * 3, 0.0):
            assert spectrum.above(a, shift) == int((e > shift).sum())
            b = rng.standard_normal(n)
            assert np.allclose((a - shift * np.eye(n)) @ spectrum.Factors(a - shift * np.eye(n)).solve(b), b, atol=1e-6)
    assert spectrum.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_rank_is_counted():
    values, axes = spectrum.leading(np.diag([3.0, 0.0, 2.0, 0.0]), 4)
    assert np.allclose(values, [3, 2]) and np.allclose(np.abs(axes), [[1, 0, 0, 0], [0, 0, 1, 0]])
    assert len(spectrum.leading(np.zeros((3, 3)), 2)[0]) == 0 == len(spectrum.leading(np.zeros((0, 0)), 2)[0])
