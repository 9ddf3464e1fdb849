"""Whitening: against exact arithmetic and a direct decomposition, clustered eigenvalues, odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import queries, whitening


def exact(vectors):
    """n, sums and the covariance of the distinct floored vectors, in fractions."""
    d = max(map(len, vectors))
    xs = [tuple(math.floor(256 * float(c)) for c in v) + (0,) * (d - len(v)) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum(n * x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    return xs, n, sums, cov


def check(rows, ids, vectors, most=4):
    xs, n, sums, cov = exact(vectors)
    a = np.array([[float(c) for c in r] for r in cov])
    values, basis = np.linalg.eigh(a)
    values, basis = values[::-1], basis[:, ::-1]
    by = {}
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-9
        by.setdefault((r.vec_id, r.component), []).append(r)
    k = len({c for _, c in by})
    assert k == min(most, sum(values > len(a) * 2.0**-52 * values.sum()))
    assert sum(map(len, by.values())) == k * len(vectors)
    for c in range(1, k + 1):
        got, want = [], []
        for key, x in zip(ids, xs, strict=True):
            r = by[key, c][0]
            assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            assert abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9
            got.append(r.whitened)
            want.append(float(np.dot([float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)], basis[:, c - 1])) / math.sqrt(values[c - 1]))
        sign = 1 if np.dot(got, want) > 0 else -1
        assert np.allclose(got, np.array(want) * sign, rtol=1e-7, atol=1e-7)


def test_query_against_exact_arithmetic(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(queries.op12_whitening(spark, folder).collect(), [r.vec_id for r in table], [r.embedding for r in table])


@pytest.mark.parametrize("spread", [0.0, 1e-14, 1e-10, 1e-6, 1e-3])
def test_clustered_eigenvalues_are_refined_beyond_single_precision(spread):
    rnd = np.random.default_rng(7)
    d = 24
    q = np.linalg.qr(rnd.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (np.eye(d, dtype=np.longdouble) * 1.5 - 0.5 * (q.T @ q))
    lam = np.array([1.0, 1.0 - spread, 1.0 - 2 * spread, 0.5, 0.5 - spread, *np.linspace(0.4, 0.01, d - 5)], np.longdouble)
    a = (q * lam) @ q.T
    a = (a + a.T) / 2
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    values, x = whitening.refine(a, rough)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-16
    assert np.abs(a @ x - x * values).max() < 1e-16
    assert np.abs(values - np.sort(lam)[::-1]).max() < 1e-16
    assert np.abs(a.astype(np.float64) @ rough - rough * np.float64(values)).max() > 1e-9  # where it began
    if spread >= 1e-10:  # as far as the gap allows, the vectors themselves
        assert np.abs(np.abs((x * q[:, np.argsort(-lam, kind="stable")]).sum(0)) - 1).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")


def test_rows_that_are_left_out_or_repeated(spark):
    rnd = np.random.default_rng(1)
    good = [(k, rnd.normal(size=5).tolist(), "x") for k in range(40)] + [(None, [0.0] * 5, "x"), (3, [9.0] * 5, "y")] + [(100 + k, [0.25] * 5, "hot") for k in range(60)]
    bad = [(200, None, "x"), (201, [1.0, None, 1.0, 1.0, 1.0], "x"), (202, [float("nan")] * 5, "x"), (203, [1.0, 2.0, float("-inf"), 0.0, 0.0], "x")]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == {g[0] for g in good} and len(rows) == 4 * len(good)
    _, n, sums, _ = exact([g[1] for g in good])
    assert {r.n for r in rows} == {n} and n == 43
    hot = {(r.component, r.deviation, r.whitened) for r in rows if r.vec_id is not None and r.vec_id >= 100}
    assert len(hot) == 4


def test_lengths_differ_and_few_directions(spark):
    vectors = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 0.0], [4.0], [], [0.0, 1.0], [0.5, 0.5, 0.5, 0.0]]
    rows = whitening.whiten(frame(spark, [(k, v, "") for k, v in enumerate(vectors)])).collect()
    check(rows, range(len(vectors)), vectors)
    line = [[k * 0.5, k * 1.0, 0.0] for k in range(9)]
    check(whitening.whiten(frame(spark, [(k, v, "") for k, v in enumerate(line)])).collect(), range(9), line)


def test_no_direction_and_no_row(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")])).count() == 0
    empty = whitening.whiten(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long_are_null_and_those_below_are_exact(spark):
    vectors = [[2.0**23, 1.0], [-(2.0**23), 2.0], [3.0, 2.0**21], [1e300, 0.0]]
    rows = {r.vec_id: r for r in whitening.whiten(frame(spark, [(k, v, "") for k, v in enumerate(vectors[:3])])).collect()}
    xs, n, sums, _ = exact(vectors[:3])
    assert {k: r.deviation for k, r in rows.items()} == {k: v if (v := sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) < 2**63 else None for k, x in enumerate(xs)}
    rows = whitening.whiten(frame(spark, [(k, v, "") for k, v in enumerate(vectors)])).collect()
    assert {r.deviation for r in rows if r.vec_id == 3} == {None}
