import math
from fractions import Fraction

import numpy as np
import pytest

from driftwell.llm import whitening as w

KIND = "vec_id long, embedding array<float>, label int"


def leverrier(a):
    """Coefficients of det(t - a), lowest first, by Faddeev and LeVerrier in whole numbers."""
    d = len(a)
    m, found = np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + found[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        found.append(-Fraction(int(np.trace(a.dot(m))), k))
    return [int(c) for c in reversed(found)]


def symmetric(seed, d, rank=None, most=1_000):
    x = np.random.default_rng(seed).integers(-most, most, (rank or d + 3, d)).astype(object)
    return x.T.dot(x)


@pytest.mark.parametrize("d,rank", [(1, None), (2, None), (3, 1), (7, None), (12, 5), (20, None)])
def test_polynomial_by_brute_force(spark, d, rank):
    a = symmetric(d, d, rank, 10**7)
    assert w.characteristic(spark, a) == leverrier(a)


def test_polynomial_where_pivots_vanish(spark):
    for a in (np.diag([3, 3, 0, 5]), np.zeros((3, 3), int), np.array([[2, 0, 1], [0, 3, 0], [1, 0, 2]]), np.eye(6, dtype=int)):
        assert w.characteristic(spark, a.astype(object)) == leverrier(a.astype(object))


def test_roots_are_counted_and_found():
    # (t - 1)(t - 4)^2 (t - 9) t
    p = [0, -144, 232, -105, 18, -1]
    p = [-c for c in p]
    assert [w.roots_above(p, t) for t in (-1, 0, 1, 3, 4, 8, 9, 10)] == [5, 4, 3, 3, 1, 1, 0, 0]
    assert [round(float(r.value()), 9) for r in w.largest_roots(p, 9)] == [9, 4, 4, 1]
    assert [round(float(r.value()), 9) for r in w.largest_roots(p, 2)] == [9, 4]
    assert w.largest_roots([0, 0, 1], 3) == [] and w.largest_roots([1], 3) == []


@pytest.mark.parametrize("seed", range(4))
def test_roots_near_each_other(seed):
    """Roots that doubles cannot tell apart."""
    rng = np.random.default_rng(seed)
    roots = sorted((int(v) for v in rng.integers(1, 10**6, 5)), reverse=True)
    roots = [r * 10**18 for r in roots] + [roots[0] * 10**18 - 1]
    p = [1]
    for r in roots:
        p = [(p[i - 1] if i else 0) - r * (p[i] if i < len(p) else 0) for i in range(len(p) + 1)]
    found = w.largest_roots(p, 6)
    for r, want in zip(found, sorted(roots, reverse=True)):
        assert abs(r.value() - want) <= Fraction(2) ** r.power


@pytest.mark.parametrize("d", [1, 2, 5, 30])
def test_components_by_brute_force(d):
    a = symmetric(d, d)
    p = leverrier(a)
    values, vectors = np.linalg.eigh(a.astype(float))
    for k, root in enumerate(w.largest_roots(p, d)):
        v = w.null_vectors(a, root.value(), 1)[0]
        assert float(root.value()) == pytest.approx(values[-1 - k], rel=1e-9)
        assert abs(v @ vectors[:, -1 - k]) == pytest.approx(1, abs=1e-9) and v @ v == pytest.approx(1, abs=1e-14)


def test_many_small_parts():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 17, 1 << 40, w.MOST):
        y = rng.integers(-most, most + 1, (50, 4))
        s, p = w.exact_sums(y)
        big = y.astype(object)
        assert s.tolist() == big.sum(axis=0).tolist() and p.tolist() == big.T.dot(big).tolist()
    for v in (0, 1, -1, 1 << 40, -(1 << 200) + 17):
        assert sum(part << w.LIMB * k for k, part in enumerate(w.limbs(v))) == v


def brute(vectors, components):
    """Row index -> whitened values by a plain eigen decomposition; n, deviations and shares."""
    good = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in enumerate(vectors)}
    fit = np.unique(np.array(list(good.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    cov = z.T @ z / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)) for i, x in good.items()}
    white = {i: ((n * x - s) / n) @ basis[:, :k] / np.sqrt(values[:k]) for i, x in good.items()}
    return n, deviation, white, values[:k] / values.sum()


def check(got, vectors, components):
    n, deviation, white, explained = brute(vectors, components)
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, []).append(r)
    assert set(rows) == set(white)
    k = len(explained)
    made = {}
    for i, found in rows.items():
        found.sort(key=lambda r: r.component)
        assert [r.component for r in found] == list(range(1, k + 1))
        for r in found:
            assert r.n == n and r.deviation == deviation[i] and r.identity_error < 1e-9
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        made[i] = np.array([r.whitened for r in found])
    signs = np.sign(sum(made[i] * white[i] for i in white))
    for i in white:
        assert made[i] == pytest.approx(white[i] * signs, abs=1e-7)


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    got = w.whiten(df, "embedding", "vec_id").collect()
    ids = sorted(rows)
    number = {v: i for i, v in enumerate(ids)}
    renamed = [type(r)(**{**r.asDict(), "vec_id": number[r.vec_id]}) for r in got]
    check(renamed, [rows[i] for i in ids], 16)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [[float(np.float32(v)) for v in rng.normal(size=5)] for _ in range(40)]
    for r in rows:
        r[4] = 0.25  # no spread here
    rows += [rows[0], rows[0], rows[1]]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)] + [(900 + i, v, None) for i, v in enumerate(odd)], KIND)
    df = df.selectExpr("*", "1 AS x", "2 AS dim", "3 AS n", "4 AS component", "5 AS v")
    check(w.whiten(df, "embedding", "vec_id").collect(), rows, 16)
    check(w.whiten(df, "embedding", "vec_id", 2).collect(), rows, 2)


def test_equal_eigenvalues(spark):
    """Four directions of the same spread: any basis will do, and the whitened covariance is the identity."""
    rows = [[s * (k == j) * 2.0 for j in range(4)] for k in range(4) for s in (-1, 1)]
    got = w.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], KIND), "embedding", "vec_id").collect()
    z = np.zeros((8, 4))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(0.25) and r.identity_error < 1e-12
    assert z.T @ z / 8 == pytest.approx(np.eye(4), abs=1e-12)


def test_without_spread_or_vectors(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        assert w.whiten(spark.createDataFrame(rows, KIND), "embedding", "vec_id").count() == 0


def test_null_keys_and_huge_entries(spark):
    rows = [(None, [1e30, 1.0], 0), (None, [-1e30, 2.0], 0), (3, [0.0, 3.0], 0)]
    got = w.whiten(spark.createDataFrame(rows, KIND), "embedding", "vec_id").collect()
    assert len(got) == 6 and sum(r.vec_id is None for r in got) == 4
    assert {r.deviation for r in got if r.vec_id is None} == {None} and all(math.isfinite(r.whitened) for r in got)
