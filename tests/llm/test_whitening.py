import math

import numpy as np
import pytest

from surveyloom.llm import whitening
from surveyloom.llm.common import table
from surveyloom.llm.queries import op11_whitening


def brute(vectors, components=32):
    """Whole numbers by Python, the covariance by plain centred products, NumPy's eigenvalues."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array((n * x - sums) / n, float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return n, deviation, values, centred @ basis, values / np.trace(centred.T @ centred / n)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(rows, got, components=32):
    kept = [(i, v) for i, v in rows if usable(v)]
    n, deviation, values, turned, explained = brute([v for _, v in kept], components)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_id) == sorted(i for i, _ in kept)
    signs = None
    for (i, _), d, t in zip(kept, deviation, turned):
        own = by_id[i]
        assert sorted(own) == list(range(1, len(values) + 1))
        assert {(r.n, int(r.deviation)) for r in own.values()} == {(n, d)}
        white = np.array([own[c].whitened for c in sorted(own)])
        expected = t / np.sqrt(values)
        signs = np.sign(white) * np.sign(expected) if signs is None else signs
        assert np.allclose(white, signs * expected, rtol=1e-7, atol=1e-7)
        assert np.allclose([own[c].explained for c in sorted(own)], explained, rtol=1e-9)
        assert all(r.identity_error <= 1e-9 for r in own.values())


def test_embeddings_equal_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    check(rows, op11_whitening(spark, sf_dir).collect())


def planted(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * np.geomspace(20, 0.3, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    base[: n // 3] = base[0]  # a vector that a third of all rows repeat
    return base.astype(np.float32) + 3


@pytest.mark.parametrize("parts, block", [(1, 4096), (11, 7), (3, 64)])
def test_partitions_and_blocks_do_not_matter(spark, monkeypatch, parts, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    vectors = planted(1, 400, 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(parts)
    fit = whitening.fit_whitening(df, components=5)
    n, _, values, _, explained = brute(vectors, 5)
    assert fit.n == n and np.allclose(fit.variances, values, rtol=1e-12) and np.allclose(fit.explained, explained, rtol=1e-12)


@pytest.mark.parametrize("seed, dim", [(1, 1), (2, 2), (3, 17), (4, 64)])
def test_rank_one_updates_equal_a_full_decomposition(seed, dim):
    rng = np.random.default_rng(seed)
    values, vectors, total = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
    for step in range(3 * dim):
        v = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
        if step % 4 == 1:
            v[rng.random(dim) < 0.7] = 0  # untouched directions
        if step % 5 == 2:
            v = np.round(v)
        values, vectors = whitening.rank_one(values, vectors, v)
        total += np.outer(v, v)
        scale = np.abs(total).max()
        assert np.allclose(vectors.T @ vectors, np.eye(dim), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, total, atol=1e-11 * scale)
        assert (np.diff(values) >= 0).all()


def test_secular_roots_solve_the_equation():
    poles, z2 = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 5.0]), np.array([1e-6, 1.0, 1e-12, 3.0, 1e-3])
    origin, tau = whitening.secular_roots(poles, z2)
    exact = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(z2), np.sqrt(z2)))
    assert np.allclose(poles[origin] + tau, exact, rtol=1e-12, atol=1e-14)


def test_equal_eigenvalues_are_deflated():
    values, vectors = whitening.rank_one(np.ones(6), np.eye(6), np.arange(6.0))
    assert np.allclose(values, [1, 1, 1, 1, 1, 56]) and np.allclose(vectors.T @ vectors, np.eye(6))


def test_merged_spectra_equal_one_over_all_rows():
    rows = np.floor(64 * planted(2, 500, 9)).astype(np.int64)
    parts = []
    for part in np.array_split(rows, [1, 6, 200]):
        parts.append(whitening.Spectrum.empty(9))
        parts[-1].add_rows(part)
    total = whitening.Spectrum.empty(9)
    for part in parts:
        total.merge(part)
    centred = rows - rows.mean(axis=0)
    assert total.n == 500 and (total.sums == rows.sum(axis=0)).all()
    assert np.allclose(total.vectors * total.values @ total.vectors.T, centred.T @ centred, rtol=1e-10, atol=1e-6)


def test_odd_vectors(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)]  # the third entry never varies
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [float("nan"), 1.0, 1.0]), (23, [float("inf"), 1.0, 1.0]), (24, [1.0]), (25, []), (26, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 5, 0.5) for i, v in good + bad], "vec_id long, embedding array<double>, n int, whitened double").repartition(4)
    fit = whitening.fit_whitening(df)
    got = whitening.whitened(df, fit).collect()
    assert sorted({r.vec_id for r in got}) == list(range(9)) and fit.identity_error < 1e-12
    assert all(r.whitened == 0 for r in got if r.component == 3) and fit.explained[2] == 0
    one = df.where("vec_id = 3")
    alone = whitening.whitened(one.unionAll(one), whitening.fit_whitening(one.unionAll(one))).collect()
    assert len(alone) == 6 and all(r.whitened == 0 and r.deviation == 0 for r in alone)
    nothing = df.where("vec_id = 20")
    assert whitening.fit_whitening(nothing) is None and whitening.whitened(nothing, None).count() == 0
    assert whitening.fit_whitening(df.where("false")) is None
    anonymous = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(anonymous, whitening.fit_whitening(anonymous)).count() == 4


def test_deviations_beyond_64_bits_stay_exact():
    cells, n = np.array([[3, -(1 << 40)]]), 1 << 20
    sums = np.array([5, 7])
    assert [int(x) for x in whitening.deviations(cells, n, sums).to_pylist()] == [(3 * n - 5) ** 2 + (-(1 << 40) * n - 7) ** 2]
