"""Batched kernels and keyed draws against direct numpy and known moments."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesmix.functions import keyed_random as rnd
from salesmix.functions import linalg as la
from salesmix.operators import posterior as post


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(5)


def spd(rng, count, p):
    a = rng.normal(size=(count, p, p + 3))
    return a @ a.swapaxes(1, 2)


def test_inverse_factor(rng):
    m = spd(rng, 20, 6)
    a = la.inverse_factor(m)
    np.testing.assert_allclose(a @ a.swapaxes(1, 2), np.linalg.inv(m), rtol=1e-8)


def test_group_posterior_matches_direct_formula(rng):
    p, n = 5, 12
    xtx, w = spd(rng, n, p), spd(rng, n, p)
    xty, mu, z = rng.normal(size=(3, n, p))
    h = rng.uniform(0.5, 2, n)
    cov, mean, draw = la.group_posterior(xtx, xty, w, mu, h, z)
    for i in range(n):
        v = np.linalg.inv(h[i] * xtx[i] + w[i])
        m = v @ (h[i] * xty[i] + w[i] @ mu[i])
        np.testing.assert_allclose(cov[i], v, rtol=1e-7)
        np.testing.assert_allclose(mean[i], m, rtol=1e-7)
    zero = la.group_posterior(xtx, xty, w, mu, h, np.zeros((n, p)))[2]
    np.testing.assert_allclose(zero, mean, rtol=1e-12)
    assert draw.shape == (n, p)


def test_draws_have_the_posterior_covariance(rng):
    xtx, w = spd(rng, 1, 3), spd(rng, 1, 3)
    n = 40_000
    z = rng.normal(size=(n, 3))
    many = [np.broadcast_to(a, (n, *a.shape[1:])) for a in (xtx, np.ones((1, 3)), w, np.ones((1, 3)))]
    cov, mean, draw = la.group_posterior(*many, np.ones(n), z)
    np.testing.assert_allclose(np.cov(draw.T), cov[0], atol=4 * np.abs(cov[0]).max() / np.sqrt(n))


def test_ssr_from_moments(rng):
    x = np.column_stack([np.ones(40), rng.normal(size=(40, 3))])
    y, b = rng.normal(size=40), rng.normal(size=4)
    got = la.ssr_from_moments((x.T @ x)[None], (x.T @ y)[None], np.array([y @ y]), b[None])
    assert got[0] == pytest.approx(((y - x @ b) ** 2).sum())


def test_wishart_mean(rng):
    v, dof, n = spd(rng, 1, 3)[0], 9, 20_000
    w = la.wishart(np.broadcast_to(v, (n, 3, 3)), dof, rng.normal(size=(n, 3, dof)))
    want = np.linalg.inv(v)
    np.testing.assert_allclose(w.mean(axis=0), want, atol=0.05 * np.abs(want).max())
    inverse_mean = np.linalg.inv(w).mean(axis=0)
    np.testing.assert_allclose(inverse_mean, dof * v / (dof - 3 - 1), rtol=0.1, atol=0.5)


def test_nearest_pd(rng):
    good = np.array([[1, .5, 0], [.5, 1, 0], [0, 0, 1.0]])
    bad = np.array([[1, .9, -.9], [.9, 1, .9], [-.9, .9, 1.0]])
    out = la.repair(np.stack([good, bad]))
    np.testing.assert_array_equal(out[0], good)
    assert np.linalg.eigvalsh(out[1])[0] > 0
    np.testing.assert_allclose(out[1], out[1].T)
    np.testing.assert_allclose(np.diag(out[1]), 1, atol=0.05)
    assert np.abs(out[1] - bad).max() < 0.5
    assert np.isfinite(la.cholesky(np.stack([good, bad]))).all()


def test_null_matrix_is_an_error(spark):
    df = spark.sql("SELECT CAST(NULL AS array<double>) AS m")
    with pytest.raises(Exception, match="null vector or matrix"):
        post.nearest_pd_by_group(df, "m", 2).collect()


def test_degrees_of_freedom_are_checked(spark):
    with pytest.raises(ValueError, match="degrees of freedom"):
        post.wishart_draw_by_group(spark.range(1), 4, 3, 1)


def test_keyed_numbers_follow_md5(spark):
    df = spark.sql("SELECT 'g1' AS h2").select(
        rnd.uniforms(rnd.key_of(7, 2, columns=("h2",), name="u"), 3).alias("u"),
        rnd.normals(rnd.key_of(7, 2, columns=("h2",), name="u"), 3).alias("z"))
    row = df.first()
    for k in range(3):
        d = hashlib.md5(f"7|2|g1|u|{k}".encode()).hexdigest()
        u, v = ((int(d[i:i + 8], 16) + 0.5) / 2 ** 32 for i in (0, 8))
        assert row.u[k] == pytest.approx(u)
        assert row.z[k] == pytest.approx(math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v))


@pytest.mark.parametrize("shape", [0.4, 1.0, 7.5, 5000.0])
def test_gamma_moments(spark, shape):
    df = spark.range(20_000).select(rnd.gamma(
        rnd.key_of(3, "id", name="h"), f"{shape}D", "2D").alias("h"))
    row = df.select(F.avg("h").alias("m"), F.variance("h").alias("v"),
                    F.min("h").alias("low"), F.count("h").alias("n")).first()
    assert row.n == 20_000 and row.low > 0
    assert row.m == pytest.approx(2 * shape, rel=0.04)
    assert row.v == pytest.approx(4 * shape, rel=0.1)


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("h2"))
    z = rnd.normals(rnd.key_of(1, 1, columns=("h2",), name="b"), 4).alias("z")
    one = df.repartition(1).select("h2", z).orderBy("h2").collect()
    many = df.repartition(7).select("h2", z).orderBy("h2").collect()
    assert one == many


def test_a_matrix_is_judged_alone():
    near = np.eye(6) * 1e-9 + np.ones((6, 6))
    bad = -np.eye(6)
    alone = la.cholesky(near[None])[0]
    assert np.array_equal(alone, la.cholesky(np.stack([near, bad]))[0])


def test_missing_numbers_are_refused():
    with pytest.raises(ValueError):
        la.scalars(pa.array([1.0, None]))
    with pytest.raises(ValueError):
        la.cholesky(np.array([[[1.0, np.nan], [np.nan, 1.0]]]))
