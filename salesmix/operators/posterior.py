"""Posterior pieces of the two-level regression, each over a table of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyed_random as rnd
from ..functions import linalg as la

VECTOR = "array<double>"


def ols_by_group(stats: DataFrame, p: int) -> DataFrame:
    """Least-squares start values, pinv(X'X) X'y; collinear groups take the shortest."""
    @F.arrow_udf(VECTOR)
    def solve(xtx: pa.Array, xty: pa.Array) -> pa.Array:
        inverse = np.linalg.pinv(la.stack(xtx, p, p), rcond=1e-13, hermitian=True)
        return la.list_array(la.times(inverse, la.stack(xty, p)))

    return stats.withColumn("beta", solve("xtx", "xty"))


def random_start_by_group(groups: DataFrame, keys: list[str], p: int, seed: int) -> DataFrame:
    """Start values uniform on (-1, 1)."""
    key = rnd.key_of(seed, 0, columns=tuple(keys), name="start")
    return groups.withColumn("beta", F.transform(rnd.uniforms(key, p), lambda u: 2.0 * u - 1.0))


def check_dof(df1: int, p: int) -> None:
    if df1 < p:
        raise ValueError(f"Wishart degrees of freedom {df1} are below the {p} coefficients")


def wishart_key(seed: int, iteration: int | str) -> str:
    return rnd.key_of(seed, iteration, columns=("h2",), name="W")


def pooled_key(seed: int, iteration: int | str) -> str:
    return rnd.key_of(seed, iteration, columns=("h2",), name="mu")


def group_key(seed: int, iteration: int | str) -> str:
    return rnd.key_of(seed, iteration, columns=("h2", "h1"), name="b")


def noise_key(seed: int, iteration: int | str) -> str:
    return rnd.key_of(seed, iteration, columns=("h2",), name="h")


def wishart_draw_by_group(pooled: DataFrame, p: int, df1: int, seed: int,
                          iteration=1) -> DataFrame:
    """Draw the pooled precision W ~ Wishart(df1, inverse of df1 * v_j)."""
    check_dof(df1, p)

    @F.arrow_udf(VECTOR)
    def draw(v: pa.Array, z: pa.Array) -> pa.Array:
        return la.list_array(la.wishart(la.stack(v, p, p), df1, la.stack(z, p, df1)))

    return pooled.withColumn("w", draw("v_j", rnd.normals(wishart_key(seed, iteration), p * df1)))


def nearest_pd_by_group(df: DataFrame, matrix: str, p: int) -> DataFrame:
    """Repair a matrix column where it is not positive definite."""
    @F.arrow_udf(VECTOR)
    def fix(m: pa.Array) -> pa.Array:
        return la.list_array(la.repair(la.stack(m, p, p)))

    return df.withColumn(f"{matrix}_pd", fix(matrix))


def _pooled_precision(w, n1, p, prior_precision):
    return (la.scalars(n1)[:, None, None] * la.stack(w, p, p)
            + np.diag(prior_precision))


def pooled_covariance(pooled: DataFrame, p: int, prior_precision: list[float]) -> DataFrame:
    """Sigma = inverse of n1 * W + diag(prior precision)."""
    @F.arrow_udf(VECTOR)
    def sigma(w: pa.Array, n1: pa.Array) -> pa.Array:
        factor = la.inverse_factor(_pooled_precision(w, n1, p, prior_precision))
        return la.list_array(factor @ factor.swapaxes(-1, -2))

    return pooled.withColumn("sigma", sigma("w", "n1"))


def pooled_mean(pooled: DataFrame, p: int, prior_mean: list[float],
                prior_precision: list[float]) -> DataFrame:
    """mu = Sigma (W sum_b + prior mean * prior precision)."""
    pull = np.asarray(prior_mean) * np.asarray(prior_precision)

    @F.arrow_udf(VECTOR)
    def mean(sigma: pa.Array, w: pa.Array, sum_b: pa.Array) -> pa.Array:
        right = la.times(la.stack(w, p, p), la.stack(sum_b, p)) + pull
        return la.list_array(la.times(la.stack(sigma, p, p), right))

    return pooled.withColumn("mu", mean("sigma", "w", "sum_b"))


def pooled_draw(pooled: DataFrame, p: int, prior_precision: list[float], seed: int,
                iteration=1) -> DataFrame:
    """mu_draw ~ N(mu, Sigma), drawn through the factor of the precision."""
    @F.arrow_udf(VECTOR)
    def draw(w: pa.Array, n1: pa.Array, mu: pa.Array, z: pa.Array) -> pa.Array:
        factor = la.inverse_factor(_pooled_precision(w, n1, p, prior_precision))
        return la.list_array(la.stack(mu, p) + la.times(factor, la.stack(z, p)))

    z = rnd.normals(pooled_key(seed, iteration), p)
    return pooled.withColumn("mu_draw", draw("w", "n1", "mu", z))


def _group_factor(h, xtx, w, p):
    return la.inverse_factor(la.scalars(h)[:, None, None] * la.stack(xtx, p, p)
                             + la.stack(w, p, p))


def group_covariance(groups: DataFrame, p: int) -> DataFrame:
    """V_i = inverse of h X'X + W."""
    @F.arrow_udf(VECTOR)
    def cov(h: pa.Array, xtx: pa.Array, w: pa.Array) -> pa.Array:
        factor = _group_factor(h, xtx, w, p)
        return la.list_array(factor @ factor.swapaxes(-1, -2))

    return groups.withColumn("v_i", cov("h", "xtx", "w"))


def group_mean(groups: DataFrame, p: int) -> DataFrame:
    """Posterior mean V_i (h X'y + W mu_draw)."""
    @F.arrow_udf(VECTOR)
    def mean(v: pa.Array, h: pa.Array, xty: pa.Array, w: pa.Array, mu: pa.Array) -> pa.Array:
        right = (la.scalars(h)[:, None] * la.stack(xty, p)
                 + la.times(la.stack(w, p, p), la.stack(mu, p)))
        return la.list_array(la.times(la.stack(v, p, p), right))

    return groups.withColumn("mean", mean("v_i", "h", "xty", "w", "mu_draw"))


def group_draw(groups: DataFrame, p: int, seed: int, iteration=1) -> DataFrame:
    """b_i ~ N(mean, V_i), drawn through the factor of the precision."""
    @F.arrow_udf(VECTOR)
    def draw(h: pa.Array, xtx: pa.Array, w: pa.Array, mean: pa.Array, z: pa.Array) -> pa.Array:
        factor = _group_factor(h, xtx, w, p)
        return la.list_array(la.stack(mean, p) + la.times(factor, la.stack(z, p)))

    z = rnd.normals(group_key(seed, iteration), p)
    return groups.withColumn("draw", draw("h", "xtx", "w", "mean", z))


def noise_precision_draw(s2: DataFrame, deflator: float, seed: int, iteration=1) -> DataFrame:
    """h ~ Gamma(v / 2, 2 / (v s2)) with v the deflated row count; mean 1 / s2.

    A perfect fit (s2 = 0) has no noise precision and stops the job with the h2's name.
    """
    v = f"(n / {float(deflator)!r}D)"
    noise = ("(CASE WHEN s2 > 0D THEN s2 ELSE CAST(raise_error(concat("
             "'no residual variance in h2 ', CAST(h2 AS STRING))) AS DOUBLE) END)")
    h = rnd.gamma(noise_key(seed, iteration), f"{v} / 2D", f"2D / ({v} * {noise})")
    return s2.withColumn("h", h)
