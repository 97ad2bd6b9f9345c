"""Batched numpy kernels over stacks of small matrices, one per table row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Share of the sizes summed up that the rounding of a sum of products may amount to.
ROUNDING = 1e-9


def list_array(rows: np.ndarray) -> pa.Array:
    """A numpy stack as an Arrow list column, one flat list per row."""
    flat = np.ascontiguousarray(rows, dtype=float).reshape(len(rows), -1)
    width = flat.shape[1]
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1)))


def stack(column: pa.Array, *shape: int) -> np.ndarray:
    """An Arrow list column as a numpy stack; a null list is an error, not a gap."""
    if column.null_count:
        raise ValueError("null vector or matrix in a model table")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def scalars(column: pa.Array) -> np.ndarray:
    """An Arrow column as doubles; a null or NaN is an error, not a number."""
    out = column.to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or np.isnan(out).any():
        raise ValueError("null or NaN in a model table")
    return out


def _clip_eigenvalues(m: np.ndarray, floor) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    values = np.maximum(values, floor)
    return (vectors * values[..., None, :]) @ vectors.swapaxes(-1, -2)


def is_pd(m: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh((m + m.swapaxes(-1, -2)) / 2)[..., 0] > 0


def nearest_pd(m: np.ndarray, rounds: int = 10, floor: float = 1e-8) -> np.ndarray:
    """Alternate between positive eigenvalues and the input's own diagonal.

    The alternating projections with correction of Higham (2002), which fix a unit diagonal,
    here keep the input's.  The last step floors the eigenvalues, so the result is positive definite.
    """
    y = (m + m.swapaxes(-1, -2)) / 2
    on = np.eye(m.shape[-1], dtype=bool)
    diagonal = y[..., on]
    correction = np.zeros_like(y)
    for _ in range(rounds):
        shifted = y - correction
        y = _clip_eigenvalues(shifted, 0.0)
        correction = y - shifted
        y[..., on] = diagonal
    scale = np.maximum(np.abs(diagonal).max(axis=-1), 1e-300)
    y = _clip_eigenvalues(y, floor * scale[..., None])
    return (y + y.swapaxes(-1, -2)) / 2


def repair(m: np.ndarray) -> np.ndarray:
    """Matrices that are not positive definite replaced by the nearest that is."""
    bad = ~is_pd(m)
    if bad.any():
        m = m.copy()
        m[bad] = nearest_pd(m[bad])
    return m


def cholesky(m: np.ndarray) -> np.ndarray:
    """Lower factors.  Each matrix is judged alone: repaired if it has no factor itself."""
    if not np.isfinite(m).all():
        raise ValueError("null, NaN or infinite number in a matrix of the model")
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return np.stack([_cholesky_of(one) for one in m])


def _cholesky_of(m: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(nearest_pd(m[None])[0])


def inverse_factor(precision: np.ndarray) -> np.ndarray:
    """Upper triangular A with A A' = inverse of the precision."""
    lower = cholesky(precision)
    eye = np.broadcast_to(np.eye(lower.shape[-1]), lower.shape)
    return np.linalg.solve(lower, eye).swapaxes(-1, -2)


def wishart(v: np.ndarray, dof: int, z: np.ndarray) -> np.ndarray:
    """Wishart(dof, inverse of dof * v) from p x dof standard normals."""
    g = inverse_factor(v) @ z / np.sqrt(dof)
    return g @ g.swapaxes(-1, -2)


def times(m: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (m @ vector[..., None])[..., 0]


def pooled(v, n1, sum_b, z_w, z_mu, prior_mean, prior_precision, dof):
    """W, Sigma, mu and mu_draw for a stack of h2 rows."""
    w = wishart(v, dof, z_w)
    factor = inverse_factor(n1[:, None, None] * w + np.diag(prior_precision))
    sigma = factor @ factor.swapaxes(-1, -2)
    mu = times(sigma, times(w, sum_b) + prior_mean * prior_precision)
    return w, sigma, mu, mu + times(factor, z_mu)


def group_posterior(xtx, xty, w, mu, h, z):
    """Covariance, mean and draw of the coefficients for a stack of groups."""
    factor = inverse_factor(h[:, None, None] * xtx + w)
    cov = factor @ factor.swapaxes(-1, -2)
    mean = times(cov, h[:, None] * xty + times(w, mu))
    return cov, mean, mean + times(factor, z)


def ssr_from_moments(xtx, xty, yty, b):
    """Squared residuals from raw sums of products, for responses near 0."""
    whole = yty + np.einsum("ni,ni->n", b, times(xtx, b) - 2 * xty)
    return _no_less_than_zero(whole, np.abs(yty) + np.abs(b * xty).sum(axis=1))


def ssr_centred(n, mean, centred, b):
    """Squared residuals from centred moments (upper triangles, the response last)."""
    upper = np.triu_indices(b.shape[1])
    v = np.column_stack([-b[:, 1:], np.ones(len(b))])
    terms = centred * v[:, upper[0]] * v[:, upper[1]] * np.where(upper[0] < upper[1], 2.0, 1.0)
    level = (mean * v).sum(axis=1) - b[:, 0]
    return _no_less_than_zero(terms.sum(axis=1), np.abs(terms).sum(axis=1)) + n * level ** 2


def _no_less_than_zero(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounding below 0 is cut off; anything more is an error."""
    if (total < -ROUNDING * size).any():
        raise ValueError("negative sum of squares in the moments of a group")
    return np.maximum(total, 0.0)
