"""Small dense linear algebra on stacks of matrices, for use inside grouped functions."""

from __future__ import annotations

import numpy as np


def covariance(x: np.ndarray) -> np.ndarray:
    """x (..., channels, samples) -> covariances with one degree of freedom less."""
    d = x - x.mean(-1, keepdims=True)
    return d @ np.swapaxes(d, -1, -2) / max(x.shape[-1] - 1, 1)


def shrink(c: np.ndarray, by: float = 0.05) -> np.ndarray:
    n = c.shape[-1]
    return (1 - by) * c + by * np.trace(c) / n * np.eye(n)


def generalized(c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c v = l r v for a stack c and one positive definite r: eigenvalues ascending, V' R V = I."""
    inverse = np.linalg.inv(np.linalg.cholesky(r))
    w = inverse @ c @ inverse.T
    values, vectors = np.linalg.eigh((w + np.swapaxes(w, -1, -2)) / 2)
    return values, inverse.T @ vectors


def top_components(c: np.ndarray, k: int = 3) -> np.ndarray:
    """Orthonormal eigenvectors of the k largest (signed) eigenvalues."""
    return np.linalg.eigh(c)[1][..., ::-1][..., :k]


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of the cosines of the principal angles between column spaces."""
    s = np.linalg.svd(np.swapaxes(np.linalg.qr(a)[0], -1, -2) @ np.linalg.qr(b)[0], compute_uv=False)
    return np.clip(s.prod(-1), -1, 1)


def bounded_minimum(f, lo: float, hi: float, tolerance: float = 1e-2) -> float:
    """Where a function of one variable is least: golden section, which needs no derivative."""
    g = (5**0.5 - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def bounded_minima(f, lo: np.ndarray, hi: np.ndarray, tolerance: float = 1e-2) -> np.ndarray:
    """bounded_minimum() of many functions at once: f takes and gives an array with an item for each, and so do lo and hi."""
    g = (5**0.5 - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while (b - a > tolerance).any():
        left = fc <= fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        new = np.where(left, b - g * (b - a), a + g * (b - a))
        c, d, known = np.where(left, new, d), np.where(left, c, new), np.where(left, fc, fd)
        at = f(new)
        fc, fd = np.where(left, at, known), np.where(left, known, at)
    return (a + b) / 2


def akima(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Akima's interpolation of 1970; a straight line for two points, a constant for one. Beyond the ends: the end's cubic."""
    x, first = np.unique(x, return_index=True)
    y = y[first]
    if len(x) < 3:
        return np.interp(at, x, y)
    m = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    right, left = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    total = right + left
    t = np.where(total > 1e-12, (right * m[1:-2] + left * m[2:-1]) / np.where(total > 1e-12, total, 1), (m[1:-2] + m[2:-1]) / 2)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, u = (x[1:] - x[:-1])[k], at - x[k]
    s = ((y[1:] - y[:-1]) / (x[1:] - x[:-1]))[k]
    return y[k] + t[k] * u + (3 * s - 2 * t[k] - t[k + 1]) / h * u**2 + (t[k] + t[k + 1] - 2 * s) / h**2 * u**3
