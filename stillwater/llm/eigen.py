"""Eigenvalues and eigenvectors of a symmetric matrix: Householder tridiagonal form, then divide and conquer.

For the covariance of a feature space, so its size is bounded by the number of dimensions, not of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q with matrix = Q T Q'."""
    a, n = matrix.astype(float).copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max()
        if scale == 0:
            continue
        scale = max(scale, abs(x[0]))
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) for ascending d, each as the pole next to it and the distance from there."""
    n = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    half = (upper - d) / 2

    def f(origin: np.ndarray, tau: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 + rho * (z2[:, None] / ((d[:, None] - origin) - tau)).sum(0)

    right = (f(d, half) < 0) & (np.arange(n) < n - 1)  # the root lies nearer to the next pole
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    low = np.where(right, -half, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(n) < n - 1, half, upper - d))
    for _ in range(1200):
        mid = low + (high - low) / 2
        if ((mid == low) | (mid == high)).all():
            break
        above = f(origin, mid) > 0
        high = np.where(above, mid, high)
        low = np.where(above, low, mid)
    tau = np.where(low == 0, high, np.where(high == 0, low, low + (high - low) / 2))
    return origin, tau


def _update(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z' with rho > 0."""
    n = len(d)
    norm = np.linalg.norm(z)
    if norm == 0:
        return d, np.eye(n)
    z, rho = z / norm, rho * norm**2
    by = np.argsort(d, kind="stable")
    d, z, basis = d[by].copy(), z[by].copy(), np.eye(n)[:, by]
    small = 8 * EPS * max(np.abs(d).max(), rho)
    keep, last = [], -1
    for k in range(n):
        if abs(rho * z[k]) <= small:  # this vector is one already
            z[k] = 0
            continue
        if last >= 0:
            c, s, gap = z[k], z[last], d[k] - d[last]
            r = np.hypot(c, s)
            c, s = c / r, s / r
            if abs(gap * c * s) <= small:  # two poles at one place: turn one of them out
                z[k], z[last] = r, 0.0
                x, y = basis[:, last].copy(), basis[:, k].copy()
                basis[:, last], basis[:, k] = c * x - s * y, s * x + c * y
                d[last], d[k] = d[last] * c * c + d[k] * s * s, d[last] * s * s + d[k] * c * c
                keep.pop()
        keep.append(k)
        last = k
    out = d.copy()
    if keep:
        own = np.array(keep)
        by = np.argsort(d[own], kind="stable")
        own = own[by]
        p, z2 = d[own], z[own]
        origin, tau = _roots(p, z2**2, rho)
        apart = (p[:, None] - origin) - tau  # p - root, without cancellation
        # the vector that has these roots exactly keeps the eigenvectors orthogonal
        ratio = -apart.copy()
        gaps = p[None, :] - p[:, None]
        for j in range(len(own)):
            ratio[:, j] /= np.where(np.arange(len(own)) == j, rho, gaps[:, j])
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.where(z2 < 0, -1.0, 1.0)
        vectors = exact[:, None] / apart
        vectors /= np.linalg.norm(vectors, axis=0)
        out[own] = origin + tau
        basis[:, own] = basis[:, own] @ vectors
    return out, basis


def _conquer(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    if n == 1:
        return a.copy(), np.ones((1, 1))
    m = n // 2
    rho = abs(b[m - 1])
    left, right = a[:m].copy(), a[m:].copy()
    left[-1] -= rho
    right[0] -= rho
    d1, q1 = _conquer(left, b[: m - 1])
    d2, q2 = _conquer(right, b[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    if rho == 0:
        return np.concatenate([d1, d2]), q
    z = np.concatenate([q1[-1], np.copysign(1.0, b[m - 1]) * q2[0]])
    d, vectors = _update(np.concatenate([d1, d2]), z, rho)
    return d, q @ vectors


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns.

    The matrix is scaled by a power of two first.  One last step of Rayleigh quotients takes the values from the matrix
    itself.
    """
    n = len(matrix)
    most = np.abs(matrix).max() if n else 0.0
    if most == 0:
        return np.zeros(n), np.eye(n)
    scale = 2.0 ** np.floor(np.log2(most))
    own = matrix / scale
    a, b, q = tridiagonal(own)
    _, vectors = _conquer(a, b)
    vectors = q @ vectors
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, own @ vectors)
    by = np.argsort(-values, kind="stable")
    return values[by] * scale, vectors[:, by]
