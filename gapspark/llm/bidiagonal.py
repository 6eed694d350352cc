"""Singular values and right singular vectors of a small matrix by way of a bidiagonal one.

Householder reflections from both sides make the matrix upper bidiagonal. The differential qd algorithm
with shifts finds the squares of the singular values to high relative accuracy: every step keeps the
quotients positive, a shift that does not is taken back. The vectors come from twisted factorisations of
B'B less the value: a stationary qd sweep from the top and a progressive one from the bottom meet at
the row where they agree best, and the vector follows from there by products alone. Values closer than
``CLUSTER`` to one another get their vectors made orthogonal to the earlier ones.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
CLUSTER = 1e-5
STEPS = 60


def bidiagonalised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of ``matrix = U B V'``, by Householder reflections."""
    a = np.array(matrix, float)
    d = a.shape[1]
    if a.shape[0] < d:
        a = np.vstack([a, np.zeros((d - a.shape[0], d))])
    v = np.eye(d)
    for k in range(d):
        reflect(a[k:, k:], a[k:, k].copy())
        if k + 2 < d:
            w = reflector(a[k, k + 1 :].copy())
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection takes ``x`` to its first axis."""
    peak = np.abs(x).max(initial=0)
    if len(x) < 2 or peak == 0 or not x[1:].any():
        return None
    x = x / peak
    x[0] += np.copysign(np.sqrt(x @ x), x[0])
    return x / np.sqrt(x @ x)


def reflect(block: np.ndarray, column: np.ndarray) -> None:
    if (w := reflector(column)) is not None:
        block -= 2 * np.outer(w, w @ block)


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One differential qd transform: new q and e, the least d, and where d first fell below zero (-1:
    nowhere)."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least, bad = d, 0 if d < 0 else -1
    for i in range(n - 1):
        if bad >= 0:
            break
        new_q[i] = d + e[i]
        if new_q[i] > 0:
            ratio = q[i + 1] / new_q[i]
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        else:
            new_e[i] = 0.0
            d = q[i + 1] - shift
        least = min(least, d)
        if d < 0:
            bad = i + 1
    new_q[n - 1] = d
    return new_q, new_e, least, bad


def qd_values(q: list[float], e: list[float], base: float = 0.0) -> list[float]:
    """Eigenvalues of the tridiagonal matrix with quotients ``q`` and ``e``, plus ``base``."""
    found: list[float] = []
    q, e = list(q), list(e)
    least = 0.0
    for _ in range(STEPS * max(1, len(q))):
        while q:
            if len(q) == 1:
                return [*found, base + q[0]]
            if e[-1] <= EPS * EPS * (base + q[-1]) or e[-1] <= TINY:
                found.append(base + q.pop())
                e.pop()
                least = 0.0
            else:
                break
        cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= EPS * EPS * (base + q[i + 1]) or e[i] <= TINY), None)
        if cut is not None:
            return [*found, *qd_values(q[: cut + 1], e[:cut], base), *qd_values(q[cut + 1 :], e[cut + 1 :], base)]
        shift, tries = max(0.0, least * (1 - 4 * EPS)), 0
        while True:
            new_q, new_e, d, bad = qd_step(q, e, shift)
            if bad < 0 or shift == 0:
                break
            tries += 1  # a last d below zero tells how far the shift went too far
            shift = max(0.0, shift + new_q[-1] * (1 + 4 * EPS)) if bad == len(q) - 1 and tries < 3 else shift / 4 if tries < 6 else 0.0
        q, e, base, least = new_q, new_e, base + shift, max(0.0, d)
    raise ArithmeticError("the qd algorithm did not converge")


def twisted(diag: np.ndarray, upper: np.ndarray, value: float, rank: int = 0) -> np.ndarray:
    """The vector of B'B to an eigenvalue, twisted at the row with the ``rank``-th smallest residual."""
    n = len(diag)
    big, low = diag**2, upper / diag[:-1]  # B'B = L D L' with D and L
    s = -value
    plus = np.zeros(n - 1)
    stationary = np.zeros(n)
    for i in range(n - 1):
        stationary[i] = s
        pivot = big[i] + s
        pivot = pivot if pivot != 0 else TINY
        plus[i] = big[i] * low[i] / pivot
        s = plus[i] * low[i] * s - value
    stationary[n - 1] = s
    minus = np.zeros(n - 1)
    progressive = np.zeros(n)
    p = big[n - 1] - value
    progressive[n - 1] = p
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] ** 2 + p
        pivot = pivot if pivot != 0 else TINY
        ratio = big[i] / pivot
        minus[i] = low[i] * ratio
        p = p * ratio - value
        progressive[i] = p
    with np.errstate(invalid="ignore", over="ignore"):
        gamma = np.abs(stationary + progressive + value)
    gamma[~np.isfinite(gamma)] = np.inf
    k = int(np.argsort(gamma, kind="stable")[min(rank, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    z = np.nan_to_num(z, nan=0.0, posinf=1e150, neginf=-1e150)
    z /= np.abs(z).max()
    return z / np.sqrt(z @ z)


def segment_vectors(diag: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and vectors (columns) of B'B, no upper entry of which is negligible."""
    n = len(diag)
    values = np.sort(qd_values((diag**2).tolist(), (upper**2).tolist()))[::-1]
    vectors = np.zeros((n, n))
    for j, value in enumerate(values.tolist()):
        near = [i for i in range(j) if values[i] - value <= CLUSTER * values[i]]
        for rank in range(n):
            z = twisted(diag, upper, value, rank) if n > 1 else np.ones(1)
            left = z.copy()
            for _ in range(2):
                for i in near:
                    left -= (vectors[:, i] @ left) * vectors[:, i]
            size = np.sqrt(left @ left)
            if not near or size > 1e-3:
                break
        vectors[:, j] = left / size if size > 0 else z
    return values, vectors


def eigen_of_gram(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and eigenvectors (columns) of ``matrix' matrix``, values of no significant
    size as zero."""
    d = matrix.shape[1]
    peak = float(np.abs(matrix).max(initial=0))
    if not d or peak == 0:
        return np.zeros(d), np.eye(d)
    diag, upper, v = bidiagonalised(matrix / peak)
    size = max(np.abs(diag).max(), np.abs(upper).max(initial=0))
    diag = np.where(np.abs(diag) < EPS * size, EPS * size, diag)
    cuts = [0, *(i + 1 for i in range(d - 1) if abs(upper[i]) <= EPS * size), d]
    values, vectors = np.zeros(d), np.zeros((d, d))
    for a, b in zip(cuts[:-1], cuts[1:]):
        values[a:b], vectors[a:b, a:b] = segment_vectors(diag[a:b], upper[a : b - 1])
    values[values <= (8 * d * EPS * size) ** 2] = 0
    order = np.argsort(-values, kind="stable")
    vectors = v @ vectors[:, order]
    return values[order] * peak**2, vectors
