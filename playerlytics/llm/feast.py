"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST).

Inertia counts (how many eigenvalues lie below a shift, by the signs of the pivots of the shifted
matrix in tridiagonal form) lay out intervals whose ends stand in gaps of the spectrum. For each
interval, quadrature on the circle over it sums solves of the complex shifted matrix; the sum
projects a block of vectors onto the interval's eigenspace, and Rayleigh-Ritz extracts the pairs.
The counts at the interval's ends then say whether one was missed. The matrix has the size of
the vectors' dimension squared, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np

#: Quadrature nodes on the half circle, eigenvalues wanted of one interval, rounds of refinement.
NODES, PER_INTERVAL, ROUNDS = 8, 8, 20
#: An interval of several values is at most so many times as wide as the gaps at its ends: else the circle is not sharp.
SHARP = 8.0
#: Gaps below this share of the largest eigenvalue do not separate intervals.
GAP = 1e-7


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix of the same eigenvalues (Householder reflections)."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        if not np.any(v[1:]):
            continue
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
        a[k + 1:, k:] -= 2 * np.outer(v, v @ a[k + 1:, k:])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each shift: the negative pivots of T - shift."""
    shifts = np.asarray(shifts, dtype=float)
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = np.zeros(shifts.shape, np.int64), np.ones(shifts.shape)
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def located(diagonal: np.ndarray, off: np.ndarray) -> np.ndarray:
    """All eigenvalues in rising order, by bisection on the counts."""
    n = len(diagonal)
    reach = np.abs(diagonal) + np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    bound = float(reach.max()) * (1 + 1e-12) or 1.0
    low, high, wanted = np.full(n, -bound), np.full(n, bound), np.arange(n)
    for _ in range(64):
        middle = (low + high) / 2
        under = below(diagonal, off, middle) > wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return (low + high) / 2


def intervals(values: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top, which together hold at least the ``k`` largest of the rising ``values``.

    Ends stand in gaps, so that eigenvalues that tie are never parted.
    """
    scale = float(np.abs(values).max()) or 1.0
    gaps = np.concatenate([[np.inf], np.diff(values), [np.inf]])  # below each value, and above the last
    cuts = np.flatnonzero(gaps[:-1] > GAP * scale)  # starts of groups of alike values
    out, top = [], len(values)
    while top and len(values) - top < k:
        able = cuts[cuts < top][::-1]  # at least one: below the smallest value
        width = values[top - 1] - values[able]
        fits = (top - able <= PER_INTERVAL) & (np.minimum(gaps[able], gaps[top]) * SHARP >= width)
        start = int(able[fits][-1] if fits.any() else able[0])
        low = (values[start - 1] + values[start]) / 2 if start else values[0] - GAP * scale
        high = (values[top - 1] + values[top]) / 2 if top < len(values) else values[-1] + GAP * scale
        out.append((float(low), float(high), top - start))
        top = start
    return out


def contour(matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """``block`` projected onto the eigenvalues in (low, high): quadrature of (z - matrix)^-1 over the circle."""
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(block)
    for x, w in zip(nodes, weights):
        turn = np.exp(0.5j * np.pi * (1 + x))
        shifted = (centre + radius * turn) * np.eye(len(matrix)) - matrix
        out += 0.5 * w * (radius * turn * np.linalg.solve(shifted, block.astype(complex))).real
    return out


def interval_pairs(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high), rising, and their unit vectors as columns."""
    n = len(matrix)
    size = min(n, max(count + 4, count * 3 // 2))
    block = np.random.default_rng(seed).standard_normal((n, size))
    exact, best, least = 1e-9 * max(abs(low), abs(high)), None, np.inf
    for _ in range(ROUNDS):
        basis = np.linalg.qr(contour(matrix, low, high, block))[0]
        ritz, small = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ small
        off = np.abs(matrix @ block - block * ritz).max(axis=0)
        found = (ritz > low) & (ritz < high) & (off <= exact)  # beyond the eigenspace, values inside are of noise
        if found.sum() == count:
            worst = off[found].max(initial=0.0)
            if worst > least / 2:  # as exact as it gets
                break
            best, least = (ritz[found], block[:, found]), worst
    if best is None:
        raise ArithmeticError(f"{count} eigenvalues counted in ({low}, {high}), not as many found")
    return best


def largest(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (all, if fewer), falling, and their orthonormal vectors as columns."""
    matrix = np.asarray(matrix, dtype=float)
    n, scale = len(matrix), float(np.abs(matrix).max(initial=0.0))
    if not n or not scale:
        return np.zeros(min(k, n)), np.eye(n)[:, :min(k, n)]
    matrix = (matrix + matrix.T) / (2 * scale)
    diagonal, off = tridiagonal(matrix)
    values, vectors = [], []
    for low, high, count in intervals(located(diagonal, off), k):
        counted = int(np.subtract(*below(diagonal, off, np.array([high, low]))))
        if counted != count:
            raise ArithmeticError(f"{counted} eigenvalues counted in ({low}, {high}), {count} located")
        found, columns = interval_pairs(matrix, low, high, count)
        values.append(found[::-1])
        vectors.append(columns[:, ::-1])
    return scale * np.concatenate(values)[:k], np.concatenate(vectors, axis=1)[:, :k]
