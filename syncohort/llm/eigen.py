"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

A contour around an interval of the real line turns the resolvent (zI - V)^-1 into the
projector onto the eigenvectors inside. A few shifted solves apply it to a block of
vectors, Rayleigh-Ritz takes the pairs out of the block, and repetition sharpens them.
How many pairs must be inside is known beforehand from inertia: V - sI has as many positive
eigenvalues as its triangular factors have positive pivots (Sylvester).
"""

from __future__ import annotations

import numpy as np

#: Points of the half circle, rounds per interval, eigenvalues looked for in one interval.
POINTS, ROUNDS, INSIDE = 8, 30, 12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    left, size = matrix.astype(float), len(matrix)
    for k in range(size - 2):
        axis = left[k + 1 :, k].copy()
        axis[0] += np.copysign(np.sqrt(axis @ axis), axis[0])
        if norm := axis @ axis:
            part = left[k + 1 :, k + 1 :]
            turned = part @ axis * (2 / norm)
            turned -= axis * (axis @ turned / norm)
            part -= np.outer(axis, turned) + np.outer(turned, axis)
            left[k + 1, k] -= axis[0] * 2 * (axis @ left[k + 1 :, k]) / norm
    return np.diag(left).copy(), np.diag(left, -1).copy()


def above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Number of eigenvalues greater than `shift`: positive pivots of form - shift I.

    The tridiagonal form has the inertia of the matrix, being congruent to it.
    """
    diagonal, next_one = form
    tiny = 1e-300 + 1e-17 * (np.abs(diagonal).max() + np.abs(next_one).max(initial=0))
    positive, pivot = 0, 1.0
    for d, o in zip(diagonal.tolist(), [0.0, *next_one.tolist()]):
        pivot = d - shift - o * o / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        positive += pivot > 0
    return positive


def brackets(form: tuple[np.ndarray, np.ndarray], count: int, rounds: int = 30) -> np.ndarray:
    """(count, 2): lower and upper bound of each of the greatest eigenvalues, by bisection."""
    radius = np.abs(form[0]).max() + 2 * np.abs(form[1]).max(initial=0)
    radius = 1.001 * radius + 1e-300
    known = {-radius: len(form[0]), radius: 0}
    out = np.zeros((count, 2))
    for k in range(count):
        low = max(x for x, n in known.items() if n > k)
        high = min(x for x, n in known.items() if n <= k)
        for _ in range(rounds):
            middle = (low + high) / 2
            known[middle] = above(form, middle)
            low, high = (middle, high) if known[middle] > k else (low, middle)
        out[k] = low, high
    return out


def _intervals(bounds: np.ndarray, count: int, size: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down, that hold the first `count`.

    Limits lie in the middle of gaps. Of the gaps after at most INSIDE eigenvalues the
    widest is taken; eigenvalues without a gap between them stay together.
    """
    scale = max(abs(bounds).max(), 1e-300)
    # gap[k] separates the first k eigenvalues from the others
    gap = {k: bounds[k - 1, 0] - bounds[k, 1] for k in range(1, len(bounds))}
    if len(bounds) == size:
        gap[size] = scale
    out, start, top = [], 0, bounds[0, 1] + 0.05 * scale
    while start < count:
        usable = [k for k in gap if k > start and gap[k] > 1e-7 * scale]
        if not usable:
            break
        near = [k for k in usable if k <= start + INSIDE] or usable[:1]
        enough = [k for k in near if k >= count]
        end = max(enough or near, key=lambda k: (gap[k], k))
        low = bounds[-1, 0] - 0.05 * scale if end == size else (bounds[end - 1, 0] + bounds[end, 1]) / 2
        out.append((low, top, end - start))
        start, top = end, low
    return out


def feast(matrix: np.ndarray, low: float, high: float, inside: int, seed: int = 0):
    """The `inside` eigenpairs between `low` and `high`, greatest first.

    Raises ArithmeticError if the block does not settle on as many pairs as the inertia
    counts say.
    """
    size = len(matrix)
    width = min(size, inside + max(4, inside // 2))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    block = np.random.default_rng(seed).standard_normal((size, width))
    norm = np.abs(matrix).sum(1).max()
    best = None
    for _ in range(ROUNDS):
        image = np.zeros((size, width))
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((middle + turn) * np.eye(size) - matrix, block)
            image += weight / 2 * (turn * solved).real
        basis = np.linalg.qr(image)[0]
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ inner
        wanted = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(wanted) == inside:
            found = block[:, wanted]
            rest = np.abs(matrix @ found - found * values[wanted]).max()
            if best is not None and rest >= best[0] and best[0] < 1e-11 * norm:
                break
            if best is None or rest < best[0]:
                best = (rest, values[wanted], found)
            if rest < 1e-15 * norm or width == size:
                break
    if best is None or best[0] > 1e-9 * norm:
        raise ArithmeticError(f"{inside} eigenvalues between {low} and {high} were not found")
    return best[1], best[2]


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` greatest eigenvalues, falling, and unit eigenvectors as columns."""
    size = len(matrix)
    count = min(count, size)
    if not count:
        return np.zeros(0), np.zeros((size, 0))
    more = min(size, count + INSIDE)
    form = tridiagonal(matrix)
    while True:
        spans = _intervals(brackets(form, more), count, size)
        if sum(n for *_, n in spans) >= count:
            break
        more = min(size, 2 * more)  # a cluster of equal eigenvalues goes on
    pairs = [feast(matrix, *s) for s in spans]
    values = np.concatenate([v for v, _ in pairs])[:count]
    vectors = np.concatenate([x for _, x in pairs], axis=1)[:, :count]
    return values, vectors / np.sqrt((vectors**2).sum(0))
