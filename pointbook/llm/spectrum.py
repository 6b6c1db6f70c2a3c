"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

An LDLᵀ factorisation of the matrix less a shift has as many negative pivots
as there are eigenvalues below the shift (the law of inertia). Such counts
bisect each leading eigenvalue into an interval of its own; Rayleigh quotient
iteration, solving with the same factors, then converges cubically, and counts
just above and below the result certify that it has the number it claims.
Eigenvalues that no interval can part (closer than rounding) get orthogonal
vectors of their common space.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps

# The pivoting constant (1 + sqrt(17)) / 8 that bounds the factors' growth.
GROWTH = (1 + 17 ** 0.5) / 8


class Factors:
    """P A Pᵀ = L D Lᵀ with pivots of one or two rows."""

    def __init__(self, a: np.ndarray):
        a = np.array(a, float)
        n = len(a)
        self.order, self.low, self.pivots = np.arange(n), np.eye(n), []
        tiny = EPS * max(np.abs(a).max(initial=0), np.finfo(float).tiny / EPS)
        k = 0
        while k < n:
            column = np.abs(a[k + 1:, k])
            most = column.max(initial=0)
            size = 1
            if most > 0 and abs(a[k, k]) < GROWTH * most:
                r = k + 1 + int(column.argmax())
                off = max(np.abs(a[r, k:r]).max(initial=0), np.abs(a[r + 1:, r]).max(initial=0))
                if abs(a[k, k]) * off >= GROWTH * most ** 2:
                    pass
                elif abs(a[r, r]) >= GROWTH * off:
                    self._swap(a, k, r, k)
                else:
                    size = 2
                    self._swap(a, k + 1, r, k)
            d = a[k:k + size, k:k + size].copy()
            if size == 1 and abs(d[0, 0]) < tiny:
                d[0, 0] = tiny if d[0, 0] >= 0 else -tiny  # a singular pivot: the shift is an eigenvalue to rounding
            self.pivots.append((k, d))
            rest = slice(k + size, n)
            col = a[rest, k:k + size]
            part = np.linalg.solve(d, col.T).T
            self.low[rest, k:k + size] = part
            a[rest, rest] -= part @ col.T
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int, done: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.low[[i, j], :done] = self.low[[j, i], :done]
            self.order[[i, j]] = self.order[[j, i]]

    def negative(self) -> int:
        """The number of negative eigenvalues (a pivot of two rows has one of either sign)."""
        return sum(int(d[0, 0] < 0) if len(d) == 1 else int((np.linalg.eigvalsh(d) < 0).sum()) for _, d in self.pivots)

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.order].astype(float)
        n = len(y)
        for k in range(n):
            y[k + 1:] -= self.low[k + 1:, k] * y[k]
        for k, d in self.pivots:
            y[k:k + len(d)] = np.linalg.solve(d, y[k:k + len(d)])
        for k in range(n - 1, -1, -1):
            y[k] -= self.low[k + 1:, k] @ y[k + 1:]
        x = np.empty(n)
        x[self.order] = y
        return x


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` exceed ``shift``."""
    return len(a) - Factors(a - shift * np.eye(len(a))).negative()


class NotCertified(ArithmeticError):
    """Inertia counts contradict an eigenvalue's number."""


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the ``k`` largest eigenvalues, falling; fewer where the matrix has
    fewer that are positive beyond rounding."""
    n = len(a)
    scale = float(np.abs(a).sum(1).max(initial=0))  # no eigenvalue is larger
    if n == 0 or scale == 0:
        return np.zeros(0), np.zeros((0, n))
    a = np.asarray(a, float) / scale
    none = 4 * n * EPS
    values, vectors = [], []
    for nth in range(1, min(k, above(a, none)) + 1):
        low, high = none, 1 + none
        n_low, n_high = above(a, low), 0
        # until the interval holds this eigenvalue alone, and is small beside its distance from the others
        spare = 8
        while high - low > 64 * EPS and (not (n_low == nth and n_high == nth - 1) or spare > 0):
            if n_low == nth and n_high == nth - 1:
                spare -= 1
            mid = (low + high) / 2
            c = above(a, mid)
            low, n_low, high, n_high = (mid, c, high, n_high) if c >= nth else (low, n_low, mid, c)
        x = _orthogonal(np.random.RandomState(nth).standard_normal(n), vectors)
        shift = Factors(a - (low + high) / 2 * np.eye(n))
        for _ in range(3):
            x = _orthogonal(shift.solve(x), vectors)
        rho, rest = _quotient(a, x)
        for _ in range(12):
            y = _orthogonal(Factors(a - rho * np.eye(n)).solve(x), vectors)
            rho_y, rest_y = _quotient(a, y)
            if rest_y >= rest and rest < 1e-10 or not low - 64 * EPS <= rho_y <= high + 64 * EPS:
                break
            x, rho, rest = y, rho_y, rest_y
        margin = 4 * rest + 16 * n * EPS
        if above(a, rho - margin) < nth or above(a, rho + margin) >= nth:
            raise NotCertified(f"eigenvalue {nth}")
        values.append(rho * scale)
        vectors.append(x)
    return np.array(values), np.array(vectors).reshape(len(values), n)


def _quotient(a: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Rayleigh quotient and the length of the residual."""
    ax = a @ x
    rho = float(x @ ax)
    return rho, float(np.linalg.norm(ax - rho * x))


def _orthogonal(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    x = x / np.abs(x).max()
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
        x = x / np.linalg.norm(x)
    return x
