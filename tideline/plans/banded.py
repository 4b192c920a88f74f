"""Sparse rows and the block-tridiagonal system of long series.

Free values of all components are interleaved by time, so that penalties, residuals and splittings
couple near ones only; the few coefficients of bases come last as a dense border.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np

#: Rows and columns of a block, at least.
BLOCK = 64


class Rows:
    """A matrix of few entries a row: ``columns`` and ``values``, both (rows, entries)."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, size: int):
        self.columns, self.values, self.size = columns, values, size
        self.shape = (len(columns), size)

    @staticmethod
    def difference(n: int, order: int) -> Rows:
        """Differences of an order; order 0 is the identity."""
        stencil = np.array([(-1.0) ** (order - k) * comb(order, k) for k in range(order + 1)])
        count = max(n - order, 0)
        return Rows(np.arange(count)[:, None] + np.arange(order + 1), np.tile(stencil, (count, 1)), n)

    @staticmethod
    def dense(matrix: np.ndarray) -> Rows:
        return Rows(np.tile(np.arange(matrix.shape[1]), (len(matrix), 1)), np.asarray(matrix, float), matrix.shape[1])

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return (self.values * x[self.columns]).sum(1)

    def back(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns.ravel(), (self.values * z[:, None]).ravel(), self.size)

    def squares(self) -> np.ndarray:
        return np.bincount(self.columns.ravel(), (self.values**2).ravel(), self.size)

    def moved(self, places: np.ndarray, size: int) -> Rows:
        """The same rows over other columns."""
        return Rows(places[self.columns], self.values, size)

    def scaled(self, by: float | np.ndarray) -> Rows:
        return Rows(self.columns, self.values * (by if np.isscalar(by) else by[self.columns]), self.size)


def beside(parts: list[Rows]) -> Rows:
    """Rows with the entries of all ``parts``, which have as many rows and the same columns."""
    return Rows(np.concatenate([p.columns for p in parts], 1), np.concatenate([p.values for p in parts], 1), parts[0].size)


def _inverse_root(block: np.ndarray) -> np.ndarray:
    """R with ``R' R`` the inverse of a symmetric block; what rounding made negative counts as tiny."""
    try:
        return np.linalg.inv(np.linalg.cholesky(block))
    except np.linalg.LinAlgError:
        size, axes = np.linalg.eigh(block)
        return (axes / np.sqrt(np.maximum(size, 1e-16 * np.abs(size).max() + 1e-300))).T


class System:
    """``1/2 sum |Q v|^2`` and splittings ``K v`` for lists of rows ``Q`` and ``K``; the first ``free`` columns are banded."""

    def __init__(self, quadratic: list[Rows], split: list[Rows], size: int, free: int):
        self.size, self.free = size, free
        pen = sum((q.squares() for q in quadratic), np.zeros(size))
        # unit columns, so that one step size suits levels, slopes and coefficients
        self.unit = 1 / np.sqrt(np.maximum(pen + sum((k.squares() for k in split), np.zeros(size)), 1e-12))
        self.quadratic, self.split = [q.scaled(self.unit) for q in quadratic], [k.scaled(self.unit) for k in split]
        self.trace_pen = float(sum(q.squares().sum() for q in self.quadratic))
        self.trace_gram = float(sum(k.squares().sum() for k in self.split))
        entries = [r for r in (*self.quadratic, *self.split) if len(r.columns)]
        width = max((int(np.ptp(np.where(r.columns < free, r.columns, r.columns.min(1, keepdims=True)), axis=1).max()) for r in entries), default=1)
        self.block = max(BLOCK, width)
        self.ends = np.cumsum([k.shape[0] for k in split])

    def forward(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([k @ v for k in self.split])

    def back(self, z: np.ndarray) -> np.ndarray:
        return sum(k.back(p) for k, p in zip(self.split, np.split(z, self.ends[:-1]), strict=True))

    def penalty(self, v: np.ndarray) -> np.ndarray:
        return sum((q.back(q @ v) for q in self.quadratic), np.zeros(self.size))

    def factor(self, rho: float | np.ndarray, ridge: float) -> Callable[[np.ndarray], np.ndarray]:
        """Solves ``Q'Q + K' rho K + ridge`` by block elimination, the border by its Schur complement; ``rho``: one weight, or one a row."""
        b, free, p = self.block, self.free, self.size - self.free
        count = -(-free // b)
        near, below = np.zeros(count * b * b), np.zeros(count * b * b)
        border, corner = np.zeros(count * b * p), np.zeros(p * p)
        weights = [rho] * len(self.split) if np.isscalar(rho) else np.split(rho, self.ends[:-1])
        for rows, by in [(q, 1.0) for q in self.quadratic] + list(zip(self.split, weights, strict=True)):
            for c1, v1 in zip(rows.columns.T, rows.values.T, strict=True):
                for c2, v2 in zip(rows.columns.T, rows.values.T, strict=True):
                    value, in1, in2 = by * v1 * v2, c1 < free, c2 < free
                    same, next_ = in1 & in2 & (c1 // b == c2 // b), in1 & in2 & (c1 // b == c2 // b + 1)
                    for target, where, at in ((near, same, (c1 * b + c2 % b)), (below, next_, (c1 * b + c2 % b)), (border, in1 & ~in2, c1 * p + c2 - free), (corner, ~in1 & ~in2, (c1 - free) * p + c2 - free)):
                        if where.any():
                            target += np.bincount(at[where], value[where], len(target))
        near, below, border, corner = near.reshape(count, b, b), below.reshape(count, b, b), border.reshape(count * b, p), corner.reshape(p, p)
        diagonal = np.full(count * b, ridge)
        diagonal[free:] = 1.0
        near[:, np.arange(b), np.arange(b)] += diagonal.reshape(count, b)
        # roots of blocks, not inverses: their products with large weights would lose all digits
        inverse, carry = np.empty_like(near), np.zeros_like(near)
        for i in range(count):
            if i:
                carry[i] = below[i] @ inverse[i - 1].T
                near[i] -= carry[i] @ carry[i].T
            inverse[i] = _inverse_root(near[i])

        def banded(r: np.ndarray) -> np.ndarray:
            x = np.zeros((count * b, r.shape[1]))
            x[:free] = r
            x = x.reshape(count, b, -1)
            for i in range(count):
                x[i] = inverse[i] @ (x[i] - carry[i] @ x[i - 1] if i else x[i])
            for i in range(count - 1, -1, -1):
                x[i] = inverse[i].T @ (x[i] - carry[i + 1].T @ x[i + 1] if i < count - 1 else x[i])
            return x.reshape(count * b, -1)[:free]

        if not p:
            return lambda r: banded(r[:, None])[:, 0]
        border = border[:free]
        across = banded(border)
        schur = np.linalg.pinv(corner + ridge * np.eye(p) - border.T @ across, rcond=1e-13, hermitian=True)

        def bordered(r: np.ndarray) -> np.ndarray:
            x = banded(r[:free, None])[:, 0]
            low = schur @ (r[free:] - border.T @ x)
            return np.concatenate([x - across @ low, low])

        return bordered
