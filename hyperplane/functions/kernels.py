"""Kernels: one definition with three backends, a Column expression, DuckDB SQL for the oracle, and NumPy blocks, dense or sparse.

Chi-square kernels are for non-negative vectors; a place where both are zero adds nothing.

Operators take any object with ``block(x, z)``, the values of all rows of x
against all of z; those that work on columns also call ``expr(x, z, sparse)``.  Own
kernels are classes with these, or ``Custom``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sparse import SparseRows
from .vectors import common, dot, self_dot, value_sum, values

#: Cells of the tables that dense chi-square blocks go through; some of them stay in a core's cache.
TILE = 1 << 13
#: Added to sums of values, so that a place where both are zero gives 0 / TINY; no other sum of values is changed by it.
TINY = 1e-300


def _ratio(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """u v / (u + v), 0 where the sum is 0."""
    total = u + v
    return np.divide(u * v, total, out=np.zeros_like(total), where=total != 0)


def _chi2_blocks(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sum over features of u v / (u + v), a feature at a time over tiles that stay in cache."""
    out = np.zeros((len(x), len(z)))
    if not out.size:
        return out
    if min(x.min(initial=0), z.min(initial=0)) < 0:
        for k in range(x.shape[1]):
            out += _ratio(x[:, k, None], z[None, :, k])
        return out
    lines, above = np.ascontiguousarray(z.T), np.ascontiguousarray(z.T) + TINY
    step = max(1, TILE // len(z))
    ratio, total = np.empty((2, step, len(z)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        r, t, o = ratio[: len(part)], total[: len(part)], out[a : a + step]
        for k in range(x.shape[1]):
            u = part[:, k, None]
            np.add(u, above[k], out=t)
            np.multiply(u, lines[k], out=r)
            np.divide(r, t, out=r)
            np.add(o, r, out=o)
    return out


@dataclass(frozen=True)
class Kernel:
    """A similarity of two vectors.  ``name`` is one of linear, rbf, poly, chi2, nchi2, expchi2."""

    name: str
    gamma: float = 0.5
    degree: float = 2.0
    coef: float = 1.0

    @property
    def histogram(self) -> bool:
        return self.name in ("chi2", "nchi2", "expchi2")

    def expr(self, x: Column, z: Column, sparse: bool = False) -> Column:
        """The kernel of two columns of arrays of doubles, or of arrays of (idx, val)."""
        if sparse:
            return self._sparse_expr(x, z)
        over = lambda f: F.aggregate(F.zip_with(x, z, lambda u, v: F.when(u + v == 0, F.lit(0.0)).otherwise(f(u, v) / (u + v))), F.lit(0.0), lambda a, v: a + v)
        if self.name == "nchi2":
            return over(lambda u, v: u * v)
        if self.histogram:
            return self._of_distance(over(lambda u, v: (u - v) * (u - v)))
        return self._of_products(dot(x, z), self_dot(x), self_dot(z))

    def _sparse_expr(self, x: Column, z: Column) -> Column:
        if not self.histogram:
            return self._of_products(common(x, z, lambda u, v: u * v), self_dot(values(x)), self_dot(values(z)))
        ratio = common(x, z, lambda u, v: F.when(u + v == 0, F.lit(0.0)).otherwise(u * v / (u + v)))
        # (u - v)**2 / (u + v) = u + v - 4 u v / (u + v)
        return ratio if self.name == "nchi2" else self._of_distance(value_sum(values(x)) + value_sum(values(z)) - 4 * ratio)

    def _of_products(self, xz: Column, xx: Column, zz: Column) -> Column:
        if self.name == "linear":
            return xz
        if self.name == "poly":
            return F.pow(self.gamma * xz + self.coef, F.lit(self.degree))
        # greatest() passes over nulls, which null vectors give.
        return F.when(xz.isNotNull(), F.exp(-self.gamma * F.greatest(F.lit(0.0), xx + zz - 2 * xz)))

    def _of_distance(self, distance: Column) -> Column:
        return 1 - 0.5 * distance if self.name == "chi2" else F.exp(-self.gamma * distance)

    def sql(self, x: str, z: str) -> str:
        """The kernel of two DuckDB list expressions."""
        over = lambda f: f"list_sum(list_transform(list_zip({x}, {z}), lambda p: CASE WHEN p[1] + p[2] = 0 THEN 0::double ELSE {f} / (p[1] + p[2]) END))"
        if self.name == "linear":
            return f"list_dot_product({x}, {z})"
        if self.name == "rbf":
            return f"exp(-{self.gamma}::double * greatest(0::double, list_dot_product({x}, {x}) + list_dot_product({z}, {z}) - 2 * list_dot_product({x}, {z})))"
        if self.name == "poly":
            return f"pow({self.gamma}::double * list_dot_product({x}, {z}) + {self.coef}::double, {self.degree}::double)"
        if self.name == "nchi2":
            return over("(p[1] * p[2])")
        distance = over("((p[1] - p[2]) * (p[1] - p[2]))")
        return f"(1 - 0.5::double * {distance})" if self.name == "chi2" else f"exp(-{self.gamma}::double * {distance})"

    def block(self, x: np.ndarray | SparseRows, z: np.ndarray | SparseRows, squares: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Kernel values of all rows of x against all rows of z; ``squares`` are their ``squared`` where these are known.  Holds two
        blocks at a time."""
        sparse = isinstance(x, SparseRows)
        if self.histogram:
            dense = x.dense_common(z) if sparse else (x, z)
            ratio = x.common(z, _ratio) if dense is None else _chi2_blocks(*dense)
            if self.name == "nchi2":
                return ratio
            # (u - v)**2 / (u + v) = u + v - 4 u v / (u + v)
            sums = [m.sums() if sparse else m.sum(1) for m in (x, z)]
            out = sums[0][:, None] + sums[1][None, :]
            ratio *= 4
            out -= ratio
            out *= 0.5 if self.name == "chi2" else -self.gamma
            return np.subtract(1, out, out=out) if self.name == "chi2" else np.exp(out, out=out)
        products = x.common(z) if sparse else x @ z.T
        if self.name == "linear":
            return products
        if self.name == "poly":
            products *= self.gamma
            products += self.coef
            products **= self.degree
            return products
        of_x, of_z = squares or (squared(x), squared(z))
        out = of_x[:, None] + of_z[None, :]
        products *= 2
        out -= products
        np.maximum(out, 0, out=out)
        out *= -self.gamma
        return np.exp(out, out=out)


def squared(x: np.ndarray | SparseRows) -> np.ndarray:
    """Squared norms of rows."""
    return x.squares() if isinstance(x, SparseRows) else (x * x).sum(1)


@dataclass(frozen=True)
class Custom:
    """A kernel of one's own: ``of`` gives the values of a block of rows against another, ``column`` those of two columns."""

    of: Callable[[np.ndarray, np.ndarray], np.ndarray]
    column: Callable[[Column, Column], Column] | None = None

    def block(self, x: np.ndarray | SparseRows, z: np.ndarray | SparseRows) -> np.ndarray:
        return self.of(x, z)

    def expr(self, x: Column, z: Column, sparse: bool = False) -> Column:
        if self.column is None:
            raise ValueError("this kernel has no form for columns")
        return self.column(x, z)


@dataclass(frozen=True)
class Mahalanobis:
    """x' M z with a full matrix M, the inverse of a covariance."""

    inverse: tuple[tuple[float, ...], ...]

    def block(self, x: np.ndarray | SparseRows, z: np.ndarray | SparseRows) -> np.ndarray:
        m = np.array(self.inverse)
        x, z = (v.dense(len(m)) if isinstance(v, SparseRows) else v for v in (x, z))
        return premultiplied(x, m) @ z.T

    def expr(self, x: Column, z: Column, sparse: bool = False) -> Column:
        if sparse:
            raise ValueError("a full matrix takes dense columns; blocks take sparse rows as well")
        rows = F.array(*[F.array(*map(F.lit, r)) for r in self.inverse])
        return dot(x, F.transform(rows, lambda r: dot(r, z)))


@dataclass(frozen=True)
class Frobenius:
    """Sum of products of two matrices, given as arrays of rows.  Blocks and solvers ask for one shape; columns give null where shapes differ."""

    def block(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        if x.shape[1] != z.shape[1]:
            raise ValueError("matrices of different shapes")
        return x @ z.T

    def expr(self, x: Column, z: Column, sparse: bool = False) -> Column:
        return frobenius(x, z)


LINEAR, RBF, POLY = Kernel("linear"), Kernel("rbf"), Kernel("poly")
CHI2, NCHI2, EXPCHI2 = Kernel("chi2"), Kernel("nchi2"), Kernel("expchi2")
ALL = (LINEAR, RBF, POLY, CHI2, NCHI2, EXPCHI2)


def kernel_of(name: str, gamma: float = 0.5, degree: float = 2.0, coef: float = 1.0) -> Kernel:
    """The kernel of a name, with its parameters."""
    if name not in {k.name for k in ALL}:
        raise ValueError(f"no kernel {name!r}")
    return Kernel(name, gamma, degree, coef)


def mahalanobis(x: Column, z: Column, inverse_diagonal: Column) -> Column:
    """x' D z for a diagonal inverse covariance; a full one pre-multiplies the rows (``premultiplied``)."""
    return dot(F.zip_with(x, inverse_diagonal, lambda u, d: u * d), z)


def premultiplied(rows: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Rows times the inverse covariance: their linear kernel with plain rows is the Mahalanobis kernel."""
    return rows @ inverse


def frobenius(a: Column, b: Column) -> Column:
    """Sum of products of two matrices given as arrays of rows; null if shapes differ."""
    same = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda u, v: F.size(u) == F.size(v)), lambda ok: ok)
    return F.when(same, dot(F.flatten(a), F.flatten(b)))
