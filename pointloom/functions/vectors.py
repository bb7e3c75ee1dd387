"""Column expressions for small dense algebra: eigenvalues, softmax, argmax, checks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither null, nor not-a-number, nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix, smallest first, in closed form.

    The trigonometric solution of the characteristic cubic; a matrix that is a
    multiple of the identity has three equal values.
    """
    q = (xx + yy + zz) / 3
    p2 = ((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6
    p = F.sqrt(p2)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    high = F.when(p2 > 0, q + 2 * p * F.cos(phi)).otherwise(q)
    low = F.when(p2 > 0, q + 2 * p * F.cos(phi + 2 * math.pi / 3)).otherwise(q)
    return low, 3 * q - high - low, high


def smallest_eigenvector(low: Column, high: Column, xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Unit eigenvector of eigenvalue ``low``, of either sign; nulls if it is not unique.

    Rows of the matrix less ``low`` on its diagonal are orthogonal to it; the
    longest cross product of two rows gives its direction.  It is as long as
    the product of the gaps to the other eigenvalues, so sets on a line, with
    no second gap to speak of, have no direction.
    """
    a, b, c = xx - low, yy - low, zz - low
    crosses = [
        (xy * yz - xz * b, xz * xy - a * yz, a * b - xy * xy),
        (xy * c - xz * yz, xz * xz - a * c, a * yz - xy * xz),
        (b * c - yz * yz, yz * xz - xy * c, xy * yz - b * xz),
    ]
    size = [x * x + y * y + z * z for x, y, z in crosses]
    most = F.greatest(*size)
    pick = lambda i: F.when(most <= 1e-12 * high * high * high * high, None).when(size[0] == most, crosses[0][i]).when(size[1] == most, crosses[1][i]).otherwise(crosses[2][i])
    return tuple(pick(i) / F.sqrt(most) for i in range(3))


def outer_eigenvalues(xx: np.ndarray, yy: np.ndarray, zz: np.ndarray, xy: np.ndarray, xz: np.ndarray, yz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest of :func:`eigenvalues` of a batch of matrices, by the same formulas."""
    with np.errstate(all="ignore"):
        q = (xx + yy + zz) / 3
        p2 = ((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6
        p = np.sqrt(p2)
        a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
        d, e, f = xy / p, xz / p, yz / p
        det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
        phi = np.arccos(np.fmax(-1.0, np.fmin(1.0, det / 2))) / 3
        high = np.where(p2 > 0, q + 2 * p * np.cos(phi), q)
        return np.where(p2 > 0, q + 2 * p * np.cos(phi + 2 * math.pi / 3), q), high


def smallest_eigenvectors(xx: np.ndarray, yy: np.ndarray, zz: np.ndarray, xy: np.ndarray, xz: np.ndarray, yz: np.ndarray) -> np.ndarray:
    """:func:`smallest_eigenvector` of a batch of matrices, a row each, by the same formulas; not-a-number if not unique."""
    low, high = outer_eigenvalues(xx, yy, zz, xy, xz, yz)
    with np.errstate(all="ignore"):
        a, b, c = xx - low, yy - low, zz - low
        crosses = np.stack(
            [
                np.stack([xy * yz - xz * b, xz * xy - a * yz, a * b - xy * xy], axis=-1),
                np.stack([xy * c - xz * yz, xz * xz - a * c, a * yz - xy * xz], axis=-1),
                np.stack([b * c - yz * yz, yz * xz - xy * c, xy * yz - b * xz], axis=-1),
            ]
        )
        size = (crosses * crosses).sum(axis=-1)
        pick = size.argmax(axis=0)
        rows = np.arange(len(xx))
        most = size[pick, rows]
        out = crosses[pick, rows] / np.sqrt(most)[:, None]
        return np.where((most > 1e-12 * high * high * high * high)[:, None], out, np.nan)


def log_softmax(scores: Column) -> Column:
    """Logarithm of the softmax of an array, stable for large scores."""
    top = F.array_max(scores)
    total = F.log(F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(scores, lambda v: v - top - total)


def argmax(scores: Column) -> Column:
    """Number, from 0, of the first largest element; null for null or empty arrays."""
    return F.nullif(F.array_position(scores, F.array_max(scores)), F.lit(0)).cast("int") - 1

