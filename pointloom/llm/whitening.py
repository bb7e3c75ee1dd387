"""Embedding whitening from distinct integer vectors.

Equal vectors are grouped once; the count of a group, or one, is its weight in
the fit.  Sums per dimension are whole numbers.  The covariance is a weighted
matrix product of centred vectors, one partial product a task, added up by
Spark; only matrices of dimension x dimension reach the driver.  Every distinct
vector is centred and projected once, and the result is joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import evenly, materialise

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no exact x; such a row is treated like one with an infinite entry.
LARGEST = float(1 << 52) / SCALE
#: A direction with less than this share of the total variance is rounding, not a component.
LEAST_SHARE = 1e-13


class Component(NamedTuple):
    """The whitening of the vectors of one length."""

    n: int
    sums: list[int]
    directions: np.ndarray  # one column per component, divided by the root of its eigenvalue
    explained: list[float]


def whole_vector(vector: Column) -> Column:
    """The entries as whole numbers x; null where an entry is null, not finite or too large."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return F.when(~bad, F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _rows(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    width = np.array([len(v) for v in vectors], np.int64)
    out = {}
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        out[w] = at, np.stack([np.asarray(vectors.iloc[i]) for i in at])
    return out


def sums(table: DataFrame, column: str, weight: str, kind: str) -> dict[int, tuple[int, list]]:
    """Total weight and sum per dimension of the vectors of each length.

    ``kind`` is ``decimal(38,0)`` for whole numbers, whose sums are exact, or ``double``.
    """
    at = F.posexplode(F.col(column)).alias("i", "c")
    per = table.select(F.size(column).alias("w"), F.col(weight).alias("k"), at)
    per = per.groupBy("w", "i").agg(F.sum("k").alias("n"), F.sum(F.col("c").cast(kind) * F.col("k").cast(kind)).alias("s"))
    out: dict[int, tuple[int, list]] = {}
    for r in per.orderBy("w", "i").collect():  # a row for each dimension
        out.setdefault(r.w, (int(r.n), []))[1].append(int(r.s) if kind.startswith("decimal") else r.s)
    return out


def _centred(x: np.ndarray, n: int, total: list) -> np.ndarray:
    """x less the mean total / n; whole numbers are taken apart so that nothing is lost."""
    if x.dtype.kind == "f":
        return x - np.array(total) / n
    whole = np.array([s // n for s in total], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in total])


def covariance(table: DataFrame, column: str, weight: str, of: dict[int, tuple[int, list]]) -> dict[int, np.ndarray]:
    """Covariance of the vectors of each length, divisor n; ``of`` comes from :func:`sums`."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for df in batches:
            k = df["k"].to_numpy(np.float64)
            for w, (at, x) in _rows(df["x"]).items():
                c = _centred(x, *of[w])
                total[w] = total.get(w, 0) + c.T @ (c * k[at][:, None])
        for w, m in total.items():
            yield pd.DataFrame({"w": w, "i": np.arange(w), "row": list(m)})

    parts = table.select(F.col(column).alias("x"), F.col(weight).alias("k")).mapInPandas(products, "w int, i int, row array<double>")
    summed = parts.select("w", "i", F.posexplode("row").alias("j", "v")).groupBy("w", "i", "j").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("w", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("w", "i", F.col("r.v").alias("v"))
    out = {w: np.zeros((w, w)) for w in of}
    for r in rows.collect():  # dimension x dimension numbers
        out[r.w][r.i] = r.v
    return {w: (m + m.T) / 2 / of[w][0] for w, m in out.items()}


def fit(distinct: DataFrame, weight: str, most: int) -> dict[int, Component]:
    """Components of the vectors of each length, by falling eigenvalue."""
    total = sums(distinct, "x", weight, "decimal(38,0)")
    out = {}
    for w, v in covariance(distinct, "x", weight, total).items():
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        trace = float(np.trace(v))
        keep = [k for k in range(min(most, w)) if trace > 0 and e[k] > LEAST_SHARE * trace]
        # of the two directions of an eigenvector the one whose largest entry is positive
        u = u[:, keep] * np.sign(u[np.abs(u[:, keep]).argmax(axis=0), keep])
        out[w] = Component(*total[w], u / np.sqrt(e[keep]), (e[keep] / trace).tolist())
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, by_count: bool = False) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` per row and component.

    Rows whose vector is null or holds null, non-finite or huge entries (from
    2**46 on, which have no exact x) are dropped; other rows are kept, also
    with null or repeated keys.  Each distinct x vector weighs one in the fit,
    or as many as it has rows with ``by_count``; ``n`` is the total weight.
    ``deviation`` is exact, and null where it has no place in a long.
    Directions without variance are no components: a table of one distinct
    vector, or an empty one, gives no rows, and so do vectors without entries.
    Vectors of different lengths are fitted by themselves.  What the driver
    gets has the size of a covariance matrix, whatever the number of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key), whole_vector(F.col(vector)).alias("x")).where(F.size("x") > 0)
    groups = rows.groupBy("x").agg(F.count("*").alias("copies"))
    distinct = materialise(groups.select("x", F.col("copies").alias("k") if by_count else F.lit(1).cast("long").alias("k")), "distinct-vectors")
    model = fit(distinct, "k", components)
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for w, (at, x) in _rows(df["x"]).items():
                m = shared.value[w]
                far = max(abs(m.n * int(v) - s) for v, s in zip([*x.max(axis=0), *x.min(axis=0)], m.sums * 2, strict=True))
                whole = np.int64 if far < 1 << 62 and far * far * w < 1 << 62 else object  # Python's numbers beyond 64 bits
                d = m.n * x.astype(whole) - np.array(m.sums, whole)
                deviation = [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]
                z = _centred(x, m.n, m.sums) @ m.directions
                yield pd.DataFrame({"x": df["x"].iloc[at], "k": df["k"].iloc[at], "deviation": pd.array(deviation, "Int64"), "z": list(z)})

    white = materialise(distinct.mapInPandas(project, "x array<long>, k long, deviation long, z array<double>"), "whitened")
    # the vectors of each length are checked by themselves, as they were fitted
    about = []
    for w, m in model.items():
        mine = white.where(F.size("x") == w)
        k = len(m.explained)
        error = float(np.abs(covariance(mine, "z", "k", sums(mine, "z", "k", "double"))[k] - np.eye(k)).max()) if k else 0.0
        about.append((w, m.n, m.explained, error))
    named = spark.createDataFrame(about, "w int, n long, explained array<double>, identity_error double")
    per = white.select("x", "deviation", "z", F.size("x").alias("w")).join(F.broadcast(named), "w").select("x", "n", "deviation", F.arrays_zip("z", "explained").alias("c"), "identity_error")
    out = rows.join(evenly(per), "x").select(key, F.posexplode("c").alias("_i", "_c"), "n", "deviation", "identity_error")
    return out.select(key, (F.col("_i") + 1).cast("int").alias("component"), "n", "deviation", F.col("_c.z").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")
