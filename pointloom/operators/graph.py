"""Neighbourhood graphs: edge features, neighbour maxima, sampling, interpolation, levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from . import knn
from .knn import knn_join


def edge_features(edges: DataFrame, points: DataFrame, columns: list[str], pid: str = "pid") -> DataFrame:
    """Each edge with ``<c>`` of its centre and ``d_<c>``, neighbour less centre."""
    a = points.select(F.col(pid).alias("src"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = points.select(F.col(pid).alias("dst"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = edges.join(a, "src").join(b, "dst")
    return both.select("src", "dst", *[F.col(f"_a_{c}").alias(c) for c in columns], *[(F.col(f"_b_{c}") - F.col(f"_a_{c}")).alias(f"d_{c}") for c in columns])


def neighbour_max(edges: DataFrame, points: DataFrame, columns: list[str], pid: str = "pid", direction: str = "center") -> DataFrame:
    """``<pid>, <c>, max_<c>``: largest difference over the edges of each point.

    'center' takes the point's own neighbours, 'reverse' the points that chose
    it; points without such edges get 0.
    """
    if direction not in ("center", "reverse"):
        raise ValueError(f"unknown direction {direction!r}")
    e = edges if direction == "center" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    most = edge_features(e, points, columns, pid).groupBy("src").agg(*[F.max(f"d_{c}").alias(f"max_{c}") for c in columns])
    out = points.select(F.col(pid), *columns).join(most.withColumnRenamed("src", pid), pid, "left")
    return out.select(pid, *columns, *[F.coalesce(f"max_{c}", F.lit(0)).alias(f"max_{c}") for c in columns])


def voxel_sample(points: DataFrame, scope: list[str], side, pid: str = "pid", coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One point per occupied voxel: the nearest to its centre, ties to the smaller id.

    Distances are in half sides, so whole coordinates and sides stay exact.
    """
    cells = [F.floor(F.col(c) / F.lit(side)).cast("long").alias(f"v{c}") for c in coords]
    cut = points.select("*", *cells)
    d2 = sum((2 * F.col(c) - (2 * F.col(f"v{c}") + 1) * F.lit(side)) * (2 * F.col(c) - (2 * F.col(f"v{c}") + 1) * F.lit(side)) for c in coords)
    best = cut.groupBy(*scope, *[f"v{c}" for c in coords]).agg(F.min(F.struct(d2.alias("d"), F.col(pid).alias("p"))).alias("_b"), F.count("*").alias("n"))
    return best.select(*scope, *[f"v{c}" for c in coords], F.col("_b.p").alias(pid), "n")


def take_sample(points: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the chosen points."""
    return points.join(chosen.select(*keys), keys, "left_semi")


def _farthest(x: np.ndarray, ratio: float) -> np.ndarray:
    """Row numbers of ceil(ratio * n) points, each the farthest from those before, from the first row on."""
    n = int(np.ceil(ratio * len(x)))
    chosen = np.zeros(n, np.int64)
    near = np.full(len(x), np.inf)
    for i in range(1, n):
        step = x - x[chosen[i - 1]]
        near = np.minimum(near, (step * step).sum(axis=1))
        chosen[i] = int(near.argmax())
    return chosen


def _whole_blocks(batches: Iterator[pa.RecordBatch], block: str, make: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted batches: ``make`` of rows and the places where blocks begin and end; a block that batches cut is put together."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        key = t.column(block).to_numpy()
        ends = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        if len(ends) > 1:
            yield make(t.slice(0, ends[-1]), ends)
        rest = t.slice(ends[-1])
    if rest is not None:
        yield make(rest, np.array([0, len(rest)]))


def farthest_points(blocks: DataFrame, block: str = "block_id", pid: str = "pid", ratio: float = 0.25, coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``(block, pid, rank)``: ceil(ratio * n) points per block, each the farthest from those before.

    Starts at the smallest id.  Blocks are of bounded size; they follow each
    other in sorted batches, and one that a batch cuts goes on to the next.
    """
    cols = list(coords)

    def whole(df: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        x = df[cols].to_numpy(np.float64)
        picked = [_farthest(x[i:j], ratio) for i, j in zip(ends, ends[1:], strict=False)]
        rows = np.concatenate([i + c for i, c in zip(ends, picked, strict=False)])
        return pd.DataFrame({block: df[block].to_numpy()[rows], pid: df[pid].to_numpy()[rows], "rank": np.concatenate([np.arange(1, len(c) + 1) for c in picked])})

    def run(batches):
        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            key = df[block].to_numpy()
            ends = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            if len(ends) > 1:
                yield whole(df, ends)
            rest = df.iloc[ends[-1] :]
        if rest is not None:
            yield whole(rest, np.array([0, len(rest)]))

    kinds = dict(blocks.dtypes)
    ordered = blocks.select(block, pid, *cols).repartition(block).sortWithinPartitions(block, pid)
    return ordered.mapInPandas(run, f"{block} {kinds[block]}, {pid} {kinds[pid]}, rank long")


def interpolate(edges: DataFrame, coarse: DataFrame, columns: list[str], pid: str = "pid") -> DataFrame:
    """Inverse-distance weighted mean of coarse values over each fine point's edges."""
    values = coarse.select(F.col(pid).alias("dst"), *columns)
    w = 1 / F.greatest(F.col("d2").cast("double"), F.lit(1e-16))
    near = edges.join(values, "dst").withColumn("_w", w)
    return near.groupBy(F.col("src").alias(pid)).agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in columns])


def skip_concat(fine: DataFrame, lifted: DataFrame, columns: list[str], pid: str = "pid", name: str = "features") -> DataFrame:
    """``(pid, features)``: fine values followed by the interpolated ones."""
    up = lifted.select(pid, *[F.col(c).alias(f"_u_{c}") for c in columns])
    both = fine.join(up, pid)
    return both.select(pid, F.concat(F.array(*[F.col(c).cast("double") for c in columns]), F.array(*[F.col(f"_u_{c}").cast("double") for c in columns])).alias(name))


def multiscale_features(points: DataFrame, columns: list[str], scope: list[str], sides: list[float], k: int = 20, k_up: int = 3, pid: str = "pid") -> DataFrame:
    """Own values and neighbour maxima at each level, coarse levels interpolated back.

    Level 0 is the cloud, each further level the voxel sample of the level
    before with the next side.  Columns come out as ``<c>``, ``l<i>_<c>``.
    """
    out = points.select(pid, *columns)
    level = points
    for i, side in enumerate([None, *sides]):
        if side is not None:
            level = take_sample(level, voxel_sample(level, scope, side, pid), [*scope, pid])
        at = knn.index(level, scope, pid)  # of this level, for both joins
        most = neighbour_max(knn_join(level, at, k, scope, pid, include_self=False), level, columns, pid)
        names = [f"l{i}_{c}" for c in columns]
        values = most.select(pid, *[F.col(f"max_{c}").cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
        lifted = values if side is None else interpolate(knn_join(points, at, k_up, scope, pid), values, names, pid)
        out = out.join(lifted, pid)
    return out


def chained_samples(blocks: DataFrame, levels: int = 3, block: str = "block_id", pid: str = "pid", ratio: float = 0.25) -> DataFrame:
    """``(block, pid, level, rank)``: farthest points of each block, then of those chosen, ``levels`` times over.

    Level 1 is sampled from the block, every further level from the one before.
    """
    found, level = None, blocks
    for i in range(1, levels + 1):
        chosen = written(farthest_points(level, block, pid, ratio), "sample")
        level = blocks.join(chosen.select(block, pid), [block, pid], "left_semi")
        part = chosen.select(block, pid, F.lit(i).alias("level"), "rank")
        found = part if found is None else found.unionByName(part)
    return found


def _levels(x: np.ndarray, values: np.ndarray, levels: int, k: int, k_up: int, ratio: float) -> np.ndarray:
    """Features of the points of a block, which come in the order of their ids."""

    def nearest(d: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(d, axis=1, kind="stable")[:, :n]  # equal distances in order of ids

    at, down = np.arange(len(x)), []
    for i in range(levels + 1):
        if i:
            keep = np.sort(_farthest(x[at], ratio))
            at, values = at[keep], values[keep]
        step = x[at][:, None] - x[at][None]
        d = (step * step).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        near = nearest(d, min(k, len(at) - 1))
        most = values[near].max(axis=1) - values if near.shape[1] else np.zeros_like(values)
        values = np.hstack([values, most])
        down.append((at, values))
    at, up = down.pop()
    for fine, own in reversed(down):
        step = x[fine][:, None] - x[at][None]
        d = (step * step).sum(axis=2)
        near = nearest(d, k_up)
        w = 1 / np.maximum(np.take_along_axis(d, near, axis=1), 1e-16)
        up = np.hstack([own, (w[:, :, None] * up[near]).sum(axis=1) / w.sum(axis=1)[:, None]])
        at = fine
    return up


def encode_decode(blocks: DataFrame, columns: list[str], block: str = "block_id", levels: int = 3, k: int = 20, k_up: int = 3, pid: str = "pid", ratio: float = 0.25, coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``(pid, features array)``: the way down the levels of every block and up again, with what each level adds.

    The levels are those of :func:`chained_samples`.  On the way down every
    level takes, next to its values, the neighbour maxima of its k nearest; its
    chosen points go on to the next level.  On the way up the values of a level
    are interpolated to the finer one from the ``k_up`` nearest and set beside
    that level's own.  Blocks are of bounded size and coordinates finite: a
    block is worked on as a whole, so nothing but its points is moved or written.
    """
    cols = [*coords, *columns]

    def make(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        all_ = np.stack([t.column(c).to_numpy() for c in cols], axis=1)
        x, values = all_[:, : len(coords)], all_[:, len(coords) :]
        made = np.concatenate([_levels(x[i:j], values[i:j], levels, k, k_up, ratio) for i, j in zip(ends, ends[1:], strict=False)])
        lists = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], made.ravel())
        return pa.RecordBatch.from_pydict({pid: t.column(pid).combine_chunks(), "features": lists})

    ordered = blocks.select(block, pid, *[F.col(c).cast("double").alias(c) for c in cols]).repartition(block).sortWithinPartitions(block, pid)
    return ordered.mapInArrow(lambda batches: _whole_blocks(batches, block, make), f"{pid} {dict(blocks.dtypes)[pid]}, features array<double>")
