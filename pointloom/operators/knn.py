"""Exact nearest-neighbour joins on tiles.

Every scope is cut into tiles of about ``per_tile`` candidates at its mean
density.  A query looks at the candidates of its tile and of a halo around it,
as wide as the search radius, in dense blocks of bounded size.  Many tiles are
packed into one call of Python, so scopes of a few points cost little.

The first radius holds some three times k candidates on average; queries that
do not find k go to a further pass with a wider one.  ``radius_knn`` stops at
its radius, and starts there where points are few.  A tile much denser than its scope becomes a scope of its own,
with a grid that fits it (:func:`_rounds` calls itself), so a cluster in a wide
room is searched at its own density.  Small scopes are one tile.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.shared import release, written
from ..functions.vectors import finite

XYZ = ("x", "y", "z")
EDGE = "src long, dst long, d2 double, rn int"
PAIRS = ["xx", "yy", "zz", "xy", "xz", "yz"]
MOMENTS = ["n", "n_r", *[f"{c}{r}" for c in ("mx", "my", "mz", *PAIRS) for r in ("", "_r")], "near"]
#: Most distances that a task holds at once.
AT_ONCE = 2_000_000
#: Queries of a tile that are compared with the candidates around them together.
TOGETHER = 96
#: Bits of the number of a cell along an axis, and the most cells that a scope has along one.
BITS, CELLS = 21, 2**19


def top_k(pairs: DataFrame, k: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Keep the k nearest of each source, ranked by distance, then by id."""
    w = Window.partitionBy(src).orderBy("d2", dst)
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def _plain(points: DataFrame, scope: list[str], pid: str, coords: tuple[str, ...]) -> DataFrame:
    """Scope columns, ``id`` and ``p0 ...`` of the points whose coordinates are finite."""
    out = points.select(*scope, F.col(pid).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(coords)])
    return out.where(reduce(Column.__and__, [finite(F.col(f"p{i}")) for i in range(len(coords))]))


def _ends(points: DataFrame, scope: list[str], n: int, low: str, high: str) -> DataFrame:
    """Per scope: number of points ``k`` and the corners of their box, ``<low><i>`` and ``<high><i>``."""
    return points.groupBy(*scope).agg(F.count("*").alias("k"), *[x for i in range(n) for x in (F.min(f"p{i}").alias(f"{low}{i}"), F.max(f"p{i}").alias(f"{high}{i}"))])


@dataclass(frozen=True)
class Index:
    """Candidates written once for several joins: numbered by scope, with the size and the box of every scope."""

    scope: list[str]
    pid: str
    coords: tuple[str, ...]
    scopes: DataFrame
    points: DataFrame

    def release(self) -> None:
        release(self.scopes, self.points)


def index(points: DataFrame, scope: list[str], pid: str = "pid", coords: tuple[str, ...] = XYZ) -> Index:
    """Write the points of an :class:`Index`; :func:`knn_join` and the others take it in place of candidates."""
    c, n = _plain(points, scope, pid, coords), len(coords)
    scopes = written(_ends(c, scope, n, "a", "b").withColumn("s", F.monotonically_increasing_id()), "scopes")
    return Index(scope, pid, coords, scopes, written(c.join(scopes.select(*scope, "s"), scope).select("s", "id", *[f"p{i}" for i in range(n)]), "candidates"))


def _grid(q: DataFrame, ends: DataFrame, scope: list[str], n: int, k: int, per_tile: int, limit: str | None = None, radius: float | None = None) -> DataFrame:
    """Per scope of queries and of candidates (``ends``): corner ``l<i>``, first radius ``r0``, tile side ``side`` and last radius ``reach``.

    ``reach`` leads from anywhere to anywhere in the scope, or is the largest
    value of column ``limit`` of its queries, or ``radius``.
    """
    axes = range(n)
    both = ends.join(_ends(q, scope, n, "qa", "qb").withColumnRenamed("k", "asked"), scope)
    if limit:
        both = both.join(q.groupBy(*scope).agg(F.max(limit).alias("reach")), scope)
    span = [F.greatest(f"b{i}", f"qb{i}") - F.least(f"a{i}", f"qa{i}") for i in axes]
    both = both.withColumn("far", F.greatest(*span, F.lit(1e-9)) * float(np.sqrt(n)) * 1.0001)
    # flat clouds: a side counts at least a hundredth of the longest one
    longest = F.greatest(*[F.col(f"b{i}") - F.col(f"a{i}") for i in axes], F.lit(1e-9))
    volume = reduce(lambda a, b: a * b, [F.greatest(F.col(f"b{i}") - F.col(f"a{i}"), longest / 100) for i in axes])
    both = both.withColumn("r0", F.pow(volume * (k + 1) * 0.7 / F.col("k"), F.lit(1.0 / n))).withColumn("side", F.pow(volume * per_tile / F.col("k"), F.lit(1.0 / n)))
    if radius is not None:
        both = both.withColumn("reach", F.lit(float(radius))).withColumn("side", F.least("side", F.lit(64.0 * radius)))
    if limit or radius is not None:
        both = both.withColumn("r0", F.least("r0", "reach"))
    else:  # a small scope is one tile
        both = both.withColumn("reach", F.col("far")).withColumn("r0", F.when(F.col("k") <= 2 * per_tile, F.col("far")).otherwise(F.col("r0")))
    return both.select(*scope, *[F.least(f"a{i}", f"qa{i}").alias(f"l{i}") for i in axes], "r0", F.greatest(F.col("side"), 2 * F.col("r0"), F.col("far") / CELLS).alias("side"), "reach", "k", "asked")


def _rounds(q: DataFrame, c: DataFrame, grid: DataFrame, n: int, k: int, include_self: bool, per_tile: int, final: bool, depth: int = 0, within: Within | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """Edges, or with ``within`` moments (:func:`knn_moments`), and the queries without k candidates within ``reach``.

    ``q`` and ``c`` have a scope number ``s``, ``id`` and ``p<i>``.  With
    ``final`` everything within ``reach`` is all there is, and no query is left;
    without, what is still open after some rounds is left to the caller, whose
    radius is wider.  The few queries of later rounds are far from others, so
    the radius grows faster then.
    """
    axes, done, factor, gave_up = range(n), [], 1.0, None
    spark, schema = q.sparkSession, EDGE if within is None else within.schema
    keys, xyz = ["s", "cell"], [f"p{i}" for i in axes]
    cell = reduce(lambda a, b: a * (1 << BITS) + b, [F.col(f"c{i}") + 1 for i in axes]).alias("cell")
    while True:
        r = F.least(F.col("r0") * F.lit(factor), F.col("reach"))
        g = grid.select("s", *[f"l{i}" for i in axes], r.alias("r"), F.greatest(F.col("side"), r).alias("w"), ((r >= F.col("reach")) | F.lit(not final and factor >= 8)).alias("last"))
        asked = q.join(g, "s").withColumns({f"c{i}": F.floor((F.col(f"p{i}") - F.col(f"l{i}")) / F.col("w")).cast("long") for i in axes})
        asked = asked.select("s", cell, "id", *xyz, "r", "last")
        held = c.join(g, "s")
        halo = F.col("r") * 1.000001
        for i in axes:
            at = F.col(f"p{i}") - F.col(f"l{i}")
            held = held.withColumn(f"c{i}", F.explode(F.sequence(F.floor((at - halo) / F.col("w")).cast("long"), F.floor((at + halo) / F.col("w")).cast("long"))))
        # cells outside the box of the scope hold no query, and their numbers are not told apart
        held = held.where(reduce(Column.__and__, [(F.col(f"c{i}") >= 0) & (F.col(f"c{i}") < (1 << BITS) - 2) for i in axes])).select("s", cell, "id", *xyz)
        # tiles with queries: how many, and how many candidates
        where = written(asked.groupBy(*keys).agg(F.count("*").alias("asked"), F.max("r").alias("r")), "asked")
        tiles = where.join(held.join(where.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("held")), keys, "left").withColumn("held", F.coalesce("held", F.lit(0)))
        dense = F.lit(factor == 1.0 and depth < 12) & (F.col("held") > 8 * per_tile) & (F.col("asked") > 2 * per_tile)
        tiles = written(tiles.withColumn("dense", dense).withColumn("shares", F.ceil(F.col("asked") / F.lit(4 * per_tile)).cast("int")).withColumn("own", F.monotonically_increasing_id()), "tiles")
        total = tiles.agg(F.sum(F.col("asked") + F.col("held") * F.col("shares")).alias("rows"), F.sum("shares").alias("units"), F.max("dense").alias("dense")).first()
        release(where)
        still = []
        if total.dense:
            own = tiles.where("dense").select(*keys, "own", F.col("r").alias("most"))
            inner_q = written(asked.join(own, keys).select(F.col("own").alias("s"), "id", *xyz, "most"), "dense-queries")
            inner_c = written(held.join(own, keys).select(F.col("own").alias("s"), "id", *xyz), "dense-candidates")
            inner = written(_grid(inner_q, _ends(inner_c, ["s"], n, "a", "b"), ["s"], n, k, per_tile, "most"), "inner-grid")
            edges, left = _rounds(inner_q.drop("most"), inner_c, inner, n, k, include_self, per_tile, False, depth + 1, within)
            done += edges
            still += [left] if left is not None else []
            release(inner_q, inner_c, inner)
        plain = tiles.where("NOT dense").select(*keys, "shares")
        mine = asked.join(plain, keys).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).drop("shares")
        theirs = held.join(plain, keys).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        packs = max(1, min(total.units or 1, max(64, (total.rows or 0) // 60_000)))
        pack = F.pmod(F.xxhash64(*keys, "share"), F.lit(packs)).alias("pack")
        mine, theirs = mine.select(pack, "*"), theirs.select(pack, "*")
        theirs = theirs.toDF(*[f"{x}_" for x in theirs.columns])  # names of their own: both sides may stem from one table
        found = mine.groupBy("pack").cogroup(theirs.groupBy("pack_")).applyInArrow(_ranker(k, n, include_self, final, within), schema)
        found = written(found, "edges")
        release(tiles)
        done.append(found.where("rn > 0"))
        lost = found.where("rn = -1").select(F.col("src").alias("id"))
        gave_up = lost if gave_up is None else gave_up.unionByName(lost)
        still.append(found.where("rn = 0").select(F.col("src").alias("id")))
        todo = reduce(DataFrame.unionByName, still)
        if todo.isEmpty():
            return done, None if final else gave_up
        left = written(q.join(todo, "id", "left_semi"), "open")
        release(q)
        q = left
        factor *= 2.0 if factor < 8 else 8.0


def _scopes(q: DataFrame, c: DataFrame, grid: DataFrame, n: int, k: int, include_self: bool, size: Row, within: Within | None) -> DataFrame:
    """Edges or moments of scopes that are one tile each: nothing to count, no halo, no further round."""
    packs = max(1, min(size.units, max(64, size.rows // 30_000)))
    pack = F.pmod(F.xxhash64("s"), F.lit(packs)).alias("pack")
    g, tile = grid.select("s", F.col("reach").alias("r")), [F.lit(0).alias("cell"), F.lit(0).alias("share"), "id", *[f"p{i}" for i in range(n)]]
    mine = q.join(g, "s").select(pack, "s", *tile, "r", F.lit(True).alias("last"))
    theirs = c.join(g, "s", "left_semi").select(pack, "s", *tile)
    theirs = theirs.toDF(*[f"{x}_" for x in theirs.columns])
    found = mine.groupBy("pack").cogroup(theirs.groupBy("pack_")).applyInArrow(_ranker(k, n, include_self, True, within), EDGE if within is None else within.schema)
    return written(found, "edges").where("rn > 0")


@dataclass(frozen=True)
class Within:
    """What :func:`knn_moments` adds up, and the columns that it keeps."""

    radius: float
    unit: float
    columns: tuple[str, ...]

    @property
    def schema(self) -> str:
        kinds = {"n": "long", "n_r": "long", "near": "array<long>"}
        return ", ".join(["src long", "rn int", *[f"{c} {kinds.get(c, 'double')}" for c in self.columns]])

    def sums(self, e: np.ndarray, at: np.ndarray, begin: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        """Means and sample covariances of groups of rows of ``e``, neighbours less the point ``at``, that start at ``begin``."""
        count = np.diff(begin, append=len(e))
        out = {}
        for name in ("", "_r"):
            if not any(c in self.columns for c in (f"n{name}", f"mx{name}", f"xx{name}")):
                continue
            weight = inside.astype(np.float64) if name else np.ones(len(e))
            total = np.add.reduceat(weight, begin)
            mean = np.add.reduceat(e * weight[:, None], begin) / np.maximum(total, 1)[:, None]
            c = (e - np.repeat(mean, count, axis=0)) * weight[:, None]
            out[f"n{name}"] = total.astype(np.int64)
            for i, axis in enumerate("xyz"):
                out[f"m{axis}{name}"] = np.where(total > 0, at[:, i] + mean[:, i], np.nan)
            for pair in PAIRS:
                a, b = ("xyz".index(x) for x in pair)
                out[f"{pair}{name}"] = np.where(total > 1, np.add.reduceat(c[:, a] * c[:, b], begin) / np.maximum(total - 1, 1), np.nan)
        return out


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, with the length at the end."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)


def _parts(p: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of ``p`` in parts of at most ``most``, halved along the longest side."""
    todo, out = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        x = p[rows]
        half, axis = len(rows) // 2, int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        order = np.argpartition(x[:, axis], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _nearest(p: np.ndarray, r: np.ndarray, x: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per query within its radius: row, candidate, squared distance and place of its k nearest; and the number found, at most k needed.

    Equal distances are in order of candidates.  ``own`` holds the candidate
    that is the query itself and does not count.
    """
    d = np.zeros((len(p), len(x)))
    for i in range(p.shape[1]):
        step = p[:, i : i + 1] - x[None, :, i]
        d += step * step
    near = d <= (r * r)[:, None]
    if own is not None:
        near &= ~own
    count = near.sum(axis=1)
    if len(x) > k and count.sum() > 4 * k * len(p):
        d[~near] = np.inf
        near &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    i, j = np.nonzero(near)
    v = d[i, j]
    order = np.lexsort((j, v, i))
    i, j, v = i[order], j[order], v[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    ok = place < k
    return i[ok], j[ok], v[ok], place[ok], count


def _ranker(k: int, n: int, include_self: bool, final: bool, within: Within | None = None):
    """Rank the candidates of the queries of the tiles of a pack; ``rn = 0`` marks an open query, -1 one that gives up."""
    unit, tile = [f"p{i}" for i in range(n)], ["s", "cell", "share"]

    def rank(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        take = lambda t, names: [t.column(c).to_numpy() for c in names]
        of_q, of_c = take(mine, tile), take(theirs, [f"{c}_" for c in tile])
        src, ids = mine.column("id").to_numpy(), theirs.column("id_").to_numpy()
        oq, oc = np.lexsort(of_q[::-1]), np.lexsort((ids, *of_c[::-1]))
        of_q, of_c, src, ids = [a[oq] for a in of_q], [a[oc] for a in of_c], src[oq], ids[oc]
        p = np.stack(take(mine, unit), axis=1)[oq] if len(src) else np.zeros((0, n))
        x = np.stack(take(theirs, [f"{c}_" for c in unit]), axis=1)[oc] if len(ids) else np.zeros((0, n))
        r, last = mine.column("r").to_numpy()[oq], mine.column("last").to_numpy(zero_copy_only=False)[oq].astype(bool)
        begin, there = _starts(*of_q), _starts(*of_c)
        place_of = {key: (a, b) for key, a, b in zip(zip(*[a[there[:-1]].tolist() for a in of_c], strict=True), there[:-1].tolist(), there[1:].tolist(), strict=True)}
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        closed = last & final
        for key, a, b in zip(zip(*[a[begin[:-1]].tolist() for a in of_q], strict=True), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if key not in place_of:
                continue
            lo, hi = place_of[key]
            parts = _parts(p[a:b], TOGETHER) if b - a > 2 * TOGETHER and hi - lo > 4 * TOGETHER else [np.arange(b - a)]
            for rows in parts:
                rows = rows + a
                held = np.arange(lo, hi)
                if len(parts) > 1:
                    most = r[rows].max() * 1.000001
                    low, high = p[rows].min(axis=0) - most, p[rows].max(axis=0) + most
                    held = held[((x[lo:hi] >= low) & (x[lo:hi] <= high)).all(axis=1)]
                few = max(1, AT_ONCE // max(1, len(held)))
                for at in range(0, len(rows), few):
                    some = rows[at : at + few]
                    own = None if include_self else src[some][:, None] == ids[held][None, :]
                    i, j, v, place, count = _nearest(p[some], r[some], x[held], own, k)
                    closed[some] |= count >= k
                    shut = closed[some][i]
                    found.append((some[i][shut], held[j][shut], v[shut], place[shut]))
        i, j, v, place = (np.concatenate([f[c] for f in found]) for c in range(4))
        left = np.flatnonzero(~closed)
        open_rn = np.where(last[left], -1, 0)
        if within is None:
            columns = [np.concatenate(c) for c in ((src[i], src[left]), (ids[j], np.full(len(left), -1)), (v, np.zeros(len(left))), (place + 1, open_rn))]
            return pa.table({"src": columns[0], "dst": columns[1], "d2": columns[2], "rn": columns[3].astype(np.int32)})
        begin = _starts(i)[:-1]
        first = i[begin]
        got = within.sums((x[j] - p[i]) * within.unit, p[first] * within.unit, begin, v <= within.radius * within.radius) if len(i) else {}
        out = {"src": pa.array(np.concatenate([src[first], src[left]])), "rn": pa.array(np.concatenate([np.ones(len(first), np.int32), open_rn.astype(np.int32)]))}
        for c in within.columns:
            if c == "near":
                ends = np.append(begin, len(i)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[j]))
                out[c] = pa.concat_arrays([lists, pa.nulls(len(left), lists.type)])
                continue
            values = got.get(c, np.zeros(0))
            kind = pa.int64() if c in ("n", "n_r") else pa.float64()
            out[c] = pa.concat_arrays([pa.array(values, kind, mask=np.isnan(values)), pa.nulls(len(left), kind)])
        return pa.table(out)

    return rank


def _search(queries: DataFrame, candidates: DataFrame | Index, k: int, scope: list[str], pid: str, coords: tuple[str, ...], include_self: bool, per_tile: int, radius: float | None, within: Within | None = None) -> DataFrame:
    n = len(coords)
    given = isinstance(candidates, Index)
    at = candidates if given else index(candidates, scope, pid, coords)
    if (at.scope, at.coords) != (scope, coords):
        raise ValueError(f"the index has scope {at.scope} and coordinates {at.coords}")
    q = _plain(queries, scope, pid, coords).join(at.scopes.select(*scope, "s"), scope).select("s", "id", *[f"p{i}" for i in range(n)])
    grid = written(_grid(q, at.scopes, ["s"], n, k, per_tile, radius=radius), "grid")
    size = grid.agg(F.max(F.col("r0") < F.col("reach")).alias("rounds"), F.max("k").alias("most"), F.max("asked").alias("asked"), F.sum(F.col("k") + F.col("asked")).alias("rows"), F.count("*").alias("units")).first()
    if size.units and not size.rounds and size.most <= 2 * per_tile and size.asked <= 4 * per_tile:
        edges = [_scopes(q, at.points, grid, n, k, include_self, size, within)]
    else:
        edges, _ = _rounds(q, at.points, grid, n, k, include_self, per_tile, True, within=within)
    release(grid)
    if not given:
        at.release()
    return reduce(DataFrame.unionByName, edges)


def radius_knn(queries: DataFrame, candidates: DataFrame | Index, k: int, radius: float, scope: list[str], pid: str = "pid", coords: tuple[str, ...] = XYZ, include_self: bool = True, per_tile: int = 700) -> DataFrame:
    """``(src, dst, d2, rn)``: at most k neighbours within ``radius`` in the same scope.

    Ids are unique.  Points with a null or non-finite coordinate neither have
    neighbours nor are any.
    """
    return _search(queries, candidates, k, scope, pid, coords, include_self, per_tile, radius)


def knn_join(queries: DataFrame, candidates: DataFrame | Index, k: int, scope: list[str], pid: str = "pid", coords: tuple[str, ...] = XYZ, include_self: bool = True, per_tile: int = 700) -> DataFrame:
    """``(src, dst, d2, rn)``: the k nearest candidates of every query in its scope.

    Ties go to the smaller id; a scope with fewer than k candidates gives all
    of them.  The queries of a tile are dealt out in shares, so a tile with
    many of them is worked on by several tasks.  Points with a null or
    non-finite coordinate neither have neighbours nor are any.  An
    :func:`index` of the candidates serves several joins.
    """
    return _search(queries, candidates, k, scope, pid, coords, include_self, per_tile, None)


def knn_moments(points: DataFrame, k: int, radius: float, scope: list[str], pid: str = "pid", coords: tuple[str, ...] = XYZ, unit: float = 1.0, per_tile: int = 700, columns: list[str] | None = None, only: bool = False) -> DataFrame:
    """Covariances of the k nearest of every point, and of those of them within ``radius``: one row a point.

    ``(src, n, n_r, mx, mx_r, ..., xx, xx_r, ..., near)``, or those of them in
    ``columns``; ``near`` are the ids of the neighbours, nearest first.  With
    ``only`` neighbours beyond ``radius`` are not looked for at all.  The task that ranks the candidates of a tile
    adds up the two covariances at once, so no table of edges is written or
    read.  ``radius`` is in the unit of ``coords``, covariances in that of
    ``coords`` times ``unit``; of a single neighbour they are null.
    """
    within = Within(radius, unit, tuple(columns or [c for c in MOMENTS if not c.startswith("m")]))
    return _search(points, points, k, scope, pid, coords, True, per_tile, radius if only else None, within).drop("rn")


def scope_knn(points: DataFrame, k: int, scope: list[str], pid: str = "pid", coords: tuple[str, ...] = XYZ, include_self: bool = True) -> DataFrame:
    """Reference form for scopes of bounded size: join on the scope, rank by window."""
    a = points.select(*scope, F.col(pid).alias("src"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(coords)])
    b = points.select(*scope, F.col(pid).alias("dst"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(coords)])
    both = a.join(b, scope)
    d2 = reduce(lambda x, y: x + y, [(F.col(f"_q{i}") - F.col(f"_d{i}")) * (F.col(f"_q{i}") - F.col(f"_d{i}")) for i in range(len(coords))])
    both = both.select("src", "dst", d2.alias("d2"))
    return top_k(both if include_self else both.where("src <> dst"), k)


__all__ = ["Index", "index", "knn_join", "knn_moments", "radius_knn", "scope_knn", "top_k"]
