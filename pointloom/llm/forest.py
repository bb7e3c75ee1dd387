"""Embedding near-dedup by a forest of random-projection trees.

Vectors are scaled to length one and equal vectors of a label are collapsed.
Every tree splits the vectors recursively half way between two random ones;
vectors within the margin of a split go to both sides (spill), so close pairs
are seldom parted, and many trees make it rarer still.
The upper splits are learned from a bounded sample.  Cells (leaf and label)
that are larger than wanted are split on, level by level, between two of their
own members (:func:`split_on`), so cells do not grow with the table.  Pairs are compared, exactly and in double precision,
only within cells.

A pair that meets in several cells counts once: in the first cell the two
share.  Each vector carries the list of its cells, so a cell can tell by one
product of membership matrices which pairs met before; no pair is ever sent
anywhere.  Links are counted per vector, a spanning forest per cell feeds the
connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, forest_edges
from .components import connected_components
from .store import evenly, materialise, release


class Tree:
    """One tree: arrays of split directions, thresholds and children."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, leaf: int, spill: float):
        self.directions: list[np.ndarray] = []
        self.at: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        self.spill = spill
        self.root = self._grow(sample, rng, leaf, 0)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, leaf: int, depth: int) -> int:
        if len(x) > leaf and depth < 20:
            for _ in range(8):
                a, b = x[rng.choice(len(x), 2, replace=False)]
                d = a - b
                size = float(np.linalg.norm(d))
                if size < 0.5:  # the two are near each other: no split between them
                    continue
                d = d / size
                p = x @ d
                t = 0.0  # half way between the two, which both have length one
                low, high = p <= t + self.spill, p > t - self.spill
                if max(low.sum(), high.sum()) > 0.9 * len(x):
                    continue
                me = len(self.at)
                self.directions.append(d)
                self.at.append(t)
                self.children.append((0, 0))
                self.children[me] = (self._grow(x[low], rng, leaf, depth + 1), self._grow(x[high], rng, leaf, depth + 1))
                return me
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(row numbers, leaf number) for every leaf that gets rows."""
        todo, out = [(self.root, np.arange(len(x)))], []
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -node))
                continue
            p = x[rows] @ self.directions[node]
            left, right = self.children[node]
            todo.append((left, rows[p <= self.at[node] + self.spill]))
            todo.append((right, rows[p > self.at[node] - self.spill]))
        return out


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be compared, and these rows scaled to length one."""
    good, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        a = np.array([np.nan if c is None else c for c in v], np.float64) if isinstance(v, list) or getattr(v, "dtype", None) == object else np.asarray(v, np.float64)
        most = float(np.abs(a).max())
        if math.isfinite(most) and most > 0:  # by the largest component first, or squares may leave the range of doubles
            a = a / most
            good.append(i)
            rows.append(a / np.linalg.norm(a))
    return np.array(good, np.int64), rows


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows of finite vectors that are not zero, in doubles and of length one; as :func:`unit` does it."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(v: Column) -> Column:
    """The same within Spark."""
    v = v.cast("array<double>")
    most = F.array_max(F.transform(v, F.abs))
    x = F.transform(v, lambda c: c / most)
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    return F.transform(x, lambda c: c / size)


def split_on(routed: DataFrame, most: int, spill: float, apart: float, seed: int, tries: int = 3, max_rounds: int = 60) -> DataFrame:
    """``(rep, cell)``: the cells of every vector, cells of more than ``most`` vectors split on.

    ``routed`` has rep, v and cells.  Each round splits every large cell in two
    with spill, half way between two of its members.  A cell that does not part
    (the two are nearer than ``apart``, or a side keeps nine tenths) is tried
    again with other members and then left whole: it is compared in blocks.
    """
    at = routed.select("rep", "v", F.explode("cells").alias("cell"))
    large = at.groupBy("cell").agg(F.count("*").alias("k")).where(F.col("k") > most).select("cell")
    large = materialise(large, "large")
    done = [at.join(evenly(large), "cell", "left_anti").select("rep", "cell")]
    todo = at.join(evenly(large), "cell").select("rep", _unit(F.col("v")).alias("x"), "cell", F.lit(0).alias("tried"))
    for turn in range(max_rounds):
        draw = F.xxhash64("rep", F.lit(seed + turn))
        d = todo.groupBy("cell").agg(F.min_by("x", draw).alias("a"), F.max_by("x", draw).alias("b")).select("cell", F.zip_with("a", "b", lambda a, b: b - a).alias("d"))
        d = d.withColumn("_l", F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, v: s + v * v))).where(F.col("_l") > apart)
        # both have length one, so the middle between them projects to zero
        p = F.aggregate(F.zip_with("x", "d", lambda x, v: x * v), F.lit(0.0), lambda s, v: s + v) / F.col("_l")
        sides = materialise(todo.join(evenly(d), "cell", "left").select("rep", "x", "cell", "tried", F.coalesce(p <= spill, F.lit(True)).alias("low"), F.coalesce(p > -spill, F.lit(True)).alias("high")), "sides")
        sizes = sides.groupBy("cell").agg(F.count("*").alias("k"), F.count_if("low").alias("kl"), F.count_if("high").alias("kh"))
        sizes = sizes.select("cell", (F.greatest("kl", "kh") <= 0.9 * F.col("k")).alias("parts"), (F.col("kl") > most).alias("more_l"), (F.col("kh") > most).alias("more_h"))
        side = lambda name, more: F.when(F.col("parts") & F.col(name), F.struct(F.xxhash64("cell", F.lit(name)).alias("cell"), F.lit(0).alias("tried"), F.col(more).alias("more")))
        again = F.when(~F.col("parts"), F.struct("cell", (F.col("tried") + 1).alias("tried"), (F.col("tried") + 1 < tries).alias("more")))
        moved = sides.join(evenly(sizes), "cell").select("rep", "x", F.explode(F.array_compact(F.array(side("low", "more_l"), side("high", "more_h"), again))).alias("_c")).select("rep", "x", "_c.*")
        moved = materialise(moved, "moved")
        release(sides)
        done.append(moved.where("NOT more").select("rep", "cell"))
        todo = moved.where("more").drop("more")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, todo.select("rep", "cell")])


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    trees: int = 5,
    leaf: int = 1000,
    spill: float = 0.02,
    sample: int = 20_000,
    block: int = 2000,
    seed: int = 1,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Vectors link when their labels are equal and not null and their cosine is
    at least ``threshold``.  Null, zero, empty and non-finite vectors, vectors
    with null components and vectors of different lengths link with nothing;
    finite ones of any size do.  ``sample`` bounds the vectors that the upper
    splits are learned from; all vectors are routed and compared.  A leaf aims
    at ``leaf`` vectors, and cells above twice that are split on.  Every row is
    a vector of its own, also when keys repeat or are null; ``component_id`` is
    the smallest key of the component, null where no row of it has a key.
    """
    spark = vectors.sparkSession
    # vectors travel as they are; doubles of length one are made where they are compared
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.col(label).cast("string").alias("lab"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = F.col("lab").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    firsts = rows.where(fit).groupBy("lab", "v").agg(F.min("id").alias("head"), F.count("*").alias("size"))
    firsts = materialise(firsts.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n = firsts.count()

    # the upper splits: one forest for all labels, learned from a bounded sample
    share = min(1.0, sample / max(1, n))
    place = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000))
    drawn = firsts.where(place < int(share * 1_000_000) + 1).select("v").orderBy(place).limit(2 * sample).collect()
    by_width: dict[int, list[np.ndarray]] = {}
    for x in unit([r[0] for r in drawn])[1]:
        by_width.setdefault(len(x), []).append(x)
    small = max(50, round(leaf * share))
    rng = np.random.default_rng(seed)
    grown = {w: [Tree(np.stack(x), rng, small, spill) for _ in range(trees)] for w, x in sorted(by_width.items())}
    forest = spark.sparkContext.broadcast(grown)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            good, x = unit(list(df["v"]))
            widths = np.array([len(a) for a in x])
            for w in sorted(set(widths.tolist())):
                mine = good[widths == w]
                m = np.stack([x[i] for i in np.flatnonzero(widths == w)])
                member: list[list[int]] = [[] for _ in mine]
                for t, tree in enumerate(forest.value.get(w, [])):
                    for at, leaf_no in tree.route(m):
                        code = (w << 40) | (t << 20) | leaf_no
                        for i in at:
                            member[i].append(code)
                yield df.iloc[mine][["rep", "lab", "size", "v"]].assign(leaves=[c or [w << 40] for c in member])

    routed = firsts.select("rep", "lab", "size", "v").mapInPandas(route, f"rep long, lab string, size long, v {kind}, leaves array<long>")
    routed = materialise(routed.select("rep", "size", "v", F.array_sort(F.transform("leaves", lambda c: F.xxhash64("lab", c))).alias("cells")), "routed")
    counted = lambda df: df.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("k"))
    if not counted(routed).where(F.col("k") > 2 * leaf).isEmpty():
        cells = split_on(routed, 2 * leaf, spill, 1.5 * math.sqrt(2 - 2 * threshold), seed)
        lists = cells.groupBy("rep").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        routed = materialise(routed.drop("cells").join(evenly(lists), "rep"), "routed")
    sizes = counted(routed).where("k > 1").select("cell", F.ceil(F.col("k") / F.lit(block)).cast("int").alias("blocks"))
    placed = routed.select("*", F.explode("cells").alias("cell")).join(evenly(sizes), "cell")
    units = block_pairs(placed, ["cell"], "rep", "blocks", max(1, n * trees // block))

    def work(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (here, one, two), g in df.groupby(["cell", "_i", "_j"], sort=True):
            g = g.sort_values("rep")
            ids, weight = g["rep"].to_numpy(), g["size"].to_numpy()
            x = scaled(np.stack(g["v"].to_list()))
            # cells before this one, in order, as a 0/1 matrix
            flat = np.concatenate([np.asarray(c, np.int64) for c in g["cells"]])
            owner = np.repeat(np.arange(len(g)), [len(c) for c in g["cells"]])
            ok = flat < here
            names, col = np.unique(flat[ok], return_inverse=True)
            met = np.zeros((len(g), max(1, len(names))), np.float32)
            met[owner[ok], col] = 1
            first = g["_b"].to_numpy() == one
            left = np.flatnonzero(first)
            within = one == two
            right = left if within else np.flatnonzero(~first)
            if not len(left) or not len(right):
                continue
            found = []
            for at in range(0, len(left), 500):
                part = left[at : at + 500]
                link = (x[part] @ x[right].T >= threshold - 1e-9) & (met[part] @ met[right].T < 0.5)
                if within:
                    link &= np.arange(at, at + len(part))[:, None] < np.arange(len(right))[None, :]
                a, b = np.nonzero(link)
                found.append((part[a], right[b]))
            i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            # block products find candidates with a little room; an exact sum decides
            ok = np.concatenate([(x[i[k : k + 20_000]] * x[j[k : k + 20_000]]).sum(axis=1) >= threshold for k in range(0, len(i), 20_000)] or [np.zeros(0, bool)])
            i, j = i[ok], j[ok]
            links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            up = dict(forest_edges(i, j, len(ids)))
            for k in np.flatnonzero(links):
                out.append((int(ids[k]), int(links[k]), int(ids[up[int(k)]]) if int(k) in up else None))
        return pd.DataFrame(out, columns=["rep", "links", "up"]).astype({"rep": "int64", "links": "int64", "up": "Int64"})

    found = materialise(units.groupBy("unit").applyInPandas(work, "rep long, links long, up long"), "links")
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("up").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = firsts.select("rep", "head", "size").join(evenly(counts), "rep", "left").join(evenly(joined.withColumnRenamed("id", "rep")), "rep", "left")
    per = materialise(per.select("rep", "head", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vectors-found")
    named = per.groupBy("component").agg(F.min("head").alias("component_id"))
    known = firsts.select("lab", "v", "rep").join(evenly(per.join(evenly(named), "component").select("rep", "n_links", "component_id")), "rep").select("lab", "v", "n_links", "component_id", F.lit(True).alias("_met"))
    wide = vectors.select(F.col(key), F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.col(label).cast("string").alias("lab"))
    component = F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("id"))
    out = wide.join(evenly(known), ["lab", "v"], "left")
    return out.select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), component.isNull()).alias("kept"),
    )
