"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts become sets of five-word shingles with MinHash signatures.  Texts with
equal sets are one class, and classes are compared as one.  Candidates are the
pairs of classes that share a band of signature values.  Their signatures are
read 32 values at a time, and a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold (uniform prior, binomial
likelihood) is below the tolerance.  What remains is verified exactly on the
sets (of hashed shingles, 64 bits each).

Pairs never become rows.  A unit of work compares the members of a group,
block against block, and returns link counts and a spanning forest.  Where the
bands of a connected part mostly hold the same members, as with near copies of
one text, the part is one group.  Where bands merely chain texts together, each
band is a group of its own, and a pair counts in the first band it shares.  The
way with fewer comparisons is taken, so a long chain costs as much as its bands.

A group of one block is compared where its sets are made.  The members of a
larger one meet block by block with the group's first set, and go on to the
pairs of blocks as differences from it, in sets and signatures alike: of near
copies little more than the edits travels.  The size of a symmetric difference
does not depend on the set both sides are taken from, so the check stays exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_of, block_pairs, forest_edges
from .components import connected_components
from .store import ROW, evenly, materialise, numbered, release

PERMUTATIONS, ROWS_PER_BAND, STEP = 128, 4, 32
_RNG = np.random.Generator(np.random.PCG64(4))
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_P = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, 65)], dtype=np.uint64)


class Shingler:
    """Sets of hashed word n-grams; ``cache_words`` bounds the table of word hashes.

    Words are runs of characters without white space, in lower case.  A text
    with fewer than n words, but at least one, is one shingle of all its words;
    a text without words has the empty set.
    """

    def __init__(self, n: int = 5, cache_words: int = 500_000):
        self.n, self.cache_words, self._words = n, cache_words, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self._words
        if len(known) > self.cache_words:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * _P[k]
        total ^= total >> np.uint64(29)
        return np.unique(total * _P[n])


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, uint32, a bounded number of bytes at a time."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        part = ((s[at : at + 2048, None] * _A + _C) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def least_matches(threshold: Fraction, tolerance: float) -> list[tuple[int, int]]:
    """(values read, matches needed to go on) for each step.

    After m matches of n values the posterior of the similarity is
    Beta(m + 1, n - m + 1); P(similarity >= t) is the chance that a binomial
    variable with n + 1 trials of chance t is at most m.
    """
    t, out = float(threshold), []
    for n in range(STEP, PERMUTATIONS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def sketches(rows: DataFrame, n: int) -> DataFrame:
    """``(row, key, set_id binary, grams int, sig array<int>)``; null ``set_id`` for texts without words.

    Arrow batches, because keys pass through as they are.
    """
    found = T.StructType.fromDDL("set_id binary, grams int, sig array<int>").fields
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", rows.schema["key"].dataType), *found])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(n)
        for batch in batches:
            sets = map(cut, batch.column("text").to_pylist())
            made = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), signature(s).view(np.int32)) if len(s) else (None, 0, None) for s in sets]
            ids, sizes, sigs = zip(*made, strict=True) if made else ((), (), ())
            columns = [batch.column("row"), batch.column("key"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return materialise(rows.select(F.col(ROW).alias("row"), "key", "text").mapInArrow(work, schema), "sketches")


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 1 << 16) -> np.ndarray:
    """Sizes of the intersections of sets i[k] and j[k]; bit rows over some shared shingles at a time."""
    both = np.zeros(len(i), np.int64)
    if not len(i):
        return both
    sizes = np.array([len(s) for s in sets])
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    ok = count[back] > 1
    row, col = np.repeat(np.arange(len(sets)), sizes)[ok], place[back[ok]]
    for at in range(0, int((count > 1).sum()), columns):
        here = (col >= at) & (col < at + columns)
        r, c = row[here], col[here] - at
        words = int(c.max()) // 64 + 1
        bits = np.zeros((len(sets), words), np.uint64)
        np.bitwise_or.at(bits, (r, c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
        both += _rowwise(lambda x, y: np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64), i, j, max(1, 4_000_000 // words))
    return both


def compare(
    sig: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction, plan: list[tuple[int, int]], band: int = -1
) -> tuple[np.ndarray, np.ndarray]:
    """Links between members ``left`` and ``right`` (equal arrays: within), as index arrays.

    ``sets`` hold the members' differences from one set (the members themselves
    where that is empty), ``sizes`` the members' own sizes.  With a ``band``,
    only pairs that share no band before it.
    """
    within = left is right
    apart = np.array([len(s) for s in sets], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = max(1, 4_000_000 // (STEP * max(1, len(right))))
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        n, need = plan[0]
        same = (sig[part][:, None, :n] == sig[right][None, :, :n]).sum(axis=2, dtype=np.int16)
        keep = same >= need
        if within:
            keep &= np.arange(at, at + len(part))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(keep)
        m = same[i, j]
        i, j = part[i], right[j]
        for (a, _), (b, need) in zip(plan, plan[1:], strict=False):
            m = m + _rowwise(lambda x, y, a=a, b=b: (sig[x, a:b] == sig[y, a:b]).sum(axis=1, dtype=np.int16), i, j)
            ok = m >= need
            i, j, m = i[ok], j[ok], m[ok]
        if band > 0:
            bands = lambda x: sig[x, : band * ROWS_PER_BAND].reshape(len(x), band, ROWS_PER_BAND)
            ok = _rowwise(lambda x, y: ~(bands(x) == bands(y)).all(axis=2).any(axis=1), i, j).astype(bool)
            i, j = i[ok], j[ok]
        found.append((i, j))
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    unlike = apart[i] + apart[j] - 2 * common(sets, i, j)
    both = (sizes[i] + sizes[j] - unlike) // 2
    ok = both * threshold.denominator >= threshold.numerator * (sizes[i] + sizes[j] - both)
    return i[ok], j[ok]


def _rowwise(fn, i: np.ndarray, j: np.ndarray, at_once: int = 50_000) -> np.ndarray:
    if not len(i):
        return np.zeros(0, np.int64)
    return np.concatenate([fn(i[k : k + at_once], j[k : k + at_once]) for k in range(0, len(i), at_once)])


def _groups(classes: DataFrame, block: int, block_grams: int) -> DataFrame:
    """``(rep, groups array<struct<g, band, blocks, head>>)``: where each class with candidates is compared; ``head`` is the group's first."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // ROWS_PER_BAND - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS_PER_BAND + 1, ROWS_PER_BAND)))
    banded = classes.select("rep", "grams", F.posexplode(bands).alias("band", "g"))
    heads = banded.groupBy("g", "band").agg(F.min("rep").alias("head"), F.count("*").alias("k"), F.sum("grams").alias("weight")).where("k > 1")
    heads = materialise(heads, "bands")
    stars = banded.join(evenly(heads.select("g", "head")), "g").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v"))
    parts = materialise(connected_components(stars), "parts")
    sizes = parts.join(classes.select(F.col("rep").alias("id"), "grams"), "id").groupBy("component").agg(F.count("*").alias("k"), F.sum("grams").alias("weight"))
    apart = heads.join(parts, F.col("head") == F.col("id")).groupBy("component").agg(F.sum(F.col("k") * F.col("k")).alias("by_band"))
    whole = F.col("k") * F.col("k") <= F.col("by_band")
    blocks = F.greatest(F.ceil(F.col("k") / F.lit(block)), F.ceil(F.col("weight") / F.lit(block_grams))).cast("int").alias("blocks")
    ways = sizes.join(apart, "component").select("component", whole.alias("whole"), blocks)
    ways = materialise(parts.join(evenly(ways), "component").select(F.col("id").alias("rep"), "component", "whole", "blocks"), "ways")
    out = ways.where("whole").select("rep", F.col("component").alias("g"), F.lit(-1).alias("band"), "blocks", F.col("component").alias("head"))
    loose = banded.join(evenly(ways.where("NOT whole").select("rep")), "rep").select("rep", "g", "band")
    out = out.unionByName(loose.join(evenly(heads.select("g", blocks, "head")), "g"))
    out = materialise(out.groupBy("rep").agg(F.collect_list(F.struct("g", "band", "blocks", "head")).alias("groups")), "groups")
    for t in (heads, parts, ways):
        release(t)
    return out


def _joined(rows: DataFrame, n: int, threshold: Fraction, tolerance: float, block: int, block_grams: int) -> DataFrame:
    """``(row, key, head, n_links, first)``; ``head`` and ``first`` are structs (missing, key, row).

    ``rows`` has ``key``, ``text`` and row ids.  ``head`` is the first row of
    the class, ``first`` that of the component; null keys come last.
    """
    sk = sketches(rows, n)
    place = F.struct(F.col("key").isNull().alias("missing"), "key", "row")
    classes = sk.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(place).alias("head"), F.count("*").alias("size"), F.first("sig").alias("sig"), F.first("grams").alias("grams"))
    classes = materialise(classes.withColumn("rep", F.col("head.row")), "classes")
    groups = _groups(classes, block, block_grams)
    total = groups.count()
    # whole texts of the candidates, and only theirs
    info = classes.select("rep", F.col("size").alias("weight"), "sig").join(evenly(groups), "rep")
    full = _with_sets(rows.select(F.col(ROW).alias("rep"), "text").join(evenly(info), "rep"), n)
    placed = full.select("rep", "weight", "sig", "grams", F.inline("groups"))
    found = _links(placed, max(1, total // block), threshold, least_matches(threshold, tolerance))
    release(groups)
    joined = materialise(connected_components(found.select(F.col("rep").alias("u"), F.col("up").alias("v"))), "components")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = classes.select("set_id", "rep", "head", "size").join(evenly(counts), "rep", "left").join(evenly(joined.withColumnRenamed("id", "rep")), "rep", "left")
    per = materialise(per.withColumn("component", F.coalesce("component", "rep")), "classes-found")
    first = per.groupBy("component").agg(F.min("head").alias("first"))
    per = per.join(evenly(first), "component").select("set_id", "head", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), "first")
    out = sk.select("row", "key", "set_id", place.alias("own")).join(evenly(per), "set_id", "left")
    return out.select("row", "key", F.coalesce("head", "own").alias("head"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("first", "own").alias("first"))


#: A row is a result (``links`` and ``up``) or a member of a block; members with ``base`` stand for the set that the others differ from.
_STEP = "rep long, links long, up long, g long, band int, blocks int, base boolean, plain boolean, weight long, size long, sig array<int>, grams binary"


def _links(placed: DataFrame, bins: int, threshold: Fraction, plan: list[tuple[int, int]]) -> DataFrame:
    """``(rep, links, up)`` rows: counts of links and edges of a spanning forest, some per unit of work."""

    def rows_of(ids: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[dict]:
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        up = dict(forest_edges(i, j, len(ids)))
        return [{"rep": int(ids[k]), "links": int(links[k]), "up": int(ids[up[int(k)]]) if int(k) in up else None} for k in np.flatnonzero(links)]

    def within(g: pd.DataFrame, band: int) -> list[dict]:
        sets = [np.frombuffer(x, np.uint64) for x in g["grams"]]
        every = np.arange(len(sets))
        sizes = np.array([len(s) for s in sets], np.int64)
        return rows_of(g["rep"].to_numpy(), g["weight"].to_numpy(), *compare(_signatures(g), sets, sizes, every, every, threshold, plan, band))

    def first(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (group, band, b), g in df.groupby(["g", "band", "_b"], sort=True):
            blocks = int(g["blocks"].iloc[0])
            members = g[~g["base"]].sort_values("rep")
            if blocks == 1:
                out += within(members, int(band))
                continue
            base = g[g["base"]].iloc[0]
            common_set, common_sig = np.frombuffer(base["grams"], np.uint64), np.asarray(base["sig"], np.int32)
            place = {"g": int(group), "band": int(band), "blocks": blocks}
            if b == 0:
                out.append({"rep": int(base["rep"]), **place, "base": True, "plain": True, "grams": base["grams"], "size": len(common_set)})
            for m in members.itertuples():
                own = np.frombuffer(m.grams, np.uint64)
                apart = np.setxor1d(own, common_set, assume_unique=True)
                plain = len(apart) > len(own)
                sig = np.asarray(m.sig, np.int32) ^ common_sig
                out.append({"rep": m.rep, **place, "base": False, "plain": plain, "weight": m.weight, "size": len(own), "sig": sig, "grams": m.grams if plain else apart.tobytes()})
        return _framed(out)

    def second(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, band, one, two), g in df.groupby(["g", "band", "_i", "_j"], sort=True):
            base, g = g[g["base"]], g[~g["base"]].sort_values("rep")
            own = g["_b"].to_numpy() == one
            left = np.flatnonzero(own)
            right = left if one == two else np.flatnonzero(~own)
            if not len(left) or not len(right):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g["grams"]]
            if g["plain"].any():
                # some member is unlike the group's first set: all sets are made whole again
                common_set = np.frombuffer(base["grams"].iloc[0], np.uint64)
                sets = [s if p else np.setxor1d(s, common_set, assume_unique=True) for s, p in zip(sets, g["plain"], strict=True)]
            sizes = g["size"].to_numpy().astype(np.int64)
            i, j = compare(_signatures(g), sets, sizes, left, right, threshold, plan, int(band))
            out += rows_of(g["rep"].to_numpy(), g["weight"].to_numpy().astype(np.int64), i, j)
        return _framed(out)[["rep", "links", "up"]]

    # the first member of a group of several blocks comes to all of them besides
    dealt = placed.withColumn("_mine", block_of("rep", "blocks"))
    others = F.when((F.col("rep") == F.col("head")) & (F.col("blocks") > 1), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("_b"), F.lit(True).alias("base"))))
    own = F.array(F.struct(F.col("_mine").alias("_b"), F.lit(False).alias("base")))
    dealt = dealt.select("rep", "weight", "sig", "grams", "g", "band", "blocks", F.inline(F.concat(own, F.coalesce(others, F.array().cast("array<struct<_b:int,base:boolean>>")))))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("g", "band"), F.lit(bins))).otherwise(F.xxhash64("g", "band", "_b"))
    step = materialise(dealt.groupBy(unit.alias("unit")).applyInPandas(first, _STEP), "blocks")
    found = step.where("links IS NOT NULL").select("rep", "links", "up")
    members = step.where("links IS NULL").select("rep", "g", "band", "blocks", "base", "plain", "weight", "size", "sig", "grams")
    if members.isEmpty():
        return found
    last = F.col("blocks") - 1
    bases = members.where("base").withColumn("_i", F.explode(F.sequence(F.lit(0), last))).withColumn("_j", F.explode(F.sequence(F.col("_i"), last)))
    bases = bases.withColumn("_b", F.lit(-1)).withColumn("unit", F.xxhash64("g", "band", "_i", "_j")).drop("blocks")
    units = block_pairs(members.where("NOT base"), ["g", "band"], "rep", "blocks", 1).unionByName(bases)
    pairs = materialise(units.groupBy("unit").applyInPandas(second, "rep long, links long, up long"), "links")
    return found.unionByName(pairs)


def _signatures(g: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(x, np.int32) for x in g["sig"]])


def _framed(rows: list[dict]) -> pd.DataFrame:
    kinds = {"rep": "int64", "links": "Int64", "up": "Int64", "g": "Int64", "band": "Int32", "blocks": "Int32", "base": "boolean", "plain": "boolean", "weight": "Int64", "size": "Int64", "sig": object, "grams": object}
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=k) for c, k in kinds.items()})


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """Replace ``text`` by ``grams``, its shingle set."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(n)
        for df in batches:
            yield df.drop(columns="text").assign(grams=[cut(t).tobytes() for t in df["text"]])

    order = ["rep", "weight", "sig", "groups", "text"]
    return rows.select(*order).mapInPandas(work, "rep long, weight long, sig array<int>, groups array<struct<g:long,band:int,blocks:int,head:long>>, grams binary")


def jaccard_join(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    n: int = 5,
    threshold: Fraction = Fraction(4, 5),
    tolerance: float = 1e-6,
    block: int = 1500,
    block_grams: int = 2_000_000,
) -> DataFrame:
    """``(key, class_id, n_links, component_id)`` for every row.

    ``class_id`` is the smallest key with the same shingle set (the key itself
    for texts without words, which match nothing), ``n_links`` the number of
    other rows whose sets have Jaccard similarity ``threshold`` or more
    (equal sets included), ``component_id`` the smallest key reachable by such
    links.  ``tolerance`` is the posterior below which a pair is dropped; the
    signature bands miss a pair of similarity 0.8 with a chance below 1e-7.
    Null texts count as empty.  Every row counts by itself: repeated keys and
    null keys are compared like all others, and a ``class_id`` or
    ``component_id`` is null only where no row in question has a key.  Keys may
    be of any type that can be ordered.  A block holds about ``block`` texts
    and ``block_grams`` shingles at most.
    """
    rows = numbered(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), "texts")
    out = _joined(rows, n, threshold, tolerance, block, block_grams)
    return out.select(F.col("key").alias(key), F.col("head.key").alias("class_id"), "n_links", F.col("first.key").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, threshold: Fraction = Fraction(4, 5), tolerance: float = 1e-6, block: int = 1500, block_grams: int = 2_000_000) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest key, null keys last.

    Of rows with equal keys one stays as well.  Texts without words match
    nothing and stay.  Columns and their order are kept.
    """
    rows = numbered(docs, "documents")
    slim = rows.select(ROW, F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gone = _joined(slim, n, threshold, tolerance, block, block_grams).where("row <> first.row").select(F.col("row").alias(ROW))
    return rows.join(evenly(gone), ROW, "left_anti").select(*docs.columns)
