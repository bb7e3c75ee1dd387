"""Consistent orientation of normals along a minimum spanning forest.

The forest of the neighbour graph has edge weight 1 - |cos| (ties by ids); along
each of its edges the two normals are made to agree, and at the end every
component is flipped so that the normal of its highest point looks up.

Points are dealt to chunks of at most some ``local`` points, by scope and along a
curve through it, so that most edges lie in one chunk.  Of the edges inside a chunk
its task keeps their own forest: an edge that is the heaviest of a circle is in no
minimum forest.  Then the graph is contracted, chunk by chunk: a component of a
chunk merges along its lightest edge while that leads to another one of the chunk;
of what is left, edges that two chunks share included, again only a forest stays.
Chunks next to each other become one chunk and the step is repeated on the little
that is left, until no edge is.  If a graph has no such order and does not shrink,
the rest takes Boruvka rounds over tables.  Every way gives the one forest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import release, written

#: Bits of a place along an axis of the curve.
BITS = 20
#: Shifts that move the bits of a place three apart, and what is kept after each; bit by bit it grows beyond what Java translates to machine code.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
_OWN = "chunk long, u long, v long, w double, r int, nx double, ny double, nz double"
_STEP = "kind int, a long, b long, c long, f int, w double, u long, v long, r int"
NODE, INSIDE, SHARED = range(3)


def _merged(n: int, a: np.ndarray, b: np.ndarray, r: np.ndarray, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component and sign of ``n`` nodes, and which edges joined them; edges come in order of weight.

    With ``mine`` only such nodes merge, and a component whose lightest edge
    leads to another node waits.
    """
    comp, sign, chosen = np.arange(n), np.ones(n, np.int32), np.zeros(len(a), bool)
    at = np.arange(len(a))
    while True:
        out = a != b
        a, b, r, at = a[out], b[out], r[out], at[out]
        # the lightest edge of every component; a component picks at most one
        pick = np.full(n, len(a))
        back = np.arange(len(a))[::-1]
        pick[a[back]] = back
        other = np.full(n, len(a))
        other[b[back]] = back
        pick = np.minimum(pick, other)
        c = np.flatnonzero(pick < len(a))
        if mine is not None:
            c = c[mine[a[pick[c]]] & mine[b[pick[c]]]]
        if not len(c):
            return comp, sign, chosen
        k = pick[c]
        chosen[at[k]] = True
        up, way = np.arange(n), np.ones(n, np.int32)
        up[c], way[c] = np.where(a[k] == c, b[k], a[k]), r[k]
        root = c[(up[up[c]] == c) & (c < up[c])]  # of two that picked each other the smaller stays
        up[root], way[root] = root, 1
        while True:
            far = up[up]
            if np.array_equal(far, up):
                break
            way, up = way * way[up], far
        sign, comp = sign * way[comp], up[comp]
        r, a, b = r * way[a] * way[b], up[a], up[b]


def _table(schema: str, **columns: np.ndarray | None) -> pa.Table:
    """Columns of a schema; those not named are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.nulls(n, kinds[kind]) if name not in columns else pa.array(columns[name]).cast(kinds[kind]) for name, kind in fields})


def _own_edges(t: pa.Table) -> pa.Table:
    """Of the rows (chunk, id, normal, near) of a chunk: the forest of the edges inside, and the edges that leave it, without a weight."""
    chunk, rows = t.column("chunk")[0].as_py(), t.column("id").to_numpy()
    ids, first = np.unique(rows, return_index=True)
    normal = np.stack([t.column(c).to_numpy()[first] for c in ("nx", "ny", "nz")], axis=1)
    near = t.column("near").combine_chunks()
    src = np.repeat(np.searchsorted(ids, rows), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    dst = near.flatten()
    known = dst.is_valid().to_numpy(zero_copy_only=False)
    src, dst = src[known], dst.drop_null().to_numpy()
    other = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    within = ids[other] == dst
    a, b = np.minimum(src, other)[within], np.maximum(src, other)[within]
    a, b = np.divmod(np.unique((a * len(ids) + b)[a != b]), len(ids))
    dot = normal[a, 0] * normal[b, 0] + normal[a, 1] * normal[b, 1] + normal[a, 2] * normal[b, 2]
    w, r = 1 - np.abs(dot), np.where(dot < 0, -1, 1).astype(np.int32)
    order = np.lexsort((b, a, w))
    a, b, w, r = a[order], b[order], w[order], r[order]
    keep = _merged(len(ids), a, b, r)[2]
    src, dst = src[~within], dst[~within]
    inside = _table(_OWN, chunk=np.full(keep.sum(), chunk), u=ids[a[keep]], v=ids[b[keep]], w=w[keep], r=r[keep])
    return pa.concat_tables([inside, _table(_OWN, chunk=np.full(len(src), chunk), u=ids[src], v=dst, nx=normal[src, 0], ny=normal[src, 1], nz=normal[src, 2])])


def _contracted(t: pa.Table) -> pa.Table:
    """Of all edges (chunk, a, b, ca, cb, w, u, v, r) at the nodes of a chunk: where its nodes go, and the edges that are left.

    A left edge that two chunks share is told by both, each with its own end;
    only what both tell stays.
    """
    get = lambda c: t.column(c).to_numpy()
    here, (a, b, w, u, v, r) = t.column("chunk")[0].as_py(), (get(c) for c in ("a", "b", "w", "u", "v", "r"))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((v, u, w))  # from here on the lighter of two edges comes first
    a, b, w, u, v, r = ends[: len(a)][order], ends[len(a) :][order], w[order], u[order], v[order], r[order]
    mine = np.zeros(len(nodes), bool)
    mine[a[get("ca")[order] == here]] = True
    mine[b[get("cb")[order] == here]] = True
    comp, sign, _ = _merged(len(nodes), a, b, r, mine)
    moved = np.flatnonzero(comp != np.arange(len(nodes)))
    left = np.flatnonzero(_merged(len(nodes), comp[a], comp[b], r * sign[a] * sign[b])[2])
    both = mine[a[left]] & mine[b[left]]
    i, s = left[both], left[~both]
    own, end = np.where(mine[a[s]], a[s], b[s]), lambda x: nodes[comp[x]]
    return pa.concat_tables(
        [
            _table(_STEP, kind=np.full(len(moved), NODE), a=nodes[moved], b=end(moved), f=sign[moved]),
            _table(_STEP, kind=np.full(len(i), INSIDE), a=end(a[i]), b=end(b[i]), c=np.full(len(i), here), w=w[i], u=u[i], v=v[i], r=r[i] * sign[a[i]] * sign[b[i]]),
            _table(_STEP, kind=np.full(len(s), SHARED), a=end(own), c=np.full(len(s), here), f=sign[own], w=w[s], u=u[s], v=v[s], r=r[s]),
        ]
    )


def _curve(points: DataFrame, scope: list[str], axes: list[str]) -> DataFrame:
    """Add ``_at``, the place of a point on a curve (Morton's) through the box of its scope."""
    ends = points.groupBy(*scope).agg(*[f(c).alias(f"_{k}{c}") for c in axes for k, f in (("l", F.min), ("h", F.max))])
    ends = ends.select(*[F.col(c).alias(f"_s{c}") for c in scope], *[f"_l{c}" for c in axes], F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in axes], F.lit(1e-9)).alias("_far"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in scope], F.lit(True))
    cell = lambda c: F.floor((F.col(c) - F.col(f"_l{c}")) / F.col("_far") * ((1 << BITS) - 1)).cast("long")
    cells = points.join(ends, same, "left").withColumns({f"_c{c}": cell(c) for c in axes})
    for step, bits in SPREAD:
        cells = cells.withColumns({f"_c{c}": F.col(f"_c{c}").bitwiseOR(F.shiftleft(f"_c{c}", step)).bitwiseAND(F.lit(bits)) for c in axes})
    return cells.select(*points.columns, reduce(Column.bitwiseOR, [F.shiftleft(f"_c{c}", k) for k, c in enumerate(axes)]).alias("_at"))


def _chunked(points: DataFrame, pid: str, scope: list[str], local: int) -> tuple[DataFrame, int]:
    """``points`` written with a number ``chunk``, and how many there are; numbers next to each other are near each other."""
    points = written(points, "normals")
    chunks = max(1, -(-2 * points.count() // local))  # half full on average: ranges are drawn from samples
    if chunks == 1:
        return points.withColumn("chunk", F.lit(0).cast("long")), 1
    placed = _curve(points, scope, [c for c in ("x", "y", "z") if c in points.columns])
    placed = placed.repartitionByRange(chunks, *scope, "_at", pid).drop("_at").withColumn("chunk", F.spark_partition_id().cast("long"))
    placed = written(placed, "chunks")
    release(points)
    return placed, chunks


def _graph(n: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges ``(a, b, ca, cb, w, u, v, r)`` between chunks, and of those inside a chunk the forest."""
    near = "near" if "near" in edges.columns else F.array("dst").alias("near")
    mine = edges.select(F.col("src").alias("id"), near).join(n.select("id", "chunk", "nx", "ny", "nz"), "id")
    own = written(mine.groupBy("chunk").applyInArrow(_own_edges, _OWN), "own")
    inside = own.where("w IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("chunk").alias("ca"), F.col("chunk").alias("cb"), "w", "u", "v", "r")
    a, b = own.where("w IS NULL").alias("a"), n.alias("b")
    dot = F.col("a.nx") * F.col("b.nx") + F.col("a.ny") * F.col("b.ny") + F.col("a.nz") * F.col("b.nz")
    first = F.col("a.u") < F.col("a.v")
    u, v = F.least("a.u", "a.v"), F.greatest("a.u", "a.v")
    ca, cb = F.when(first, F.col("a.chunk")).otherwise(F.col("b.chunk")), F.when(first, F.col("b.chunk")).otherwise(F.col("a.chunk"))
    out = a.join(b, F.col("a.v") == F.col("b.id")).select(u.alias("a"), v.alias("b"), ca.alias("ca"), cb.alias("cb"), (1 - F.abs(dot)).alias("w"), u.alias("u"), v.alias("v"), F.when(dot < 0, -1).otherwise(1).alias("r"))
    graph = written(inside.unionByName(out), "graph")
    release(own)
    return graph


def _forest(edges: DataFrame, chunks: int, local: int, max_rounds: int) -> DataFrame:
    """``(id, comp, s)`` of the nodes that are not their component's own, from the edges of :func:`_graph`."""
    steps: list[DataFrame] = []
    while True:
        each = edges.withColumn("chunk", F.explode(F.array_distinct(F.array("ca", "cb"))))
        done = written(each.groupBy("chunk").applyInArrow(_contracted, _STEP), "contracted")
        steps.append(done.where(F.col("kind") == NODE).select(F.col("a").alias("id"), F.col("b").alias("comp"), F.col("f").alias("s")))
        inside = done.where(F.col("kind") == INSIDE).select("a", "b", F.col("c").alias("ca"), F.col("c").alias("cb"), "w", "u", "v", "r")
        end = F.struct("c", "a", "f")
        shared = done.where(F.col("kind") == SHARED).groupBy("u", "v").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.min("r").alias("r"), F.min(end).alias("p"), F.max(end).alias("q"))
        shared = shared.where("n = 2").select(F.col("p.a").alias("a"), F.col("q.a").alias("b"), F.col("p.c").alias("ca"), F.col("q.c").alias("cb"), "w", "u", "v", (F.col("r") * F.col("p.f") * F.col("q.f")).alias("r"))
        fewer = written(inside.unionByName(shared), "left")
        release(edges)
        edges, left = fewer, fewer.count()
        if not left:
            break
        together = max(2, local * chunks // left)
        chunks = -(-chunks // together)
        if left > 4 * local * chunks:  # chunks of two would hold too much
            steps.append(_boruvka(edges, max_rounds))
            break
        edges = edges.withColumns({c: F.floor(F.col(c) / together).cast("long") for c in ("ca", "cb")})
        edges._written_at = fewer._written_at
    return reduce(_then, reversed(steps))


def _then(later: DataFrame, first: DataFrame) -> DataFrame:
    """Where nodes are after both steps; those of ``later`` have not moved before."""
    to = later.select(F.col("id").alias("comp"), F.col("comp").alias("c2"), F.col("s").alias("s2"))
    return first.join(to, "comp", "left").select("id", F.coalesce("c2", "comp").alias("comp"), (F.col("s") * F.coalesce("s2", F.lit(1))).alias("s")).unionByName(later)


def orient_normals(points: DataFrame, edges: DataFrame, pid: str = "pid", scope: list[str] | None = None, local: int = 50_000, max_rounds: int = 40) -> DataFrame:
    """``points`` with signs of ``nx, ny, nz`` made consistent, and ``component`` (its smallest id).

    ``edges`` has columns ``src`` and ``dst``, or ``src`` and an array ``near``.
    ``scope`` names columns of ``points`` that no edge leaves, ``local`` about how
    many points a task holds; ``x``, ``y`` and ``z`` tell what is near what.
    """
    points, chunks = _chunked(points, pid, scope or [], local)  # read for edges, signs and heights
    n = points.select(F.col(pid).alias("id"), "chunk", "nx", "ny", "nz")
    state = _forest(_graph(n, edges), chunks, local, max_rounds)
    moved = state.select(F.col("id").alias(pid), F.col("comp").alias("_c"), F.col("s").alias("_t"))
    seen = points.drop("chunk").join(moved, pid, "left").withColumns({"_c": F.coalesce("_c", pid), "_t": F.coalesce("_t", F.lit(1))})
    seen = written(seen, "signs")
    flip = seen.groupBy("_c").agg(F.max_by(F.struct("nz", "_t"), F.struct("z", -F.col(pid))).alias("h"), F.min(pid).alias("component"))
    flip = flip.select("_c", "component", F.when(F.col("h.nz") * F.col("h._t") < 0, -1).otherwise(1).alias("_f"))
    out = seen.join(flip, "_c").withColumn("_s", F.col("_t") * F.col("_f"))
    return out.withColumns({c: F.col(c) * F.col("_s") for c in ("nx", "ny", "nz")}).drop("_s", "_t", "_f", "_c")


def _boruvka(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``(id, comp, s)`` by rounds over tables; tables of earlier rounds are deleted.

    The graph is contracted: after a round its nodes are components, edges
    inside one are gone and of parallel edges the lightest is left.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = written(ends.select("id", F.col("id").alias("comp"), F.lit(1).alias("s")), "state")
    for _ in range(max_rounds):
        ways = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("t")), F.struct(F.col("b").alias("c"), F.col("a").alias("t")))).alias("x"), "w", "u", "v", "r")
        picked = ways.groupBy("x.c").agg(F.min(F.struct("w", "u", "v", "x.t", "r")).alias("p")).select("c", F.col("p.t").alias("t"), F.col("p.r").alias("r"))
        picked = written(picked, "picked")
        if picked.isEmpty():
            release(picked, edges)
            return state
        # of two components that picked each other, the smaller id becomes the root
        root = (F.col("_tt") == F.col("c")) & (F.col("c") < F.col("t"))
        back = picked.select(F.col("c").alias("t"), F.col("t").alias("_tt"))
        up = written(picked.join(back, "t", "left").select("c", F.when(root, F.col("c")).otherwise(F.col("t")).alias("t"), F.when(root, 1).otherwise(F.col("r")).alias("r")), "up")
        moved = True
        while moved:  # pointer jumping, multiplying signs
            jump = up.select(F.col("c").alias("t"), F.col("t").alias("t2"), F.col("r").alias("r2"))
            nxt = written(up.join(jump, "t", "left").select("c", F.coalesce("t2", "t").alias("t"), (F.col("r") * F.coalesce("r2", F.lit(1))).alias("r"), (F.coalesce("t2", "t") != F.col("t")).alias("moved")), "up")
            moved = not nxt.where("moved").isEmpty()
            release(up)
            up = nxt
        merged = state.join(up.select(F.col("c").alias("comp"), "t", "r"), "comp", "left")
        merged = written(merged.select("id", F.coalesce("t", "comp").alias("comp"), (F.col("s") * F.coalesce("r", F.lit(1))).alias("s")), "state")
        # every component with an edge has picked one, so both ends have moved
        fewer = edges.join(up.select(F.col("c").alias("a"), F.col("t").alias("ta"), F.col("r").alias("ra")), "a").join(up.select(F.col("c").alias("b"), F.col("t").alias("tb"), F.col("r").alias("rb")), "b").where("ta <> tb")
        fewer = fewer.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.min(F.struct("w", "u", "v", (F.col("r") * F.col("ra") * F.col("rb")).alias("r"))).alias("p"))
        fewer = written(fewer.select("a", "b", "p.w", "p.u", "p.v", "p.r"), "contracted")
        release(state, picked, up, edges)
        state, edges = merged, fewer
    raise RuntimeError(f"orientation did not settle in {max_rounds} rounds")
