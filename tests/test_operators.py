"""Neighbours, geometry, graphs, orientation, run logs, metrics and learning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import vectors
from pointloom.operators import geometry, graph, knn, learn, metrics, orient, runlog

# fixed values: validation losses of a published 30-epoch run
VAL_LOSS = [
    1.364357, 1.292463, 1.303402, 1.228647, 1.144761, 1.164575, 1.120786, 1.164848, 1.052921, 1.022524, 1.062482, 1.016491, 0.961672, 1.061119, 0.941691,
    0.985569, 1.007492, 0.960005, 0.951106, 0.962290, 0.896663, 0.882450, 0.900468, 0.851219, 0.886012, 0.904174, 0.871235, 0.907725, 0.886926, 0.857959,
]


def cloud(spark, x, scope="s"):
    return spark.createDataFrame([(i, scope, *map(float, p)) for i, p in enumerate(x)], "pid long, area string, x double, y double, z double")


def brute(x, k, self_=True):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if self_ or j != i][:k]
        out |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["uniform", "clustered", "line", "same", "tiny"])
def test_knn(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "uniform": rng.integers(0, 50, (400, 3)),
        "clustered": np.concatenate([rng.integers(0, 5, (200, 3)), rng.integers(0, 5000, (60, 3))]),
        "line": np.stack([np.arange(150) ** 2, np.zeros(150), np.zeros(150)], axis=1),
        "same": np.ones((40, 3)),
        "tiny": rng.integers(0, 9, (4, 3)),
    }[kind].astype(float)
    df = cloud(spark, x)
    got = {(r.src, r.dst, r.rn) for r in knn.knn_join(df, df, 8, ["area"], per_tile=50).collect()}
    assert got == brute(x, 8)
    got = {(r.src, r.dst, r.rn) for r in knn.scope_knn(df, 8, ["area"], include_self=False).collect()}
    assert got == brute(x, 8, False)


def test_knn_of_a_cluster_in_a_wide_room(spark):
    """Dense tiles become scopes of their own; far points look across the gap."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1500, 3)) * 0.01, 5 + rng.normal(size=(300, 3)) * 1e-4, rng.uniform(-500, 500, (60, 3)), np.ones((30, 3)) * 7, [[np.nan, 0, 0], [np.inf, 1, 1]]])
    df = cloud(spark, x)
    good = x[:-2]
    for self_ in (True, False):
        got = {(r.src, r.dst, r.rn) for r in knn.knn_join(df, df, 6, ["area"], per_tile=60, include_self=self_).collect()}
        assert got == brute(good, 6, self_)
    d = ((good[:, None] - good[None]) ** 2).sum(axis=2)
    exp = {(i, j, r) for i, j, r in brute(good, 6) if d[i, j] <= 0.02 * 0.02}
    assert {(r.src, r.dst, r.rn) for r in knn.radius_knn(df, df, 6, 0.02, ["area"], per_tile=60).collect()} == exp


def test_orientation_in_one_task_and_in_rounds(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 1, (150, 3))
    df = cloud(spark, x).withColumn("area", F.when(F.col("pid") % 3 == 0, "a").otherwise("b"))
    near = knn.scope_knn(df, 6, ["area"])
    n = geometry.with_normal(geometry.covariance(near, df)).select(F.col("src").alias("pid"), "nx", "ny", "nz").join(df, "pid")
    rows = [sorted((r.pid, r.component, r.nx, r.ny, r.nz) for r in orient.orient_normals(n, near, **how).collect()) for how in ({"scope": ["area"]}, {"scope": ["area"], "local": 60}, {})]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 150


def plain_orientation(normal, z, links):
    """Component and normal of every point: Kruskal's forest, the highest point of a part looks up."""
    part, sign = {p: {p} for p in normal}, dict.fromkeys(normal, 1)
    dot = lambda a, b: float(normal[a][0] * normal[b][0] + normal[a][1] * normal[b][1] + normal[a][2] * normal[b][2])
    for _, a, b in sorted({(1 - abs(dot(a, b)), min(a, b), max(a, b)) for a, b in links if a != b}):
        if part[a] is not part[b]:
            if dot(a, b) * sign[a] * sign[b] < 0:
                sign |= {p: -sign[p] for p in part[b]}
            part[a] |= part[b]
            part |= dict.fromkeys(part[b], part[a])
    out = []
    for p in normal:
        top = max(part[p], key=lambda q: (z[q], -q))
        turn = sign[p] * (-1 if normal[top][2] * sign[top] < 0 else 1)
        out.append((p, min(part[p]), *[turn * c for c in normal[p]]))
    return sorted(out)


@pytest.mark.parametrize("kind", ["near", "far"])
def test_orientation_of_a_scope_in_chunks(spark, kind, monkeypatch):
    """A scope of many chunks takes steps that shrink it, rounds over tables only where edges lead anywhere."""
    rng = np.random.default_rng(16)
    x, normal = rng.uniform(0, 1, (600, 3)), rng.normal(size=(600, 3))
    normal[:200] = [0, 0, 1]  # equal weights
    normal[200:] /= np.linalg.norm(normal[200:], axis=1)[:, None]
    links = [(a, b) for a, b, _ in brute(x, 6)] if kind == "near" else [(int(a), int(b)) for a, b in rng.integers(0, 590, (4000, 2))]
    rounds, plain = [], orient._boruvka
    monkeypatch.setattr(orient, "_boruvka", lambda *a: rounds.append(1) or plain(*a))
    df = spark.createDataFrame([(i, "s", *map(float, (*p, *v))) for i, (p, v) in enumerate(zip(x, normal, strict=True))], "pid long, area string, x double, y double, z double, nx double, ny double, nz double")
    got = orient.orient_normals(df, spark.createDataFrame(links, "src long, dst long"), scope=["area"], local=40 if kind == "near" else 10)
    exp = plain_orientation({i: tuple(map(float, v)) for i, v in enumerate(normal)}, dict(enumerate(x[:, 2])), links)
    assert sorted((r.pid, r.component, r.nx, r.ny, r.nz) for r in got.collect()) == exp
    assert bool(rounds) == (kind == "far")


def test_block_scorer(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, *map(float, v), float(v[0] > v[1])) for i, v in enumerate(rng.normal(size=(120, 3)))], "pid long, a double, b double, c double, label double").withColumn("c", F.lit(2.0))
    model = learn.pipeline(["a", "b", "c"], 2, "mlp", max_iter=20).fit(df)
    rows = df.orderBy("pid").collect()
    pred = learn.block_scorer(model)(np.array([(r.a, r.b, r.c) for r in rows]), None).argmax(axis=1)
    assert [r.pred for r in learn.score(model, df, ["pid"]).orderBy("pid").collect()] == list(pred)


def test_missing_rows(spark):
    from pyspark.sql import types as T

    from pointloom.sources import clouds

    empty = spark.createDataFrame([], "pid long, x double, label double")
    with pytest.raises(ValueError, match="no training points"):
        clouds.require_rows(empty, "training points")
    with pytest.raises(ValueError, match="no training rows"):
        learn.select_model({"rf": learn.pipeline(["x"], 2, "rf")}, empty, empty)
    assert clouds.or_empty(spark, None, "a int, b string").schema == T.StructType.fromDDL("a int, b string")


def test_radius_knn(spark):
    x = np.random.default_rng(4).integers(0, 20, (300, 3)).astype(float)
    df = cloud(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    exp = {(i, j, r) for i, j, r in brute(x, 6) if d[i, j] <= 16}
    assert {(r.src, r.dst, r.rn) for r in knn.radius_knn(df, df, 6, 4.0, ["area"]).collect()} == exp


def test_eigen(spark):
    rng = np.random.default_rng(5)
    rows, exp = [], []
    for i in range(60):
        a = rng.normal(size=(8, 3)) * [1, 1, 0 if i % 3 == 0 else 1]
        c = np.cov(a, rowvar=False) if i else np.eye(3) * 2
        rows.append((i, *map(float, (c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2]))))
        exp.append(np.linalg.eigh(c))
    df = spark.createDataFrame(rows, "i int, xx double, yy double, zz double, xy double, xz double, yz double")
    m = [F.col(c) for c in geometry.PAIRS]
    low, mid, high = vectors.eigenvalues(*m)
    df = df.withColumn("low", low).withColumn("mid", mid).withColumn("high", high)
    v = vectors.smallest_eigenvector(F.col("low"), F.col("high"), *m)
    for r in df.withColumns({f"v{k}": v[k] for k in range(3)}).collect():
        w, e = exp[r.i]
        assert np.allclose([r.low, r.mid, r.high], w, atol=1e-9)
        assert r.v0 is None if r.i == 0 else abs(np.dot([r.v0, r.v1, r.v2], e[:, 0])) > 1 - 1e-6


def test_planes(spark):
    g = np.array([(i, j, 0) for i in range(8) for j in range(8)], float)
    flat = geometry.geometric_features(cloud(spark, g), ["area"], 9, 3.0).collect()
    assert all(r.curvature < 1e-9 and r.verticality < 1e-9 and r.nz > 0 for r in flat)
    wall = geometry.geometric_features(cloud(spark, g[:, [0, 2, 1]]), ["area"], 9, 3.0).collect()
    assert all(r.curvature < 1e-9 and abs(r.verticality - 1) < 1e-9 for r in wall)
    line = geometry.with_normal(geometry.covariance(knn.scope_knn(cloud(spark, g[:8] * [0, 1, 0]), 5, ["area"]), cloud(spark, g[:8] * [0, 1, 0]))).collect()
    assert all((r.nx, r.ny, r.nz) == (0, 0, 1) for r in line)
    one = geometry.with_curvature(geometry.covariance(knn.scope_knn(cloud(spark, g[:1]), 5, ["area"]), cloud(spark, g[:1]))).first()
    assert one.n == 1 and one.curvature is None


def test_sphere_orientation(spark):
    i = np.arange(160) + 0.5
    phi, th = np.arccos(1 - 2 * i / 160), np.pi * (1 + 5**0.5) * i
    x = np.stack([np.cos(th) * np.sin(phi), np.sin(th) * np.sin(phi), np.cos(phi)], axis=1)
    df = cloud(spark, x)
    near = knn.scope_knn(df, 8, ["area"])
    n = geometry.with_normal(geometry.covariance(near, df)).select(F.col("src").alias("pid"), "nx", "ny", "nz")
    got = orient.orient_normals(n.join(df, "pid"), near).collect()
    assert len({r.component for r in got}) == 1
    assert all(np.dot([r.nx, r.ny, r.nz], [r.x, r.y, r.z]) > 0.5 for r in got)


def test_graph(spark):
    x = np.array([(0, 0, 0), (1, 0, 0), (3, 0, 0), (9, 0, 0)], float)
    df = cloud(spark, x).withColumn("f", F.col("pid") * 10)
    e = knn.scope_knn(df, 1, ["area"], include_self=False)
    center = {r.pid: r.max_f for r in graph.neighbour_max(e, df, ["f"]).collect()}
    reverse = {r.pid: r.max_f for r in graph.neighbour_max(e, df, ["f"], direction="reverse").collect()}
    assert center == {0: 10, 1: -10, 2: -10, 3: -10} and reverse == {0: 10, 1: 10, 2: 10, 3: 0}
    flat = graph.interpolate(knn.knn_join(df, df.where("pid < 3"), 3, ["area"]), df.withColumn("f", F.lit(7.0)), ["f"])
    assert all(abs(r.f - 7) < 1e-12 for r in flat.collect())
    fps = {r.pid for r in graph.farthest_points(df.withColumn("block_id", F.lit(1)), ratio=0.5).collect()}
    assert fps == {0, 3}


def test_rate_replay(spark):
    log = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(VAL_LOSS)], "run string, epoch int, val_loss double")
    got = [r.learning_rate for r in runlog.replay_rates(log).orderBy("epoch").collect()]
    assert got == [0.001] * 19 + [0.0005] * 9 + [0.00025] * 2


def test_run_summary(spark):
    log = spark.createDataFrame([("r", e, 1.0 / e, 0.5, 2.0 / e, a) for e, a in ((2, 0.7), (1, 0.6), (3, 0.7))], "run string, epoch int, train_loss double, train_acc double, val_loss double, val_acc double")
    row = runlog.summary(log, {"batch_size": 4}).first()
    assert row.best_performance.best_epoch == 2 and row.training_history.val_acc == [0.6, 0.7, 0.7] and row.training_config.batch_size == 4
    fail = spark.createDataFrame([("r", e, float(e not in (2, 3, 4, 6)), 0.0) for e in range(1, 8)], "run string, epoch int, train_loss double, train_acc double")
    assert [(r.first_epoch, r.length, r.stop_epoch) for r in runlog.failure_runs(fail).orderBy("first_epoch").collect()] == [(2, 3, 4), (6, 1, 4)]


def test_metrics(spark):
    df = metrics.with_scores(spark.createDataFrame([(1, [0.0, 1000.0]), (0, [2.0, 2.0]), (-1, [1.0, 0.0])], "y int, scores array<double>"))
    assert [r.pred for r in df.collect()] == [1, 0, 0]
    row = metrics.nll(df, []).first()
    assert row.n == 2 and abs(row.loss - np.log(2) / 2) < 1e-12
    b = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "loss double")
    assert metrics.batch_mean_loss(b, [], F.col("loss") > 5, "clean").first().loss == 1.5
    assert metrics.batch_mean_loss(b, [], F.col("loss") > 5, "reference").first().loss == 1.0


def test_learning(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, "a", float(v), float(v > 0.5)) for i, v in enumerate(rng.random(200))], "pid long, area string, x double, label double")
    name, model, seen = learn.select_model({"rf": learn.pipeline(["x"], 2, "rf", trees=5), "mlp": learn.pipeline(["x"], 2, "mlp", max_iter=5)}, df, df)
    assert seen[name] == max(seen.values()) > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    got = learn.score(PipelineModel.load(str(tmp_path / "m")), df, ["pid"])
    merged = learn.merge_predictions(df, got.where("pid < 100"), ["pid"])
    assert merged.count() == 200 and merged.where("pid >= 100 AND pred <> 0").count() == 0


def test_features_compile(spark):
    """Normals and curvature stay below the size of a method that Java compiles (Spark falls back, slowly or with an error)."""
    df = cloud(spark, np.random.default_rng(4).random((60, 3)))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        f = geometry.geometric_features(df.withColumns({c: F.lit(1) for c in "rgb"}), ["area"], 8, 0.5)
        rows = geometry.feature_vector(f).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(rows) == 60 and all(len(r.features) == 9 for r in rows)


def test_normals_of_batches(spark):
    """The batched eigenvectors are those of the column expressions, degenerate sets included."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(50, 5, 3)) * [1.0, 0.5, 0.1]
    m = np.concatenate([np.einsum("nij,nik->njk", a, a), np.zeros((1, 3, 3)), np.eye(3)[None], np.diag([1.0, 0, 0])[None]])
    got = vectors.smallest_eigenvectors(*[m[:, i, j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])
    for v, s in zip(got[:50], m[:50], strict=True):
        assert abs(abs(v @ np.linalg.eigh(s)[1][:, 0]) - 1) < 1e-9
    assert np.isnan(got[50:]).all()


def test_radius_moments_in_crowded_rooms(spark):
    """A radius that holds far more than k points: the moments of the k nearest, in rounds from a small radius, without a table of edges."""
    x = np.random.default_rng(12).random((900, 3))
    df = cloud(spark, x)
    names = ["n", "mx", "xx", "xy"]
    got = knn.knn_moments(df, 6, 0.9, ["area"], per_tile=60, columns=[f"{c}_r" for c in names], only=True).collect()
    near = {i: [] for i in range(len(x))}
    for i, j, _ in sorted(brute(x, 6), key=lambda e: (e[0], e[2])):
        near[i].append(x[j])
    assert len(got) == 900
    for r in got:
        c = np.cov(np.array(near[r.src]).T)
        assert r.n_r == 6 and np.allclose([r.mx_r, r.xx_r, r.xy_r], [np.mean(near[r.src], axis=0)[0], c[0, 0], c[0, 1]])


def test_many_small_scopes_share_a_call(spark):
    """Scopes of four points are ranked in packs: as many calls of Python as packs, and each scope by itself."""
    x = np.random.default_rng(13).random((1200, 3))
    df = spark.createDataFrame([(i, i % 300, *map(float, p)) for i, p in enumerate(x)], "pid long, room long, x double, y double, z double")
    got = {(r.src, r.dst, r.rn) for r in knn.knn_join(df, df, 3, ["room"]).collect()}
    assert got == {(s * 1 + 300 * i, s + 300 * j, rn) for s in range(300) for i, j, rn in brute(x[s::300], 3)}
    starts = knn._starts(np.array([1, 1, 2, 2, 2]), np.array([0, 0, 0, 1, 1]))
    assert starts.tolist() == [0, 2, 3, 5]
    parts = knn._parts(x, 96)
    assert max(map(len, parts)) <= 96 and sorted(np.concatenate(parts).tolist()) == list(range(1200))


def test_farthest_points_of_cut_batches(spark):
    """Blocks that a batch cuts in two are sampled whole, and many blocks share a batch."""
    x = np.random.default_rng(14).random((600, 3))
    df = spark.createDataFrame([(i % 60, i, *map(float, p)) for i, p in enumerate(x)], "block_id long, pid long, x double, y double, z double")
    calls = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = {tuple(r) for r in graph.farthest_points(df).collect()}
    spark.conf.set(calls, "7")
    try:
        found = graph.farthest_points(df)
        assert {tuple(r) for r in found.collect()} == whole
    finally:
        spark.conf.unset(calls)
    assert len(whole) == 60 * 3 and {(b, b, 1) for b in range(60)} <= whole
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_expressions_that_java_translates(spark):
    """Places on the curve and curvatures: right, and in methods below the 8,000 bytes beyond which Java leaves them interpreted."""
    import re

    x = np.random.default_rng(15).random((200, 3))
    df = spark.createDataFrame([(i, "A", *map(float, p)) for i, p in enumerate(x)], "pid long, area string, x double, y double, z double")
    spread = lambda c: sum(((int(c) >> i) & 1) << (3 * i) for i in range(orient.BITS))
    cells = np.floor((x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0)).max() * ((1 << orient.BITS) - 1))
    curve = orient._curve(df, ["area"], ["x", "y", "z"])
    assert {r.pid: r["_at"] for r in curve.collect()} == {i: sum(spread(c) << k for k, c in enumerate(cell)) for i, cell in enumerate(cells)}
    m = df.select("pid", F.when(F.col("pid") % 3 == 0, 2).otherwise(20).alias("n"), *[F.when(F.col("pid") != 7, F.col(c) * f).alias(name) for name, c, f in zip(geometry.PAIRS, "xyzxyz", (3, 4, 5, 1, 1, 1), strict=True)])
    curved = geometry.with_curvature(m)
    low, _, _ = vectors.eigenvalues(*[F.col(c) for c in geometry.PAIRS])
    exp = {r.pid: None if r.low is None else 0.0 if r.n == 2 else max(r.low, 0.0) / (r.xx + r.yy + r.zz + 1e-9) for r in m.withColumn("low", low).collect()}
    got = {r.pid: r.curvature for r in curved.collect()}
    assert got[7] is None and all(exp[i] is None if v is None else abs(v - exp[i]) < 1e-9 for i, v in got.items())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (curve, curved):
            said = spark._jvm.PythonSQLUtils.explainString(out.select("*")._jdf.queryExecution(), "codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
            assert sizes and max(sizes) < 8000, sizes
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_levels_move_only_points(spark, monkeypatch):
    """The levels of cut batches are those of whole ones, also in blocks of one to five points, and no table is written for them."""
    x = np.random.default_rng(16).random((400, 3))
    size = [1, 2, 3, 5, 64]
    block = np.repeat(np.arange(30), [size[i % 5] for i in range(30)])[:400]
    df = spark.createDataFrame([(int(b), i, *map(float, p), i % 7) for i, (b, p) in enumerate(zip(block, x))], "block_id long, pid long, x double, y double, z double, r int")
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or df)
    monkeypatch.setattr(knn, "written", lambda df, name: tables.append(name) or df)
    whole = {r.pid: list(r.features) for r in graph.encode_decode(df, ["r"], k=4).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        cut = {r.pid: list(r.features) for r in graph.encode_decode(df, ["r"], k=4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not tables and whole == cut and len(whole) == len(block) and {len(v) for v in whole.values()} == {2 + 4 + 8 + 16}
    assert whole[0] == [0.0] * 30  # a block of one point with value 0
