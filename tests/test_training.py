"""Training in rounds: warm starts, the plateau rule, the stop, and going on after a cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import learn, runlog, training
from pointloom.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 5, 1]
    y = (x[:, 0] + 0.2 * x[:, 1] > 0).astype(float) + (x[:, 2] > 1)
    df = spark.createDataFrame([(i, *map(float, v), float(c)) for i, (v, c) in enumerate(zip(x, y))], "pid long, a double, b double, c double, label double").cache()
    return df.where("pid % 4 <> 0"), df.where("pid % 4 = 0")


def plan(**more):
    return training.Plan(features=("a", "b", "c"), n_classes=3, hidden=5, **{"epochs": 6, "steps": 5, "learning_rate": 0.5} | more)


def log_of(spark, path):
    return [r.asDict() for r in training.run_log(spark, path).orderBy("epoch").collect()]


def test_rounds_follow_each_other(spark, rows, tmp_path):
    path = str(tmp_path / "run")
    last = training.train(*rows, plan(), path, "r")
    log = log_of(spark, path)
    assert [r["epoch"] for r in log] == [1, 2, 3, 4, 5, 6] and log[-1]["train_loss"] < log[0]["train_loss"] and log[-1]["val_acc"] > 0.5
    assert last.best_epoch == runlog.best(training.run_log(spark, path)).first().best_epoch
    # the best weights, saved, by an independent forward pass
    model = tables.load_model(f"{path}/best")
    best = training.read_states(spark, path).where(F.col("epoch") == last.best_epoch).first()
    w = np.array(best.weights)
    w1, b1, w2, b2 = w[:15].reshape(5, 3).T, w[15:20], w[20:35].reshape(3, 5).T, w[35:]
    assert np.allclose(model.stages[-1].weights.toArray(), w)
    val = rows[1].orderBy("pid").collect()
    x = np.array([(r.a, r.b, r.c) for r in val])
    fit = np.array([(r.a, r.b, r.c) for r in rows[0].collect()])
    z = (x - fit.mean(axis=0)) / fit.std(axis=0, ddof=1)
    forms = [(1 / (1 + np.exp(-(z @ a + b1))) @ c + b2) for a, c in ((w1, w2), (w[:15].reshape(3, 5), w[20:35].reshape(5, 3)))]
    pred = [r.pred for r in learn.score(model, rows[1], ["pid"]).orderBy("pid").collect()]
    assert any((f.argmax(axis=1) == pred).all() for f in forms)
    right = [f for f in forms if (f.argmax(axis=1) == pred).all()][0]
    p = right - right.max(axis=1, keepdims=True)
    p = p - np.log(np.exp(p).sum(axis=1, keepdims=True))
    y = np.array([int(r.label) for r in val])
    assert abs(-p[np.arange(len(y)), y].mean() - best.val_loss) < 1e-9 and abs((np.array(pred) == y).mean() - best.val_acc) < 1e-12


def test_a_cut_run_goes_on(spark, rows, tmp_path):
    training.train(*rows, plan(), str(tmp_path / "whole"), "r")
    training.train(*rows, plan(epochs=2), str(tmp_path / "cut"), "r")
    training.train(*rows, plan(), str(tmp_path / "cut"), "r")
    drop = lambda log: [{k: round(v, 12) if isinstance(v, float) else v for k, v in r.items() if k != "seconds"} for r in log]
    assert drop(log_of(spark, str(tmp_path / "whole"))) == drop(log_of(spark, str(tmp_path / "cut")))


def test_the_plateau_rule_acts_and_equals_its_replay(spark, rows, tmp_path):
    path = str(tmp_path / "flat")
    used = []

    def stand_still(df, state):
        used.append(state.learning_rate)
        return state.weights or [0.1] * (3 * 5 + 5 + 5 * 3 + 3)

    training.train(*rows, plan(epochs=14, patience=2, learning_rate=0.8, least_rate=0.15), path, "r", stand_still)
    log = training.run_log(spark, path)
    rates = [r.learning_rate for r in log.orderBy("epoch").collect()]
    assert rates == [0.8] * 3 + [0.4] * 3 + [0.2] * 3 + [0.15] * 5 and used == [0.8, *rates[:-1]]
    again = runlog.replay_rates(log, 0.8, 0.5, 2, 0.15).orderBy("epoch").collect()
    assert [r.learning_rate for r in again] == rates
    assert [(r.epoch, r.before, r.after) for r in runlog.rate_changes(log).orderBy("epoch").collect()] == [(4, 0.8, 0.4), (7, 0.4, 0.2), (10, 0.2, 0.15)]


def test_failures_stop_a_run(spark, rows, tmp_path):
    path = str(tmp_path / "bad")
    turns = iter(["ok", "boom", "boom", "nan", "ok", "boom", "boom", "boom", "never"])

    def sometimes(df, state):
        turn = next(turns)
        if turn == "boom":
            raise RuntimeError("no luck")
        return [math.nan] if turn == "nan" else [0.01 * (state.epoch + 1)] * 38

    last = training.train(*rows, plan(epochs=20), path, "r", sometimes)
    assert last.epoch == 8 and last.failures == 3 and next(turns) == "never"
    states = training.read_states(spark, path).orderBy("epoch").collect()
    assert [s.outcome for s in states] == ["ok", "failed", "failed", "unstable", "ok", "failed", "failed", "failed"]
    assert states[3].weights == states[0].weights and states[7].weights == states[4].weights
    found = [(r.first_epoch, r.length, r.stop_epoch) for r in runlog.failure_runs(training.run_log(spark, path)).orderBy("first_epoch").collect()]
    assert found == [(2, 2, 8), (6, 3, 8)]
    assert training.train(*rows, plan(epochs=20), path, "r", sometimes).epoch == 8
    with pytest.raises(ValueError, match="no training rows"):
        training.train(rows[0].limit(0), rows[1], plan(), str(tmp_path / "none"))


def test_a_failure_is_no_result(spark, rows, tmp_path, monkeypatch):
    """Failed and skipped rounds are told by their outcome and have no metrics; a query whose run stopped for failures fails."""
    path = str(tmp_path / "marked")
    turns = iter(["ok", "boom", "nan", "boom", "boom", "boom"])

    def sometimes(df, state):
        turn = next(turns)
        if turn == "boom":
            raise RuntimeError("no luck")
        return [math.nan] if turn == "nan" else [0.01] * 38

    last = training.train(*rows, plan(epochs=20), path, "r", sometimes)
    log = log_of(spark, path)
    assert [r["outcome"] for r in log] == ["ok", "failed", "unstable", "failed", "failed", "failed"] and last.error == "RuntimeError: no luck"
    assert [r["error"] for r in log] == [None, "RuntimeError: no luck", None, *["RuntimeError: no luck"] * 3]
    assert all((r["outcome"] == "ok") == (r[c] is not None) for r in log for c in ("train_loss", "train_acc", "val_loss", "val_acc"))
    assert [(r.first_epoch, r.length, r.stop_epoch) for r in runlog.failure_runs(training.run_log(spark, path)).orderBy("first_epoch").collect()] == [(2, 1, 6), (4, 3, 6)]
    from pointloom.plans import registry

    points = rows[0].select("pid", *[F.col(c).alias(n) for c, n in zip("abc", registry.NINE)], *[F.lit(0.5).alias(n) for n in registry.NINE[3:]], "label")
    monkeypatch.setattr(registry, "_learnable", lambda *a: points)

    def breaks(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(training, "gradient_steps", breaks)
    with pytest.raises(RuntimeError, match="stopped after 3 failed rounds: RuntimeError: lost"):
        registry.train_run_log(spark, "unused")


def test_passes_equal_mllib(spark, rows):
    """Loss, accuracy and gradient of the packed passes: by MLlib's model and by differences."""
    from pyspark.ml.functions import vector_to_array

    from pointloom.operators import descent

    df = rows[0].repartition(3)
    theirs = learn.pipeline(["a", "b", "c"], 3, "mlp", max_iter=20, hidden=5).fit(df)
    w = theirs.stages[-1].weights.toArray()
    scored = theirs.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    passes = descent.Passes(descent.packed(theirs.transform(df).drop("prediction", "probability", "rawPrediction"), "_x", "label", 3), [3, 5, 3])
    got = passes.at(w)
    assert got.n == 300 and abs(got.loss + np.mean([math.log(r.p[int(r.label)]) for r in scored])) < 1e-9
    assert abs(got.accuracy - np.mean([r.prediction == r.label for r in scored])) < 1e-12
    for i in (0, 16, 21, 37):
        step = np.eye(38)[i] * 1e-5
        slope = (passes.at(w + step).loss - passes.at(w - step).loss) / 2e-5
        assert abs(slope - got.gradient[i]) < 1e-6
    with pytest.raises(Exception, match="a label is none of 0 to 1"):
        descent.packed(theirs.transform(df), "_x", "label", 2)
