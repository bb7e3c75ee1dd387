"""Training in rounds: warm starts, validation, a plateau rule and a stop that act while it runs.

A round is a short gradient descent of a perceptron over the whole training
table, started from the weights of the round before (:mod:`.descent`).  After
each round both tables are scored in one pass each; that of the training table
is also the first of the next round.  Everything the next round needs is
one row of a state table, so a run that was cut off goes on where it stopped,
and the run log is a projection of that table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import release
from ..sources.clouds import require_rows
from ..sources.tables import exists, load_model, save_model
from .descent import Passes, gradient_steps, packed

STATE = "run string, epoch int, outcome string, train_loss double, train_acc double, val_loss double, val_acc double, learning_rate double, seconds double, weights array<double>, plateau_best double, plateau_bad int, failures int, best_epoch int, best_val_acc double, error string"


@dataclass
class State:
    """What the next round starts from; one row of the state table."""

    run: str
    epoch: int = 0
    outcome: str = "ok"
    train_loss: float | None = None
    train_acc: float | None = None
    val_loss: float | None = None
    val_acc: float | None = None
    learning_rate: float = 1e-3
    seconds: float = 0.0
    weights: list[float] = field(default_factory=list)
    plateau_best: float = math.inf
    plateau_bad: int = 0
    failures: int = 0
    best_epoch: int = 0
    best_val_acc: float = 0.0
    error: str | None = None


@dataclass(frozen=True)
class Plan:
    """Parameters of a run."""

    features: tuple[str, ...]
    n_classes: int
    label: str = "label"
    hidden: int = 32
    epochs: int = 30
    steps: int = 10
    learning_rate: float = 1e-3
    factor: float = 0.5
    patience: int = 4
    least_rate: float = 1e-6
    relative: float = 1e-4
    max_failures: int = 3
    seed: int = 42

    @property
    def layers(self) -> list[int]:
        return [len(self.features), self.hidden, self.n_classes]


def perceptron(plan: Plan, rate: float, weights: list[float], steps: int) -> MultilayerPerceptronClassifier:
    """The classifier of one round; ``steps`` 0 makes a model of the weights as they are."""
    net = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=plan.label, layers=plan.layers, solver="gd", stepSize=rate, maxIter=steps, tol=0.0, seed=plan.seed)
    return net.setInitialWeights(Vectors.dense(weights)) if weights else net


def after(state: State, plan: Plan, outcome: str, weights: list[float], metrics: tuple[float, float, float, float], seconds: float, error: str | None = None) -> State:
    """The state after a round.

    A failed round (an error) counts towards the stop; a round with a metric
    that is not finite is skipped.  Both have no metrics and leave weights and
    rate as they were.  A good round moves the plateau
    rule by its validation loss and the best epoch by its accuracy.
    """
    out = State(**asdict(state) | {"epoch": state.epoch + 1, "outcome": outcome, "seconds": seconds, "error": error})
    out.failures = state.failures + 1 if outcome == "failed" else 0
    if outcome != "ok":
        out.train_loss = out.train_acc = out.val_loss = out.val_acc = None
        return out
    out.train_loss, out.train_acc, out.val_loss, out.val_acc = metrics
    out.weights = weights
    if out.val_loss < state.plateau_best * (1 - plan.relative):
        out.plateau_best, out.plateau_bad = out.val_loss, 0
    else:
        out.plateau_bad = state.plateau_bad + 1
    if out.plateau_bad > plan.patience:
        out.learning_rate, out.plateau_bad = max(state.learning_rate * plan.factor, plan.least_rate), 0
    if out.val_acc > state.best_val_acc:
        out.best_epoch, out.best_val_acc = out.epoch, out.val_acc
    return out


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The state table of a run, a row per round."""
    return spark.read.schema(STATE).parquet(f"{path}/states/*") if exists(spark, f"{path}/states") else spark.createDataFrame([], STATE)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log: all rounds with the rate after each; only those whose ``outcome`` is 'ok' have metrics."""
    return read_states(spark, path).select("run", "epoch", "train_loss", "train_acc", "val_loss", "val_acc", "learning_rate", "seconds", "outcome", "error")


def train(train_rows: DataFrame, val_rows: DataFrame, plan: Plan, path: str, run: str = "run", descend: Callable[[DataFrame, State], list[float]] | None = None) -> State:
    """Run the rounds below ``path`` and return the last state.

    ``path`` gets ``scaler``, ``states/epoch=N`` and ``best``, a saved pipeline
    of the best epoch's weights.  What is there already is not done again: a
    second call goes on after the last complete round, up to ``plan.epochs`` or
    to the stop after ``plan.max_failures`` failed rounds in a row.
    ``descend`` replaces the descent of a round: from the scaled rows and the
    state to new weights; an error it raises is a failed round.
    """
    spark = train_rows.sparkSession
    require_rows(train_rows, "training rows")
    require_rows(val_rows, "validation rows")
    if not exists(spark, f"{path}/scaler"):
        steps = [VectorAssembler(inputCols=list(plan.features), outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]
        save_model(Pipeline(stages=steps).fit(train_rows), f"{path}/scaler")
    scaler = load_model(f"{path}/scaler")
    fit_on, check_on = (scaler.transform(rows).select("_x", plan.label) for rows in (train_rows, val_rows))
    few = fit_on.limit(1)
    last = read_states(spark, path).orderBy(F.desc("epoch")).first()
    state = State(**last.asDict()) if last else State(run, learning_rate=plan.learning_rate)
    if state.epoch >= plan.epochs or state.failures >= plan.max_failures:
        return state
    packs = [packed(rows, "_x", plan.label, plan.n_classes) for rows in (fit_on, check_on)]
    fit, check = (Passes(table, plan.layers, slope) for table, slope in zip(packs, (True, False), strict=True))

    def default(rows: DataFrame, state: State) -> list[float]:
        weights = state.weights or perceptron(plan, state.learning_rate, [], 0).fit(few).weights.toArray()
        return gradient_steps(fit, np.asarray(weights), state.learning_rate, plan.steps).tolist()

    while state.epoch < plan.epochs and state.failures < plan.max_failures:
        began, before = time.time(), state
        outcome, weights, metrics, said = "unstable", state.weights, (math.nan,) * 4, None
        try:
            weights = (descend or default)(fit_on, state)
        except Exception as error:  # a descent that fails is an outcome; several in a row end the run
            outcome, said = "failed", f"{type(error).__name__}: {error}"
        if outcome != "failed" and np.isfinite(weights).all():
            metrics = tuple(v for seen in (fit.at(np.asarray(weights)), check.at(np.asarray(weights))) for v in (seen.loss, seen.accuracy))
            outcome = "ok" if all(map(math.isfinite, metrics)) else "unstable"
        state = after(state, plan, outcome, weights, metrics, time.time() - began, said)
        if state.best_epoch > before.best_epoch:
            net = perceptron(plan, state.learning_rate, state.weights, 0).fit(few)
            save_model(PipelineModel(stages=[*scaler.stages, net]), f"{path}/best")
        row = spark.createDataFrame([tuple(asdict(state).values())], STATE)
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/states/epoch={state.epoch:05}")
    release(*packs)
    return state
