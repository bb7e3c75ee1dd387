"""Per-point classifiers: fitting, selection, scoring of blocks, merging, evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.clouds import require_rows
from . import metrics


def pipeline(features: list[str], n_classes: int, kind: str = "mlp", label: str = "label", max_iter: int = 50, hidden: int = 32, step: float = 0.03, trees: int = 20, depth: int = 8, seed: int = 42) -> Pipeline:
    """Assemble, standardise (mean and deviation) and classify."""
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]
    if kind == "mlp":
        stages.append(MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[len(features), hidden, n_classes], maxIter=max_iter, stepSize=step, seed=seed))
    elif kind == "rf":
        stages.append(RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return Pipeline(stages=stages)


def score(model: PipelineModel, points: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``pred``."""
    return model.transform(points).select(*keep, F.col("prediction").cast("int").alias("pred"))


def select_model(candidates: dict[str, Pipeline], train: DataFrame, val: DataFrame, label: str = "label") -> tuple[str, PipelineModel, dict[str, float]]:
    """Fit all candidates and keep the one with the best validation accuracy, the first of equals."""
    require_rows(train, "training rows")
    require_rows(val, "validation rows")
    found: dict[str, float] = {}
    best: tuple[str, PipelineModel] | None = None
    for name, p in candidates.items():
        model = p.fit(train)
        row = metrics.accuracy(score(model, val, [label]), [], label).first()
        found[name] = float(row["accuracy"] or 0.0) if row else 0.0
        if best is None or found[name] > found[best[0]]:
            best = (name, model)
    if best is None:
        raise ValueError("no candidates")
    return best[0], best[1], found


def evaluate(scored: DataFrame, by: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Accuracy by group, and per-class intersection over union."""
    return metrics.accuracy(scored, by, label), metrics.class_iou(metrics.confusion(scored, label), label)


def block_scorer(model: PipelineModel) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A fitted perceptron pipeline as a function from (features, positions) of a block to class scores."""
    scaler, net = model.stages[-2], model.stages[-1]
    shift, scale = np.array(scaler.mean.toArray()), np.array(scaler.std.toArray())
    scale = np.where(scale == 0, 0, 1 / np.where(scale == 0, 1, scale))
    sizes, flat, layers, at = list(net.getLayers()), np.array(net.weights.toArray()), [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b

    def scores(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
        h = (x - shift) * scale
        for i, (w, b) in enumerate(layers):
            h = h @ w + b
            if i < len(layers) - 1:
                h = 1 / (1 + np.exp(-h))
        return h

    return scores


def score_blocks(nested: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], keys: list[str]) -> DataFrame:
    """Apply a user function to each block: (features, positions) to class scores.

    The function sees the padded block; only the first ``num_valid``
    predictions are returned, as ``(keys, offset, pred)``.  A block crosses to
    Python as two flat arrays.
    """
    kinds = dict(nested.dtypes)

    def run(batches):
        for df in batches:
            for row in df.itertuples(index=False):
                x, pos = (np.asarray(a, np.float32).reshape(row.size_, -1) for a in (row.x_, row.pos_))
                pred = np.asarray(fn(x, pos)).argmax(axis=1)[: row.num_valid].astype(np.int32)
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "offset": np.arange(len(pred), dtype=np.int32), "pred": pred})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "offset int", "pred int"])
    flat = [F.flatten(F.col(f"points.{f}")).alias(f"{f}_") for f in ("x", "pos")]
    return nested.select(*keys, "num_valid", F.size("points").alias("size_"), *flat).mapInPandas(run, schema)


def merge_predictions(points: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All points with their prediction; points without one get class 0."""
    return points.join(predictions.select(*keys, "pred"), keys, "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


def vector_length(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Length of the merged prediction vector: the largest block end."""
    return blocks.groupBy(*by).agg(F.max("end_idx").alias("length"))


def score_clouds(points: DataFrame, model: PipelineModel | None, features: Callable[[DataFrame], DataFrame], rule: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Batch scoring of clouds: features, classes (by model or rule), merge in point order."""
    ready = features(points)
    got = score(model, ready, ["cloud_id", "point_idx"]) if model is not None else rule(ready).select("cloud_id", "point_idx", "pred")
    return merge_predictions(points, got, ["cloud_id", "point_idx"])
