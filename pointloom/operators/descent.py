"""Loss, accuracy and gradient of a perceptron over a whole table, one pass a call, and a descent on them.

The table is packed once: a row holds some thousands of points as two arrays of
bytes, scaled features and labels.  A pass multiplies matrices in tasks and
brings one sum per task to the driver; the weights travel with the pass.  Layers,
their order in the flat weights and the loss are those of MLlib's perceptron.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

#: Points of a packed row, and those multiplied at a time (which stay in a core's cache).
ROWS, AT_ONCE = 8192, 512
_SUMS = "n long, loss double, hits long, gradient binary"


@dataclass(frozen=True)
class Seen:
    """Sums over a table at some weights: points, mean loss, accuracy and mean gradient."""

    n: int
    loss: float
    accuracy: float
    gradient: np.ndarray


def packed(rows: DataFrame, features: str, label: str, n_classes: int) -> DataFrame:
    """``(x, y)``: a column of vectors and the labels, many points a row, written."""
    flat = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, held = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"x": pa.array([np.concatenate(xs).tobytes()]), "y": pa.array([np.concatenate(ys).tobytes()])})

        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            if not ((y >= 0) & (y < n_classes) & (y == np.floor(y))).all():
                raise ValueError(f"a label is none of 0 to {n_classes - 1}")
            xs.append(b.column("x").flatten().to_numpy())
            ys.append(y.astype(np.int32))
            held += len(y)
            if held >= ROWS:
                yield row()
                xs, ys, held = [], [], 0
        if held:
            yield row()

    # a file is the least that a task reads: some for every core, alike in size
    files = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return written(flat.mapInArrow(pack, "x binary, y binary").repartition(files), "packed")


def _layers(sizes: list[int], w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs, outputs) and bias of every layer, as views of the flat weights."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def sums(sizes: list[int], w: np.ndarray, x: np.ndarray, y: np.ndarray, slope: bool = True) -> tuple[float, int, np.ndarray]:
    """Summed loss, hits and summed gradient of points: sigmoid layers, softmax at the end."""
    layers, ins = _layers(sizes, w), [x]
    for m, b in layers[:-1]:
        with np.errstate(over="ignore"):
            ins.append(1 / (1 + np.exp(-(ins[-1] @ m + b))))
    m, b = layers[-1]
    s = ins[-1] @ m + b
    hits = int((s.argmax(axis=1) == y).sum())
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    total = p.sum(axis=1)
    at = np.arange(len(y))
    loss = float((np.log(total) - s[at, y]).sum())
    gradient = np.zeros(len(w))
    if slope:
        delta = p / total[:, None]
        delta[at, y] -= 1
        for (m, _), (gm, gb), h in zip(layers[::-1], _layers(sizes, gradient)[::-1], ins[::-1], strict=True):
            gm += h.T @ delta
            gb += delta.sum(axis=0)
            if h is not x:
                delta = (delta @ m.T) * h * (1 - h)
    return loss, hits, gradient


class Passes:
    """Passes over a packed table; the last one is kept, so asking again for the same weights costs nothing."""

    def __init__(self, table: DataFrame, sizes: list[int], slope: bool = True):
        self.table, self.sizes, self.slope = table, sizes, slope
        self.last: tuple[np.ndarray, Seen] | None = None

    def at(self, weights: np.ndarray) -> Seen:
        w, sizes, slope = np.asarray(weights, np.float64), self.sizes, self.slope
        if self.last is not None and np.array_equal(self.last[0], w):
            return self.last[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, hits, gradient = 0, 0.0, 0, np.zeros(len(w))
            for b in batches:
                for x, y in zip(b.column("x"), b.column("y"), strict=True):
                    y = np.frombuffer(y.as_buffer(), np.int32)
                    x = np.frombuffer(x.as_buffer(), np.float64).reshape(len(y), -1)
                    n += len(y)
                    for i in range(0, len(y), AT_ONCE):
                        one = sums(sizes, w, x[i : i + AT_ONCE], y[i : i + AT_ONCE], slope)
                        loss, hits, gradient = loss + one[0], hits + one[1], gradient + one[2]
            yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "hits": [hits], "gradient": [gradient.tobytes()]})

        parts = self.table.mapInArrow(run, _SUMS).collect()  # one row of some kilobytes per task
        n = sum(p.n for p in parts)
        gradient = sum((np.frombuffer(p.gradient, np.float64) for p in parts), np.zeros(len(w)))
        got = Seen(n, sum(p.loss for p in parts) / n, sum(p.hits for p in parts) / n, gradient / n) if n else Seen(0, np.nan, np.nan, gradient)
        self.last = (w, got)
        return got


def gradient_steps(passes: Passes, w: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """``steps`` steps of plain gradient descent on the whole table."""
    for _ in range(steps):
        w = w - rate * passes.at(w).gradient
    return w
