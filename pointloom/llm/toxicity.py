"""Toxic spans and document scores with a conditional random field.

Only documents carry labels, so the labelled tokens are derived from them: a
word of a toxic training document is a toxic token when the word itself or its
opening letters are far more frequent in toxic documents than in clean ones
(a smoothed log odds of document frequencies); every word of a clean document
is a clean token.  The field then learns from affixes, n-grams, lexicon and
transitions, its marginals give offending offsets, and a small logistic curve
fitted on the training documents turns them into a document score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Crf, bounded_sample, fit, in_portions, some_window, spans_of, words_of


@dataclass
class ToxicityModel:
    """The field (label 1 is toxic) and the curve from marginals to a score."""

    field: Crf | None
    curve: tuple[float, float, float]

    def inputs(self, p: np.ndarray) -> tuple[float, float]:
        """Log odds of the worst word, and log of the expected toxic words."""
        if not len(p):
            return -12.0, 0.0
        worst = float(np.clip(p[:, 1].max(), 1e-6, 1 - 1e-6))
        return math.log(worst / (1 - worst)), math.log1p(float(p[p[:, 1] >= 0.05, 1].sum()))

    def score(self, p: np.ndarray) -> float:
        a, b, c = self.curve
        x, y = self.inputs(p)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def _keys(word: str) -> list[str]:
    return [word + "$", *{word[:k] for k in (4, 5, 6) if len(word) >= k}]


def lexicon(rows: list[tuple[int, list[str]]], min_docs: int = 3, min_odds: float = 3.0) -> frozenset:
    """Words and openings typical of toxic documents, by smoothed log odds."""
    df = [Counter(), Counter()]
    n = [0, 0]
    for y, words in rows:
        n[y] += 1
        df[y].update({k for w in set(words) for k in _keys(w)})
    odds = lambda k: math.log((df[1][k] + 0.1) / (n[1] + 1)) - math.log((df[0][k] + 0.1) / (n[0] + 1))
    return frozenset(k for k, v in df[1].items() if v >= max(min_docs, n[1] // 100) and odds(k) >= min_odds)


def fit_rows(rows: list[tuple[int, str]]) -> ToxicityModel:
    """Fit on (label 0 or 1, text) pairs."""
    rows = [(int(y), words_of(t)) for y, t in rows]
    if len({y for y, _ in rows}) < 2:
        rate = (sum(y for y, _ in rows) + 0.5) / (len(rows) + 1)
        return ToxicityModel(None, (math.log(rate / (1 - rate)) if rows else -2.0, 0.0, 0.0))
    bad = lexicon(rows)
    tags = [np.array([int(y and any(k in bad for k in _keys(w))) for w in words], dtype=np.int64) for y, words in rows]
    pieces = [(words[i : i + 120], tag[i : i + 120]) for (_, words), tag in zip(rows, tags, strict=True) for i in range(0, len(words), 120)]
    field = fit([w for w, _ in pieces], [t for _, t in pieces], [0, 1], {"lexicon:toxic": frozenset(w for y, words in rows if y for w in words if any(k in bad for k in _keys(w)))}, min_count=3, rounds=60, rate=0.5)
    model = ToxicityModel(field, (0.0, 1.0, 0.0))
    x = np.array([(1.0, *model.inputs(p)) for p in field.marginals([w for _, w in rows])])
    y = np.array([y for y, _ in rows], float)
    a = np.array([0.0, 1.0, 0.0])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        a += np.linalg.solve(h, x.T @ (y - q) - 0.05 * a)
    return ToxicityModel(field, tuple(map(float, a)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_label: int = 800, window_chars: int = 200_000, seed: int = 7, max_chars: int = 100_000_000) -> ToxicityModel:
    """Fit on ``per_label`` to twice as many rows of each label, drawn by hash of ``key``.

    ``labels`` holds ``key`` and ``label``; rows with a null label or text are
    ignored, a label given twice counts once.  The draw is made on the labels
    before any text is read, so a bounded table of keys meets the texts; equal
    rows count once and at most twice as many texts as keys are fetched.  Texts
    of every length are drawn; of one of more than ``window_chars`` characters,
    a stretch of that size from a place drawn by hash, or a shorter one where
    the sample would hold more than ``max_chars`` characters.  A null ``key``
    has no label.
    """
    y = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_y IN (0, 1) AND _key IS NOT NULL").distinct()
    keys = bounded_sample(y, "_y", per_label, seed, ["_key", "_y"])
    if not keys:
        return fit_rows([])
    chosen = {r[0]: r[1] for r in keys}
    room = min(window_chars, max(200, max_chars // (2 * len(chosen))))
    found = docs.where(F.col(key).isin(sorted(chosen)) & (F.col(text) != "")).select(F.col(key).alias("_key"), some_window(F.col(text), room, seed).alias("_text"))
    found = found.withColumn("_place", F.xxhash64("_key", "_text")).dropDuplicates(["_place"]).orderBy("_place").limit(2 * len(chosen)).collect()
    return fit_rows([(chosen[r[0]], r[1]) for r in sorted(found, key=lambda r: (str(r[0]), r[1]))])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", span_at: float = 0.5) -> DataFrame:
    """Add ``score double``, ``predicted int`` and ``spans`` to every row.

    ``spans array<struct<begin,end,p>>`` are offsets (code points) of words
    whose marginal reaches ``span_at``.  Null and empty texts have no words and
    get the curve's low end.  Equal texts get equal scores; repeated rows are
    kept.  Columns of these names in ``docs`` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "spans")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<score:double,spans:array<struct<begin:long,end:long,p:double>>>"

    @F.pandas_udf(kind)
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for s in batches:
            texts = ["" if t is None else t for t in s]
            scores: list = [0.0] * len(texts)
            spans: list = [[]] * len(texts)
            for portion in in_portions(texts):
                cut = [words_of(texts[i]) for i in portion]
                found = m.field.marginals(cut) if m.field else [np.zeros((0, 2))] * len(cut)
                for i, p in zip(portion, found, strict=True):
                    scores[i] = m.score(p)
                    hot = np.flatnonzero(p[:, 1] >= span_at)
                    if len(hot):
                        where = spans_of(texts[i])
                        spans[i] = [{"begin": where[k][0], "end": where[k][1], "p": float(p[k, 1])} for k in hot]
            yield pd.DataFrame({"score": scores, "spans": spans})

    out = docs.select(*keep, mark(F.col(text)).alias("_m")).select(*keep, "_m.score", "_m.spans")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

