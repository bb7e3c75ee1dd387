"""Language identification with a conditional random field over words.

Every word of a text gets a probability for each learned language from affix,
character n-gram and lexicon features and from learned transitions, so texts
that switch languages are labelled word by word.  The document prediction is
the language with the largest mean probability.

Training sequences are spliced from runs of words of differently labelled
texts, which lets the transitions learn that languages persist but may switch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .crf import Crf, bounded_sample, fit, scorer, spans_of, words_of

UNDETERMINED = "und"


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 150, window_chars: int = 50_000, seed: int = 8, lexicon_size: int = 150, run_words: int = 25, max_chars: int = 100_000_000) -> Crf | None:
    """Fit on a bounded sample of labelled rows; None when no row is labelled.

    The sample holds ``per_lang`` to twice as many different texts of every
    language, or all there are, whatever their length and however often one of
    them is repeated; of a text of more than ``window_chars`` characters, a
    stretch of that size from a place drawn by hash, or a shorter one where
    many languages would need more than ``max_chars`` characters together.
    Rows with a null text or language, and empty texts, are left out.
    """
    rows = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_lang IS NOT NULL AND _text <> ''")
    got = bounded_sample(rows, "_lang", per_lang, seed, ["_lang", "_text"], "_text", window_chars, max_chars)
    return fit_rows([(r[0], r[1]) for r in got], seed, lexicon_size, run_words)


def fit_rows(rows: list[tuple[str, str]], seed: int = 8, lexicon_size: int = 150, run_words: int = 25) -> Crf | None:
    """Fit on (language, text) pairs."""
    rows = [(lang, words) for lang, t in rows if (words := words_of(t))]
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    number = {v: i for i, v in enumerate(labels)}
    common = {v: Counter() for v in labels}
    for lang, words in rows:
        common[lang].update(words)
    lexicons = {f"lexicon:{v}": frozenset(w for w, n in common[v].most_common(lexicon_size) if n > 1) for v in labels}
    rng = np.random.default_rng(seed)
    runs = []
    for lang, words in rows:
        at = 0
        while at < len(words):
            n = int(rng.integers(run_words // 2, 4 * run_words))
            runs.append((number[lang], words[at : at + n]))
            at += n
    texts, tags = [], []
    order = rng.permutation(len(runs))
    for at in range(0, len(runs), 4):
        some = [runs[i] for i in order[at : at + 4]]
        texts.append([w for _, x in some for w in x])
        tags.append(np.concatenate([np.full(len(x), y) for y, x in some]))
    return fit(texts, tags, labels, lexicons, min_count=3)


def _summary(labels: list[str]):
    def of(words: list[str], p: np.ndarray) -> tuple[str, float]:
        if not words:
            return UNDETERMINED, 0.0
        mean = p.mean(axis=0)
        best = int(mean.argmax())
        return labels[best], float(min(1.0, mean[best]))

    return of


def predict(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row.

    Null texts and texts without letters (``str.isalpha``) get ``und`` and score
    0, as does every text when the model is None (nothing was labelled).  Of
    languages with equal means the first in alphabetical order is taken.
    Columns of these names in ``docs`` are replaced; repeated rows are kept.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        of = scorer(m, _summary(m.labels))
        for s in batches:
            yield pd.DataFrame(of(list(s)), columns=["lang_pred", "score"])

    return docs.select(*keep, tag(F.col(text)).alias("_p")).select(*keep, "_p.lang_pred", "_p.score")


def tag_words(docs: DataFrame, model: Crf, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per word: ``(key, begin, end, word, lang, probability)``.

    Offsets are code points of the text, words are in lower case; labels are
    the most probable language of each word in its context.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("begin long, end long, word string, lang string, probability double")])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for df in batches:
            for k, t in zip(df[key], df["_t"], strict=True):
                found = [(a, b, w) for (a, b), w in zip(spans_of(t), words_of(t), strict=True)]
                if found:
                    p = next(m.marginals([[w for _, _, w in found]]))
                    best = p.argmax(axis=1)
                    out = pd.DataFrame(found, columns=["begin", "end", "word"])
                    out.insert(0, key, k)
                    yield out.assign(lang=[m.labels[i] for i in best], probability=p.max(axis=1))

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(work, schema)
