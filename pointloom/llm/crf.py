"""Linear-chain conditional random fields over the words of texts.

A word contributes the sum of the weights of its features (the word, its
affixes, inner character n-grams, lexicon memberships); neighbouring labels
contribute learned transition weights.  Inference is exact forward-backward,
run for many texts at once; a text costs time in proportion to its length and
nothing is cut off.  Training maximises the regularised likelihood of labelled
words by adaptive gradient steps on a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

WORD = re.compile(r"[^\W\d_]+")


def spans_of(text: str) -> list[tuple[int, int]]:
    """Begin and end of the runs of letters (``str.isalpha``) of a text."""
    out = []
    for m in WORD.finditer(text):
        if m.group().isalpha():
            out.append(m.span())
            continue
        begin = None  # word characters that are no letters: superscripts, fractions, numerals
        for i in range(m.start(), m.end() + 1):
            if i < m.end() and text[i].isalpha():
                begin = i if begin is None else begin
            elif begin is not None:
                out.append((begin, i))
                begin = None
    return out


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, each in lower case, in the order of :func:`spans_of`."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # a letter became several characters: words are found before
        return [text[a:b].lower() for a, b in spans_of(text)]
    found = WORD.findall(low)
    return found if all(map(str.isalpha, found)) else [low[a:b] for a, b in spans_of(low)]


_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Places of distinct 64-bit keys: an open-addressing table, filled and read in whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(4, int(4 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        todo, self.steps = np.arange(len(keys)), 0
        while len(todo):  # each free slot takes the first key that wants it, the others step on
            want = self._slot(keys[todo], self.steps)
            free = np.flatnonzero(self.slots[want] < 0)
            _, first = np.unique(want[free], return_index=True)
            self.slots[want[free[first]]] = todo[free[first]]
            todo = np.delete(todo, free[first])
            self.steps += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys + np.uint64(step)) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for step in range(self.steps):
            at = self.slots[self._slot(keys[todo], step)]
            same = at >= 0
            same[same] = self.keys[at[same]] == keys[todo[same]]
            out[todo[same]] = at[same]
            todo = todo[(at >= 0) & ~same]
            if not len(todo):
                break
        return out


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _kind(number: int) -> np.uint64:
    return np.uint64(number * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit key of each whole word."""
    out = np.zeros(len(words), np.uint64)
    for rows, codes, sizes in _by_width(words):
        h = np.zeros(len(rows), np.uint64)
        for i in range(codes.shape[1]):
            h = np.where(i < sizes, _spread((h + codes[:, i]) * _MIX), h)
        out[rows] = h + _kind(1)
    return out


def _by_width(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, code points and sizes of words, padded within classes of width."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for width in (8, 16, 32, 128, 1024, 1 << 40):
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        if len(rows):
            w = int(sizes[rows].max())
            some = np.array([words[i] for i in rows], dtype=f"<U{w}")
            yield rows, some.view(np.uint32).reshape(len(rows), w).astype(np.uint64), sizes[rows]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature key) of every feature, apart from lexicons.

    Features are the word, its openings of 2 to 6 and endings of 1 to 4
    letters, and all letter trigrams with the word borders.
    """
    owner, keys = [], []

    def put(rows: np.ndarray, h: np.ndarray, kind: int) -> None:
        owner.append(rows)
        keys.append(_spread(h + _kind(kind)))

    whole = word_keys(words)
    put(np.arange(len(words)), whole, 2)
    for rows, codes, sizes in _by_width(words):
        n, width = codes.shape
        h = np.zeros(n, np.uint64)
        for i in range(min(6, width)):
            h = (h + codes[:, i]) * _MIX
            ok = sizes > i
            if i:
                put(rows[ok], h[ok], 10 + i)
        h = np.zeros(n, np.uint64)
        each = np.arange(n)
        for i in range(min(4, width)):
            h = (h + codes[each, np.maximum(sizes - 1 - i, 0)]) * _MIX
            ok = sizes > i
            put(rows[ok], h[ok], 20 + i)
        edged = np.zeros((n, width + 2), np.uint64)
        edged[:, 0] = 1
        edged[:, 1:-1] = codes
        edged[each, sizes + 1] = 2
        tri = ((edged[:, :-2] * _MIX + edged[:, 1:-1]) * _MIX + edged[:, 2:]) * _MIX
        r, c = np.nonzero(np.arange(width)[None, :] < sizes[:, None])
        put(rows[r], tri[r, c], 3)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owner), np.concatenate(keys)


@dataclass
class Crf:
    """A fitted field: ``labels``, feature keys and weights, transitions.

    ``lexicons`` maps a feature name to a set of words; ``cache_words`` bounds
    the table of word scores a task keeps, which is emptied when full.
    """

    labels: list
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicons: dict[str, frozenset] = field(default_factory=dict)
    cache_words: int = 100_000

    def __post_init__(self) -> None:
        self._ids: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.labels)), np.float32)
        self._table = KeyTable(self.keys)
        self._lexicons = [np.sort(word_keys(sorted(v))) for _, v in sorted(self.lexicons.items())]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def active(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, feature number) of the known features of words."""
        owner, key = features(words)
        at = self._table.find(key)
        owner, at = [owner[at >= 0]], [at[at >= 0]]
        if self._lexicons:
            whole = word_keys(words)
            for i, have in enumerate(self._lexicons):
                if len(have):
                    hit = np.flatnonzero(have[np.minimum(np.searchsorted(have, whole), len(have) - 1)] == whole)
                    owner.append(hit)
                    at.append(np.full(len(hit), len(self.keys) + i))
        return np.concatenate(owner), np.concatenate(at)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label at each word, shape (len(words), labels)."""
        if len(self._ids) > self.cache_words:
            self._ids.clear()
            self._scores = self._scores[:0]
        ids = self._ids
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            owner, at = self.active(new)
            scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(new)), 1))
            rows = np.stack([np.bincount(owner, self.weights[at, c], len(new)) * scale for c in range(len(self.labels))], axis=1)
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            self._scores = np.concatenate([self._scores, (rows + self.bias).astype(np.float32)])
        return self._scores[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]], at_once: int = 800_000) -> Iterator[np.ndarray]:
        """For each text, the label probabilities of its words, in order.

        Texts are taken by length in groups of about ``at_once`` words, so a
        group holds few idle steps; a longer text forms a group of its own.
        """
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        done: list = [None] * len(texts)
        at = 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or size + len(texts[order[to]]) <= at_once):
                size += len(texts[order[to]])
                to += 1
            for i, p in zip(order[at:to], self._group([texts[i] for i in order[at:to]]), strict=True):
                done[i] = p
            at = to
        yield from done

    def _group(self, group: list[list[str]]) -> list[np.ndarray]:
        flat = [w for t in group for w in t]
        k = len(self.labels)
        lengths = np.array([len(t) for t in group])
        if not flat:
            return [np.zeros((0, k)) for _ in group]
        got, _ = forward_backward(self.emissions(flat), lengths, self.transitions, self.start)
        return np.split(got, np.cumsum(lengths)[:-1])


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of many chains laid end to end; with ``pairs`` also summed pair marginals.

    All chains advance together, longest first, so each step is one small
    matrix product over the chains that still have words.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    left = np.sort(-lengths)
    p = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    t = np.exp(transitions - transitions.max()).astype(np.float32)
    alpha = np.empty_like(p)
    now, first = None, np.exp(start - start.max()).astype(np.float32)
    for i in range(int(lengths.max())):
        n = int(np.searchsorted(left, -i, side="left"))  # chains with more than i words
        rows = begin[:n] + i
        now = p[rows] * (first if now is None else now[:n] @ t)
        now /= now.sum(axis=1, keepdims=True)
        alpha[rows] = now
    out = np.empty_like(p)
    sums = np.zeros_like(t) if pairs else None
    after = np.zeros((0, p.shape[1]), np.float32)
    for i in range(int(lengths.max()) - 1, -1, -1):
        n = int(np.searchsorted(left, -i, side="left"))
        rows = begin[:n] + i
        beta = np.ones((n, p.shape[1]), np.float32)
        m = len(after)
        if m:
            beta[:m] = after @ t.T
            if pairs:
                both = alpha[rows[:m]][:, :, None] * t[None] * after[:, None, :]
                sums += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        g = alpha[rows] * beta
        out[rows] = g / g.sum(axis=1, keepdims=True)
        after = p[rows] * beta
        after /= after.sum(axis=1, keepdims=True)
    return out, sums


def fit(
    texts: list[list[str]],
    tags: list[np.ndarray],
    labels: list,
    lexicons: dict[str, frozenset] | None = None,
    min_count: int = 2,
    rounds: int = 30,
    rate: float = 0.3,
    l2: float = 1e-5,
    weight: np.ndarray | None = None,
) -> Crf:
    """Fit a field to labelled words.

    ``tags`` holds the label number of every word of every text.  Features seen
    in fewer than ``min_count`` different words are left out.  ``weight``
    scales the loss of each label (for rare ones).
    """
    lexicons = lexicons or {}
    kinds = sorted({w for t in texts for w in t})
    owner, key = features(kinds)
    values, back, count = np.unique(key, return_inverse=True, return_counts=True)
    counts = Counter(w for t in texts for w in t)
    often = np.array([counts[w] for w in kinds])
    spoken = np.zeros(len(values), np.int64)
    np.maximum.at(spoken, back, often[owner])
    keys = values[(count >= min_count) | (spoken >= 2 * min_count)]
    k = len(labels)
    size = len(keys) + len(lexicons)
    model = Crf(labels, keys, np.zeros((size, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k), lexicons)
    number = {w: i for i, w in enumerate(kinds)}
    owner, flat = model.active(kinds) if kinds else (owner, owner)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(kinds)), 1))
    lengths = np.array([len(t) for t in texts])
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    if not len(ids):
        return model
    truth = np.eye(k)[np.concatenate(tags)]
    first = np.cumsum(lengths) - lengths
    cost = truth @ (weight if weight is not None else np.ones(k))
    inner = np.ones(len(ids), bool)
    inner[first[lengths > 0]] = False
    y = np.concatenate(tags)
    steps = np.zeros((k, k))
    np.add.at(steps, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    memory = {n: np.full_like(getattr(model, n), 1e-8) for n in ("weights", "bias", "transitions", "start")}
    total = len(ids)
    for _ in range(rounds):
        word_scores = np.zeros((len(kinds), k))
        for c in range(k):
            word_scores[:, c] = np.bincount(owner, model.weights[flat, c], len(kinds)) * scale
        got, moved = forward_backward(word_scores[ids] + model.bias, lengths, model.transitions, model.start, pairs=True)
        off = (truth - got) * cost[:, None]
        by_word = np.stack([np.bincount(ids, off[:, c], len(kinds)) for c in range(k)], axis=1) * scale[:, None]
        grads = {
            "weights": np.stack([np.bincount(flat, by_word[owner, c], size) for c in range(k)], axis=1) / total - l2 * model.weights,
            "bias": off.sum(axis=0) / total,
            "transitions": (steps - moved) / total,
            "start": off[first[lengths > 0]].sum(axis=0) / total,
        }
        for n, g in grads.items():
            memory[n] += g * g
            getattr(model, n)[...] += rate * g / np.sqrt(memory[n])
    return model


def bounded_sample(df, strata: str, per_stratum: int, seed: int, columns: list[str], text: str | None = None, window_chars: int = 50_000, max_chars: int = 100_000_000) -> list:
    """Between ``per_stratum`` and twice as many different rows of each value of column ``strata``, or all there are, by hash.

    One pass estimates the number of different rows of each value (all
    ``columns`` are hashed, so equal rows count as one, however often they
    come), one filtered pass draws them.  No value is left out: what the driver
    gets grows with the number of values, by rows of bounded size.  ``text``
    names a column of long texts; of a longer one a stretch is taken from a
    place drawn by hash, of ``window_chars`` characters or as many (200 at
    least) as keep the whole sample within ``max_chars``.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .store import materialise, release, small

    row = df.select(*columns, F.xxhash64(*[F.col(c).cast("string") for c in columns], F.lit(seed)).alias("_place"))
    scale = 1_000_000_000
    rate = F.lit(1.2 * per_stratum * scale) / F.col("_n")
    # few different rows are all taken: an estimate is off by a few percent
    part = F.when(F.col("_n") <= 1.2 * per_stratum, scale).otherwise(F.least(F.lit(scale), F.ceil(rate))).cast("long")
    counts = small(row.groupBy(F.col(strata).alias("_s")).agg(F.approx_count_distinct("_place", 0.02).alias("_n")).select("_s", part.alias("_part")), "strata")
    n = counts.count()
    if not n:
        return []
    if text is not None:
        room = max(200, min(window_chars, max_chars // (2 * per_stratum * n)))
        row = row.withColumn(text, some_window(F.col(text), room, seed))
    drawn = row.join(counts, F.col(strata) == F.col("_s")).where(F.pmod("_place", F.lit(scale)) < F.col("_part"))
    kept = materialise(drawn.select(*columns, "_place").dropDuplicates(["_place"]), "drawn")
    turn = F.row_number().over(Window.partitionBy(strata).orderBy("_place"))
    got = kept.withColumn("_turn", turn).where(F.col("_turn") <= 2 * per_stratum).select(*columns).collect()
    release(kept)
    release(counts)
    return sorted(got, key=lambda r: tuple(map(str, r)))


def some_window(text, chars: int, seed: int):
    """A text, or of a longer one the ``chars`` characters from a place drawn by hash."""
    from pyspark.sql import functions as F

    free = F.greatest(F.length(text) - F.lit(chars), F.lit(0)) + 1
    return F.substring(text, F.pmod(F.xxhash64(text, F.lit(seed)), free).cast("int") + 1, F.lit(chars))


def in_portions(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[int]]:
    """Row numbers of texts, longest first, in portions of bounded size.

    Texts of like length end up together, so the steps of forward-backward are
    shared by many; a longer text is a portion of its own.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    portion: list[int] = []
    size = 0
    for i in order:
        n = len(texts[i] or "")
        if portion and size + n > chars:
            yield portion
            portion, size = [], 0
        portion.append(i)
        size += n
    if portion:
        yield portion


def scorer(model: Crf, summarise: Callable) -> Callable:
    """A function from texts to one summary per text, for use inside tasks."""

    def score(texts: list[str | None]) -> list:
        out: list = [None] * len(texts)
        for portion in in_portions(texts):
            cut = [words_of(texts[i]) for i in portion]
            for i, w, m in zip(portion, cut, model.marginals(cut), strict=True):
                out[i] = summarise(w, m)
        return out

    return score
