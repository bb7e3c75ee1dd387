"""SentencePiece (merge type) encoding by a prefix table, and decoding.

The greedy merge procedure is replaced by a dynamic program over prefixes.
For merge-type vocabularies the encoding of every prefix of a text is unique,
and a token sequence is an encoding exactly when each pair of neighbours is
*compatible*, that is, when merging the text of the pair alone gives back that
pair.  So the table stores, for each prefix, the one token its encoding ends
with: the candidates are the automaton matches that end there, and the right
one is the reachable candidate which is compatible with the last token of the
prefix before it.  The ids are then recovered from the end backwards.

No piece of the vocabulary crosses certain character borders (a space mark
after another character, for one); the table is cut there, which is exact and
lets repeated words be looked up instead of encoded again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"


class PrefixTableEncoder:
    """Encoder and decoder for one merge-type SentencePiece model file.

    ``cache_words`` bounds the table of words already encoded; it is emptied
    when full, so memory does not grow with the corpus.
    """

    def __init__(self, model_path: str, cache_words: int = 150_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.sp, self.cache_words = sp, cache_words
        self.end_id = sp.eos_id()
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.pieces.items()}
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {p for p in self.pieces if len(p) == 1}
        self._check_normaliser()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if self.merge(p) == [p]:  # pieces that merging can reach
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self.cut = re.compile(self._borders())
        self._words: dict[str, str] = {}
        self._ids: dict[str, tuple[int, ...]] = {}

    def _check_normaliser(self) -> None:
        probe = "é Åﬁ  x① "
        if self.sp.decode(self.sp.encode(probe)) != probe or self.sp.encode("a")[:1] != self.sp.encode(f"{MARK}a")[1:2] and self.sp.id_to_piece(self.sp.encode("a")[0])[0] != MARK:
            raise ValueError("only models with the identity normaliser and a leading space mark are supported")

    def _borders(self) -> str:
        """Pattern of the stretches between which no piece can reach across."""
        inner = [p for p in self.pieces if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in inner):
            return r"(?s).+"
        letter = re.compile(r"[^\W\d_]")
        kinds = [[bool(letter.match(c)) for c in p.lstrip(MARK)] for p in inner]
        if any(len(set(k)) > 1 for k in kinds):
            return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        return rf"{MARK}*[^\W\d_]+|{MARK}*(?:[^\w{MARK}]|[\d_])+|{MARK}+"

    def merge(self, s: str) -> list[str]:
        """Plain merging of a short text; used for reachability and pair tests."""
        parts, score = list(s), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart, and whole, when merged together."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self._pairs[key] = self.merge(x + y) == [x, y]
        return known

    def _run(self, s: str) -> list[int]:
        """Ids of a text whose characters all are pieces."""
        n = len(s)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self._pairs, self.compatible
        for end, (width, token) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - width
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                ok = pairs.get(before << 32 | token)
                if ok is None:
                    ok = compatible(before, token)
                if not ok:
                    continue
            last[end], start[end] = token, begin
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return out

    def _word(self, s: str) -> tuple[int, ...]:
        if self.chars.issuperset(s):
            return tuple(self._run(s))
        out: list[int] = []
        known = ""
        for c in s:  # a character without a piece never merges: it goes out as its bytes
            if c in self.chars:
                known += c
                continue
            if known:
                out += self._run(known)
                known = ""
            out += [self.bytes[b] for b in c.encode("utf-8")]
        if known:
            out += self._run(known)
        return tuple(out)

    def _split(self, text: str, lines: bool = False) -> list[str]:
        if not text:
            return []
        words = self.cut.findall(MARK + text.replace(" ", MARK))
        ids = self._ids
        if len(ids) > self.cache_words:
            ids.clear()
            self._words.clear()
        for w in words:
            if w not in ids:
                got = ids[w] = self._word(w)
                if lines:
                    self._words[w] = " ".join(map(str, got))
        return words

    def encode(self, text: str) -> list[int]:
        """All ids of ``text`` with the end id."""
        return [*chain.from_iterable(map(self._ids.__getitem__, self._split(text))), self.end_id]

    def encode_both(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same ids in decimal joined by one space."""
        words = self._split(text, lines=True)
        ids = [*chain.from_iterable(map(self._ids.__getitem__, words)), self.end_id]
        try:
            return ids, " ".join([*map(self._words.__getitem__, words), str(self.end_id)])
        except KeyError:  # a word that encode() met first
            return ids, " ".join(map(str, ids))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_LOADED: dict[tuple, PrefixTableEncoder] = {}


def encoder(model_path: str, cache_words: int = 150_000) -> PrefixTableEncoder:
    """The encoder of this process for a model file, loaded once."""
    key = (model_path, cache_words)
    if key not in _LOADED:
        _LOADED[key] = PrefixTableEncoder(*key)
    return _LOADED[key]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", cache_words: int = 200_000) -> DataFrame:
    """Add ``ids array<int>`` and ``decoded string`` to every row.

    Null texts count as empty (ids hold the end id only).  Columns of ``docs``
    named ``ids`` or ``decoded`` are replaced; all others, and repeated rows,
    are kept as they are.
    """

    @F.pandas_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(model_path, cache_words)
        for s in batches:
            for at in range(0, len(s), 250):  # small portions: ids take more memory than texts
                ids, decoded = [], []
                for x in s.iloc[at : at + 250]:
                    got = e.encode(x)
                    decoded.append(e.decode(got))
                    ids.append(np.array(got, np.int32))
                yield pd.DataFrame({"ids": ids, "decoded": decoded})

    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    out = docs.select(*keep, both(F.coalesce(F.col(text), F.lit(""))).alias("_both"))
    return out.select(*keep, "_both.ids", "_both.decoded")


def encoding_digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", cache_words: int = 400_000) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every row, in one pass.

    The digest form of :func:`encode_decode`: ids and decoded texts are hashed
    inside the task instead of being passed on.  Null texts count as empty.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model_path, cache_words)
        for df in batches:
            rows = []
            for x in df["_t"]:
                ids, line = e.encode_both(x)
                rows.append((len(ids), sha(line), sha(e.decode(ids))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=df.index)
            out.insert(0, key, df[key])
            yield out

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(work, schema)


def n_tokens(text: Column, model_path: str) -> Column:
    """Number of ids of a text, end id included."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(model_path)
        for s in batches:
            yield pd.Series([len(e.encode(x or "")) for x in s], dtype="int64")

    return count(text)
