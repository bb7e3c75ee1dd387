"""Suffix-array dedup of byte strings by a depth-limited radix sort.

A suffix starts at a byte and is looked at through its first ``depth`` bytes
only, so what is sorted are windows, and equal groups of the sorted windows are
exactly the repeated ones.  Digits are taken most significant first, and a
suffix whose group lies in one document drops out before its next digit is made:

1. the first digit is the least fingerprint of the 16-byte grams in the window;
   neighbouring suffixes mostly have the same one, so it costs a twentieth of a
   record per byte;
2. the last digit is a fingerprint of the whole window, within the group of the
   first.

Long repeats are settled before: a text is cut where a gram's fingerprint meets
a mask, and a *stretch* is the bytes of all windows that start between two cuts.
What of a whole text, or a stretch, occurs in a document with a smaller key is
covered, and none of its windows takes part any more: the document with the
smallest key has the same windows and answers for them.

Texts are packed to rows of some megabytes, in a table bucketed by pack.  A pass makes the sorted digits of every pack, cut in buckets by a
second fingerprint; one task per bucket merges them (a radix sort by bucket and
digit) and answers with one bit per digit: *there is a smaller key elsewhere*,
or *it is elsewhere at all*.  Every pack is joined with its own bits and stays
where it is.  Digits have 64 bits and are compared within a bucket only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import evenly, materialise, shared_dir

_U = np.uint64
GRAM = 16
#: A cut where a fingerprint's low bits are zero: every 64 bytes in the mean.
CUT = _U(63)
#: Bytes whose digits are made at a time; packs of up to KEEP bytes keep their fingerprints between digits.
SLICE, KEEP = 1 << 19, 16 << 20
STRETCH, LEAST, WHOLE = 0, 1, 2
_ODD = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 64, (2, 64), dtype=np.uint64) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (multiplications and shifts; in place of ``x``)."""
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the 16 bytes from each byte on."""
    words = _mix(np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy())
    return _mix(words[:-8] * _U(3) + words[8:])


def _windows(grams: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of the ``depth`` bytes from each of some places on: sums of grams, each with its own odd factor."""
    a, b = np.zeros(len(at), _U), np.zeros(len(at), _U)
    for k, off in enumerate([*range(0, depth - GRAM, GRAM), depth - GRAM]):
        g = grams[at + off]
        a += g * _ODD[0, k % 64]
        b += g * _ODD[1, k % 64]
    return _mix(a), _mix(b)


def _least(grams: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Least fingerprint of the grams within the window from each of the first ``n`` bytes on."""
    width, k, m = depth - GRAM + 1, 1, grams
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:n], m[width - k : width - k + n])


def _digests(grams: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of stretches of ``size`` windows: every sixteenth gram by its number, the last window and the size."""
    steps = -(-size // GRAM)
    ends = np.cumsum(steps)
    no = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - steps, steps)
    by_place = _mix(grams[np.repeat(at, steps) + GRAM * no] + (no.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F))
    total = np.add.reduceat(by_place, ends - steps) if len(ends) else by_place
    a, b = _windows(grams, at + size - 1, depth)
    n = size.astype(_U)
    return _mix(total * _U(7) + a + n), _mix((total ^ b) * _U(11) + n)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: planes of zeros take no room in a compressed exchange."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class Digits:
    """Digits of one pass over a pack: values, their buckets and the texts that have them."""

    def __init__(self) -> None:
        self.value: list[np.ndarray] = []
        self.bucket: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []

    def add(self, value: np.ndarray, second: np.ndarray, owner: np.ndarray) -> None:
        self.value.append(value)
        self.bucket.append((second >> _U(33)).astype(np.uint32))
        self.owner.append(owner)

    def sorted(self, rank: np.ndarray, buckets: int) -> Sorted:
        """Distinct (bucket, digit) in order, with the least and the largest key rank of each."""
        value = np.concatenate([np.zeros(0, _U), *self.value])
        if not len(value):
            return Sorted(value, *[np.zeros(0, np.int64)] * 4)
        owner = rank[np.concatenate(self.owner)]
        bucket = np.concatenate(self.bucket).astype(np.int64) % buckets
        order = np.lexsort((value, bucket))
        value, bucket, owner = value[order], bucket[order], owner[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])])
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return Sorted(value[first], bucket[first], np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first), place)


class Sorted:
    """Distinct digits of a pack; ``place`` leads from every added digit to its distinct one."""

    def __init__(self, value: np.ndarray, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray):
        self.value, self.bucket, self.low, self.high, self.place = value, bucket, low, high, place

    def requests(self, kind: int, keys: np.ndarray | None) -> Iterator[dict]:
        """One row per bucket: the digits by their differences, and the least key of each where keys are given."""
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)], strict=False):
            row = {"kind": kind, "bucket": int(self.bucket[a]), "digits": _planes(np.diff(self.value[a:b], prepend=_U(0))), "keys": b"", "which": b""}
            if keys is not None:
                used, which = np.unique(self.low[a:b], return_inverse=True)
                row["keys"] = keys[used].tobytes()
                row["which"] = _planes(which.astype("<u4"))
            yield row

    def answered(self, kind: int, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """The bit of every distinct digit."""
        out = np.zeros(len(self.bucket), bool)
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)], strict=False):
            bits = answers.get((kind, int(self.bucket[a])))
            if bits is not None:
                out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return out


def merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Answer all requests of one kind and bucket, one bit per digit.

    With keys: is there a smaller key at another place?  Without: is the digit
    in another pack?  A row without such a digit gets no answer.
    """
    digits = [np.cumsum(_from_planes(d, "<u8"), dtype=_U) for d in frame["digits"]]
    size = np.array([len(d) for d in digits])
    value = np.concatenate(digits)
    del digits
    order = np.argsort(value, kind="stable")
    value = value[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    del value
    first = np.flatnonzero(new)
    if frame["keys"].iloc[0]:
        key = np.concatenate([np.frombuffer(k, np.int64)[_from_planes(w, "<u4")] for k, w in zip(frame["keys"], frame["which"], strict=True)])[order]
        hit = key > np.minimum.reduceat(key, first)[np.cumsum(new, dtype=np.int32) - 1]
        del key
    else:
        count = np.diff(first, append=len(order))
        hit = np.repeat(count > 1, count)
    back = np.empty(len(order), bool)
    back[order] = hit
    bits = np.split(back, np.cumsum(size)[:-1])
    some = [i for i, b in enumerate(bits) if b.any()]
    out = frame.iloc[some][["pack", "kind", "bucket"]].copy()
    out["bits"] = [np.packbits(bits[i]).tobytes() for i in some]
    return out


class Pack:
    """The texts of a pack, end to end, and what is known of their windows.

    Windows are named by the byte they start at; ``window`` marks those that do
    not reach beyond their text.
    """

    def __init__(self, keys: np.ndarray, ends: np.ndarray, data: bytes, depth: int, buckets: int, few: int | None = None):
        self.raw, self.depth, self.buckets, self.few = data, depth, buckets, few or buckets
        self.data = np.frombuffer(data + bytes(depth + GRAM), np.uint8)
        self.begins, self.ends = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)
        self.keys, self.rank = np.unique(keys, return_inverse=True)
        self.have = np.flatnonzero(self.ends - self.begins >= depth)
        mark = np.zeros(len(data) + 1, np.int8)
        mark[self.begins[self.have]] += 1
        mark[self.ends[self.have] - depth + 1] -= 1
        self.window = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        self.kept: dict[int, np.ndarray] = {}

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that a byte lies in."""
        return np.searchsorted(self.begins, at, side="right") - 1

    def slices(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Begin, end and gram fingerprints of stretches of bytes of bounded size."""
        for a in range(0, len(self.raw), SLICE):
            b = min(a + SLICE, len(self.raw))
            grams = self.kept.get(a)
            if grams is None:
                grams = _grams(self.data[a : b + self.depth])
                if len(self.raw) <= KEEP:
                    self.kept[a] = grams
            yield a, b, grams

    def runs(self, a: int, b: int, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a slice and sizes of runs of windows; ``new`` marks where one starts, besides slices and texts."""
        new[0] = True
        begins = self.begins[self.have]
        new[begins[(begins >= a) & (begins < b)] - a] = True
        inside = self.window[a:b]
        at = np.flatnonzero(new & inside)
        before = np.concatenate([[0], np.cumsum(inside)])
        return at, np.diff(before[at], append=before[-1])

    def outer(self) -> tuple[Sorted, list[tuple[np.ndarray, np.ndarray]]]:
        """Digits of whole texts, then of stretches; the places and sizes of the stretches."""
        digits, found = Digits(), []
        whole = [hashlib.blake2b(self.raw[a:b], digest_size=16).digest() for a, b in zip(self.begins[self.have], self.ends[self.have], strict=True)]
        two = np.frombuffer(b"".join(whole), "<u8").reshape(-1, 2)
        digits.add(two[:, 0].copy(), two[:, 1].copy(), self.have)
        for a, b, grams in self.slices():
            at, size = self.runs(a, b, (grams[: b - a] & CUT) == 0)
            digits.add(*_digests(grams, at, size, self.depth), self.owner(at + a))
            found.append((at + a, size))
        return digits.sorted(self.rank, self.few), found

    def least(self) -> tuple[Sorted, list[tuple[np.ndarray, np.ndarray]]]:
        """First digits of all suffixes; neighbours with the same one are a run: the places and sizes of the runs."""
        digits, found = Digits(), []
        for a, b, grams in self.slices():
            v = _least(grams, b - a, self.depth)
            at, size = self.runs(a, b, np.concatenate([[True], v[1:] != v[:-1]]))
            digits.add(v[at], v[at] << _U(33), self.owner(at + a))
            found.append((at + a, size))
        return digits.sorted(self.rank, self.few), found

    def spread(self, bits: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The windows of the runs that are marked."""
        at, size = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
        edge = np.zeros(len(self.raw) + 1, np.int8)
        edge[at[bits]] += 1  # runs do not overlap: at each byte one may start and one end
        edge[(at + size)[bits]] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def covered(self, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The windows known to be in a smaller document, and those still open."""
        outer, stretches = self.outer()
        known = outer.answered(STRETCH, answers)[outer.place]
        n = len(self.have)
        at = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in stretches]])
        owner = np.concatenate([self.have, self.owner(at)])
        known |= outer.low[outer.place] < self.rank[owner]
        gone = self.spread(known[n:], stretches)
        for i in self.have[known[:n]]:
            gone[self.begins[i] : self.ends[i] - self.depth + 1] = True
        least, runs = self.least()
        several = least.answered(LEAST, answers) | (least.low < least.high)
        return gone, self.spread(several[least.place], runs) & ~gone

    def inner(self, open_: np.ndarray) -> Sorted:
        """Last digits of the open windows."""
        digits = Digits()
        for a, b, grams in self.slices():
            at = np.flatnonzero(open_[a:b])
            if len(at):
                digits.add(*_windows(grams, at, self.depth), self.owner(at + a))
        return digits.sorted(self.rank, self.buckets)

    def removed(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """The windows that also start in a document with a smaller key."""
        gone, open_ = self.covered(answers)
        inner, at = self.inner(open_), np.flatnonzero(open_)
        gone[at] = inner.answered(WHOLE, answers)[inner.place] | (inner.low[inner.place] < self.rank[self.owner(at)])
        return gone

    def spans(self, windows: np.ndarray) -> list[list[tuple[int, int]]]:
        """By text: maximal runs of bytes (start, end) that the marked windows cover."""
        at = np.flatnonzero(windows)
        out: list[list[tuple[int, int]]] = [[] for _ in self.begins]
        if not len(at):
            return out
        owner = self.owner(at)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > self.depth) | (np.diff(owner) > 0)]))
        last = np.append(first[1:], len(at)) - 1
        for i, a, b in zip(owner[first].tolist(), at[first].tolist(), at[last].tolist(), strict=True):
            out[i].append((a - int(self.begins[i]), b + self.depth - int(self.begins[i])))
        return out


def packs(docs: DataFrame, text: str, key: str, pack_bytes: int) -> DataFrame:
    """``(pack, keys, ends, data)``: texts end to end, some megabytes a row, bucketed by the number ``pack``.

    Rows without a key are left out.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull())
    rows = rows.select(F.spark_partition_id().alias("part"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        no, keys, texts, size = 0, [], [], 0

        def row() -> pd.DataFrame:
            ends = np.cumsum([len(t) for t in texts])
            return pd.DataFrame({"pack": [(part << 31) + no], "keys": [np.array(keys, "<i8").tobytes()], "ends": [ends.astype("<i8").tobytes()], "data": [b"".join(texts)]})

        part = 0
        for df in batches:
            part = int(df["part"].iloc[0]) if len(df) else part
            for k, t in zip(df["key"].tolist(), df["t"], strict=True):
                if texts and size + len(t) > pack_bytes:
                    yield row()
                    no, keys, texts, size = no + 1, [], [], 0
                keys.append(k)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    name = f"packs_{uuid.uuid4().hex}"
    table = rows.mapInPandas(packed, "pack long, keys binary, ends binary, data binary")
    table.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "pack").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


_REQUEST = "pack long, kind int, bucket int, digits binary, keys binary, which binary"


def _asked(packed: DataFrame, name: str, make) -> DataFrame:
    """Requests of every pack (``make`` gives the rows of one), merged and answered: (pack, answers)."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples(index=False):
                out = pd.DataFrame(list(make(r)), columns=["kind", "bucket", "digits", "keys", "which"])
                out.insert(0, "pack", r.pack)
                if len(out):
                    yield out

    answers = packed.mapInPandas(ask, _REQUEST).groupBy("kind", "bucket").applyInPandas(merge, "pack long, kind int, bucket int, bits binary")
    return materialise(answers.groupBy("pack").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("answers")), name)


def _pack(r, depth: int, buckets: tuple[int, int]) -> Pack:
    return Pack(np.frombuffer(r.keys, "<i8"), np.frombuffer(r.ends, "<i8"), r.data, depth, *buckets)


def _answers(r) -> dict[tuple[int, int], bytes]:
    return {(a["kind"], a["bucket"]): a["bits"] for a in (r.answers if r.answers is not None else [])}


def dedup_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = 50, pack_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``(key, n_bytes, n_removed, spans, kept)`` of every row.

    A byte goes when a string of ``depth`` bytes (at least 16) covers it that
    also starts in a document with a smaller key; strings are judged on the
    input.  ``spans`` are the maximal removed runs (start, end), ``kept`` the
    remaining bytes.  A null text counts as empty; texts shorter than ``depth``
    keep everything.  Rows with equal keys, such as repeated rows, take nothing
    from each other; a null key is neither smaller nor larger than another, so
    its row stays whole and removes nothing.  Other columns are left out.
    A row holds its text in one piece; digits are made a slice at a time.
    ``bucket_bytes`` is how much text a merging task answers for at once.
    """
    if depth < GRAM:
        raise ValueError(f"depth is at least {GRAM}")
    spark = docs.sparkSession
    packed = packs(docs, text, key, pack_bytes)
    volume = packed.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # a text has a last digit per byte at most, but only some twentieth of that of the first ones
    buckets = tuple(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // n)) for n in (bucket_bytes, 8 * bucket_bytes))

    def first(r) -> Iterator[dict]:
        p = _pack(r, depth, buckets)
        yield from p.outer()[0].requests(STRETCH, p.keys)
        yield from p.least()[0].requests(LEAST, None)

    def second(r) -> Iterator[dict]:
        p = _pack(r, depth, buckets)
        yield from p.inner(p.covered(_answers(r))[1]).requests(WHOLE, p.keys)

    one = _asked(packed, "answers-outer", first)
    two = _asked(packed.join(one, "pack", "left"), "answers-inner", second)
    both = one.unionByName(two).groupBy("pack").agg(F.flatten(F.collect_list("answers")).alias("answers"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples(index=False):
                p = _pack(r, depth, buckets)
                rows = []
                for i, (a, b, spans) in enumerate(zip(p.begins.tolist(), p.ends.tolist(), p.spans(p.removed(_answers(r))), strict=True)):
                    kept = r.data[a:b]
                    if spans:
                        kept = b"".join(r.data[a + x : a + y] for x, y in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], b - a], strict=True))
                    rows.append((int(p.keys[p.rank[i]]), b - a, sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], kept))
                yield pd.DataFrame(rows, columns=["_k", "n_bytes", "n_removed", "spans", "kept"])

    schema = "_k long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    out = packed.join(evenly(both), "pack", "left").mapInPandas(cut, schema)
    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    keyless = docs.where(F.col(key).isNull()).select(F.col(key).cast("long").alias("_k"), F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), whole.alias("kept"))
    return out.unionByName(keyless).withColumnRenamed("_k", key)
