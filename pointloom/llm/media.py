"""Media columns in content-defined chunks.

A payload is stored as 8-bit mono audio (a 44-byte header and the samples), cut
where a rolling gear hash of the last 32 bytes meets a mask.  Chunks that only
one payload holds stay inline in its media row; chunks that several payloads
hold are stored once in a chunk table.  Which are shared is found by joining
digests only, so payload bytes cross the network once, compressed, when equal payloads are
brought together.  Reading back joins the shared chunks to the ordered lists,
checks every digest and rebuilds the media byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import evenly

UNIT = 64
HEADER = 44
SMALLEST, MEAN_BITS, LARGEST = 256, 10, 8192
WINDOW = 4 << 20
_B, _L, _S = T.BinaryType(), T.LongType(), T.StringType()
GEAR = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: str | bytes) -> bytes:
    """UTF-8 bytes of a text, filled with zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8") if isinstance(text, str) else text
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wrap(samples: bytes, rate: int = 8000) -> bytes:
    """Stored form: a RIFF/WAVE file of 8-bit mono samples."""
    size = len(samples) & 0xFFFFFFFF
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + size) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size)
    return head + samples


def unwrap(media: bytes) -> bytes:
    """The samples of a stored form."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not an 8-bit audio file written by wrap()")
    return media[HEADER:]


def _hits(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash of the last 32 bytes meets the mask."""
    found = []
    mask = np.uint32(((1 << MEAN_BITS) - 1) << (32 - MEAN_BITS))
    for at in range(0, len(data), WINDOW):
        low = max(0, at - 31)
        h = GEAR[data[low : at + WINDOW]]
        for k in (1, 2, 4, 8, 16):  # doubling: sums over 2, 4, ... 32 bytes
            nxt = h.copy()
            nxt[k:] += h[:-k] << np.uint32(k)
            h = nxt
        hit = np.flatnonzero((h & mask) == 0) + low + 1
        found.append(hit[hit > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(media: list[bytes]) -> list[list[int]]:
    """End positions of the chunks of each stored form, the header being the first.

    The forms are hashed end to end.  That is exact: the hash looks back 32
    bytes and no cut is taken within the first 256 bytes of a chunk.
    """
    out: list[list[int]] = []
    at = 0
    while at < len(media):
        to, size = at, 0
        while to < len(media) and (to == at or size + len(media[to]) <= WINDOW):
            size += len(media[to])
            to += 1
        hits = _hits(np.frombuffer(b"".join(media[at:to]), np.uint8)).tolist()
        base = 0
        for m in media[at:to]:
            n, ends, last = len(m), [HEADER], HEADER
            while n - last > SMALLEST:
                i = bisect_left(hits, base + last + SMALLEST)
                cut = min(hits[i] - base if i < len(hits) else n, last + LARGEST, n)
                ends.append(cut)
                last = cut
            if last < n:
                ends.append(n)
            out.append(ends)
            base += n
        at = to
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Stored form and chunks of each UTF-8 text, a bounded number of bytes at a time."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < WINDOW):
            some.append(wrap(payload(texts[at])))
            size += len(some[-1])
            at += 1
        for m, ends in zip(some, cuts(some), strict=True):
            yield m, [m[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _portions(packed: pd.Series, rows: int = 500) -> Iterator[tuple[slice, list[bytes]]]:
    """Unpacked texts of a batch, some rows at a time."""
    for at in range(0, len(packed), rows):
        part = slice(at, at + rows)
        yield part, [zlib.decompress(z) for z in packed.iloc[part]]


@F.pandas_udf(_B)
def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts as compressed UTF-8 for the way through the exchange."""
    for s in batches:
        yield pd.Series([zlib.compress(t.encode("utf-8")) for t in s], dtype=object)


@F.pandas_udf(T.ArrayType(_B))
def chunk_digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct chunk digests of packed texts."""
    for s in batches:
        for _, texts in _portions(s):
            yield pd.Series([[*dict.fromkeys(map(digest, c))] for _, c in _chunks(texts)], dtype=object)


@F.pandas_udf(T.StructType().add("digests", T.ArrayType(_B)).add("inline", T.ArrayType(_B)))
def _inline(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for packed, shared in batches:
        for part, texts in _portions(packed):
            digests, inline = [], []
            for (_, chunks), away in zip(_chunks(texts), shared.iloc[part], strict=True):
                away = set() if away is None else set(away)
                names = [digest(c) for c in chunks]
                digests.append(names)
                inline.append([None if n in away else c for n, c in zip(names, chunks, strict=True)])
            yield pd.DataFrame({"digests": digests, "inline": inline})


@F.pandas_udf(T.ArrayType(T.StructType().add("digest", _B).add("bytes", _B)))
def _outline(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for packed, shared in batches:
        for part, texts in _portions(packed):
            out = []
            for (_, chunks), away in zip(_chunks(texts), shared.iloc[part], strict=True):
                names = {digest(c): c for c in chunks}
                out.append([{"digest": n, "bytes": zlib.compress(names[n])} for n in away])
            yield pd.Series(out, dtype=object)


@F.pandas_udf(_B)
def _rebuild(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for digests, inline, names, fetched in batches:
        out = []
        for order, own, n, b in zip(digests, inline, names, fetched, strict=True):
            table = {} if n is None else {k: zlib.decompress(v) for k, v in zip(n, b, strict=True)}
            parts = [table[d] if c is None else c for d, c in zip(order, own, strict=True)]
            if any(digest(c) != d for d, c in zip(order, parts, strict=True)):
                raise ValueError("a stored chunk does not match its digest")
            out.append(b"".join(parts))
        yield pd.Series(out, dtype=object)


def _plan(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed distinct texts with the digests kept elsewhere, chunk table, references."""
    t = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(F.unhex(F.sha2(t.cast("binary"), 256)).alias("payload_id"), pack(t).alias("_z"))
    # said here, or joins would add it to some uses only and the one exchange of texts could not be shared
    distinct = distinct.where("payload_id IS NOT NULL").groupBy("payload_id").agg(F.first("_z").alias("_z"))
    held = distinct.select("payload_id", F.explode(chunk_digests("_z")).alias("digest"))
    several = held.groupBy("digest").count().where("count > 1").select("digest")
    refs = held.join(evenly(several), "digest").select("payload_id", "digest")
    away = refs.groupBy("payload_id").agg(F.collect_set("digest").alias("_away"))
    marked = distinct.join(away, "payload_id", "left")
    out = marked.where("_away IS NOT NULL").select(F.explode(_outline("_z", "_away")).alias("_c"))
    chunks = out.groupBy(F.col("_c.digest").alias("digest")).agg(F.first("_c.bytes").alias("bytes"))
    return marked, chunks, refs


def _stored(marked: DataFrame) -> DataFrame:
    """Replace packed texts by their ordered chunk lists."""
    keep = [c for c in marked.columns if c not in ("_z", "_away")]
    return marked.select(*keep, _inline("_z", "_away").alias("_m")).select(*keep, "_m.digests", "_m.inline")


def store(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media table, chunk table and references of the distinct texts.

    ``media(payload_id, digests, inline)`` has one row per distinct text (null
    counts as empty) with its ordered chunk list; ``inline`` holds the bytes of
    chunks no other payload has.  ``chunks(digest, bytes)`` holds each shared
    chunk once, compressed; ``refs(payload_id, digest)`` says who needs it.
    ``payload_id`` is the SHA-256 of the UTF-8 text.
    """
    marked, chunks, refs = _plan(docs, text)
    return _stored(marked), chunks, refs


def _fetched(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(evenly(chunks), "digest").groupBy("payload_id").agg(F.collect_list(F.struct("digest", "bytes")).alias("_g"))


def _rebuilt(media: DataFrame) -> DataFrame:
    return media.select("payload_id", _rebuild("digests", "inline", F.col("_g.digest"), F.col("_g.bytes")).alias("media"))


def read_back(media: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """``(payload_id, media binary)``: stored forms rebuilt from verified chunks."""
    return _rebuilt(media.join(_fetched(chunks, refs), "payload_id", "left"))


_DESCRIBED = (
    T.StructType().add("payload_bytes", _L).add("payload_sha256", _S).add("tail_crc32", _L).add("media_bytes", _L).add("media_sha256", _S).add("feature", _S)
)


@F.pandas_udf(_DESCRIBED)
def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Digests and sample statistics of stored forms."""
    for s in batches:
        rows = []
        for m in s:
            p = unwrap(m)
            x = np.frombuffer(p, np.uint8)
            turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
            mean = float(x.mean(dtype=np.float64))
            power = float(np.sqrt(np.mean((x.astype(np.float32) - 128.0) ** 2, dtype=np.float64)))
            feature = f"mean={mean:.4f};rms={power:.4f};peak={int(x.max())};turns={turns}"
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def describe_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, the size of its text in bytes, and :func:`describe` of its media.

    Every distinct text is stored, read back and described once; the digest
    rows then go to all rows with that text.  Repeated rows are kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    marked, chunks, refs = _plan(docs, text)
    # the chunks a payload needs from the table arrive before its list is written out, so inline bytes stay where they are
    found = _rebuilt(_stored(marked.join(_fetched(chunks, refs), "payload_id", "left"))).select("payload_id", describe("media").alias("_d")).select("payload_id", "_d.*")
    mine = docs.select(F.col(key), F.octet_length(t).cast("long").alias("n_bytes"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("payload_id"))
    return mine.join(evenly(found), "payload_id").drop("payload_id")
