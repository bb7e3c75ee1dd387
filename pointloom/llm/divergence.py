"""Source divergence audit by single-pass in-memory indexing.

Every task reads its documents once and builds an index in memory: counts of a
term by group, and documents of a term by language.  When the index is full it
is spilled as a term-sorted run, cut in pages by the hash of the term.  The
pages of a hash shard meet sorted by their first term; a heap merges the runs,
opening a page when its first term is due, so a task holds one page per run
that is being read, never a shard.  Terms in enough documents stay.

Probabilities are whole billionths.  Differences between the sources of a
language start from the value of absent terms, and the terms stream past blocks
of sources as corrections to it.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, small

#: Bytes of terms: letters of ASCII, lower-cased, and all bytes beyond; other bytes become spaces.
TERM_BYTES = bytes(x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
SCALE, PRIOR = 1_000_000_000, 5
_PAGE = "shard int, lang string, first binary, terms array<binary>, docs array<long>, held array<int>, names array<string>, sources array<int>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


class Block:
    """An index in memory: for each language the numbers of its terms and the postings of its documents."""

    def __init__(self) -> None:
        self.terms: dict[str, dict[bytes, int]] = {}
        self.sources: dict[str, dict[str, int]] = {}
        #: By language: term number, count and source of every term of every document.
        self.postings: dict[str, tuple[array, array, array]] = {}
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        known = self.terms.setdefault(lang, {})
        sources = self.sources.setdefault(lang, {})
        ids, counts, owners = self.postings.setdefault(lang, (array("i"), array("q"), array("i")))
        before = len(known)
        held = Counter(terms_of(text))
        ids.extend([known.setdefault(t, len(known)) for t in held])
        counts.extend(held.values())
        owners.extend([sources.setdefault(source, len(sources))] * len(held))
        self.bytes += 160 * (len(known) - before) + 16 * len(held)

    def spill(self, shards: int, page: int) -> Iterator[pd.DataFrame]:
        """The index as pages of sorted terms, which empties it."""
        for lang, known in self.terms.items():
            if not known:
                continue
            ids, counts, owners = (np.array(x, np.int64) for x in self.postings[lang])
            terms, names = list(known), np.array(list(self.sources[lang]), object)
            order = sorted(range(len(terms)), key=terms.__getitem__)
            shard = np.array([zlib.crc32(t) % shards for t in terms])
            place = np.empty(len(terms), np.int64)  # of a term among those of its shard, all shards end to end
            order = np.array(order)[np.argsort(shard[order], kind="stable")]
            place[order] = np.arange(len(terms))
            docs = np.bincount(place[ids], minlength=len(terms))
            pair, at = np.unique(place[ids] * len(names) + owners, return_inverse=True)
            total = np.bincount(at, counts, len(pair)).astype(np.int64)  # far below 2**53 in a block
            begin = np.searchsorted(pair, np.arange(len(terms) + 1) * len(names))
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for no in range(shards):
                rows = []
                for a in range(edges[no], edges[no + 1], page):
                    b = min(a + page, edges[no + 1])
                    part = [terms[k] for k in order[a:b]]
                    used, code = np.unique(pair[begin[a] : begin[b]] % len(names), return_inverse=True)
                    rows.append((no, lang, part[0], part, docs[a:b], np.diff(begin[a : b + 1]), names[used], code, total[begin[a] : begin[b]]))
                if rows:
                    yield pd.DataFrame(rows, columns=["shard", "lang", "first", "terms", "docs", "held", "names", "sources", "counts"])
        self.__init__()


def runs(docs: DataFrame, shards: int, block_bytes: int, page: int) -> DataFrame:
    """Pages of term-sorted runs of ``docs`` (lang, source, text)."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = Block()
        for df in batches:
            for lang, source, text in zip(df["lang"], df["source"], df["t"], strict=True):
                here.add(lang, source, text)
                if here.bytes >= block_bytes:
                    yield from here.spill(shards, page)
        yield from here.spill(shards, page)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("t")).mapInPandas(index, _PAGE)


def heap_merge(pages: Iterator) -> Iterator[tuple[bytes, int, object]]:
    """(term, place, page) of the terms of all pages in order; pages come by their first term.

    A page is opened when every term before its first one has been given out.
    """
    heap: list[tuple] = []
    for no, page in enumerate(pages):
        due = bytes(page.first)
        while heap and heap[0][0] < due:
            yield _least(heap)
        heapq.heappush(heap, (due, no, 0, page))
    while heap:
        yield _least(heap)


def _least(heap: list[tuple]) -> tuple[bytes, int, object]:
    term, no, at, page = heap[0]
    if at + 1 < len(page.terms):
        heapq.heapreplace(heap, (page.terms[at + 1], no, at + 1, page))
    else:
        heapq.heappop(heap)
    return term, at, page


def frequencies(docs: DataFrame, least_docs: int = 30, block_bytes: int = 96 << 20, page: int = 1000) -> DataFrame:
    """``(lang, term binary, sources, counts)``: occurrences of terms in at least ``least_docs`` documents of a language.

    ``docs`` has lang, source and text without nulls.  ``block_bytes`` bounds
    an index in memory.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = runs(docs, shards, block_bytes, page).repartition(shards, "shard").sortWithinPartitions("lang", "first")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []

        def done(lang: str, term: bytes | None, docs: int, found: list) -> None:
            if docs < least_docs or term is None:
                return
            held: Counter = Counter()
            for at, page in found:
                a, b = page.to[at] - page.held[at], page.to[at]
                for s, c in zip(page.sources[a:b].tolist(), page.counts[a:b].tolist(), strict=True):
                    held[page.names[s]] += c
            rows.append((lang, term, list(held), list(held.values())))

        pages = (Page(r) for df in batches for r in df.itertuples(index=False))
        for lang, mine in groupby(pages, key=lambda p: p.lang):
            now, docs, found = None, 0, []
            for term, at, p in heap_merge(mine):
                if term != now:
                    done(lang, now, docs, found)
                    now, docs, found = term, 0, []
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=["lang", "term", "sources", "counts"])
                        rows.clear()
                docs += p.docs[at]
                found.append((at, p))
            done(lang, now, docs, found)
        yield pd.DataFrame(rows, columns=["lang", "term", "sources", "counts"])

    return pages.mapInPandas(merge, "lang string, term binary, sources array<string>, counts array<long>")


class Page:
    """A page of a run, as it is read by the merge."""

    __slots__ = ("counts", "docs", "first", "held", "lang", "names", "sources", "terms", "to")

    def __init__(self, row):
        self.lang, self.first, self.names, self.sources, self.counts = row.lang, row.first, row.names, row.sources, row.counts
        self.terms, self.docs, self.held = row.terms.tolist(), row.docs.tolist(), row.held.tolist()
        self.to = np.cumsum(row.held).tolist()


def billionths(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kinds)), exact; null without kinds."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = (wide(count) + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kinds) * PRIOR
    return F.when(kinds > 0, F.call_function("div", over, under) + 1)


def corrections(frame: pd.DataFrame) -> pd.DataFrame:
    """Pair sums of one unit: a block of sources against another, over a shard of the terms.

    Rows without a term give the value ``p`` of absent terms for every source;
    in the first shard they also start the sums.
    """
    base, found = frame[frame["term_no"].isna()], frame[frame["term_no"].notna()]
    one, two, shard, lang = int(frame["i"].iloc[0]), int(frame["j"].iloc[0]), int(frame["shard"].iloc[0]), frame["lang"].iloc[0]
    terms, at = np.unique(found["term_no"].to_numpy(np.int64), return_inverse=True)
    no = np.sort(base["no"].to_numpy())
    absent = base.sort_values("no")["p"].fillna(0).to_numpy(np.int64)
    p = np.tile(absent, (len(terms), 1))
    p[at, np.searchsorted(no, found["no"].to_numpy())] = found["p"].to_numpy(np.int64)
    block = base.sort_values("no")["block"].to_numpy()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    kinds = int(base["kinds"].iloc[0]) if shard == 0 else 0
    out = []
    for a in left:
        mine = right[right > a]
        apart = np.abs(absent[mine] - absent[a])
        f = kinds * apart + (np.abs(p[:, mine] - p[:, [a]]) - apart).sum(axis=0)
        out += [(lang, int(no[a]), int(no[b]), int(v)) for b, v in zip(mine, f, strict=True)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "f"])


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50, width: int = 256, unit_terms: int = 2000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how the sources of a language differ in their terms.

    Part ``pair``: the sum of absolute differences to each other source over
    all kept terms, all ranks.  Part ``term``: the kept terms of a source whose
    share is above that of the language, and by how much, the first ``top``
    ranks.  Null texts, languages and sources count as ''; every row is a
    document, also a repeated one.  A language without kept terms has pairs
    of value 0; a language with one source has none.  ``width`` bounds the
    sources of a block and ``unit_terms`` the mean number of terms of a unit.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = materialise(frequencies(rows, least_docs).withColumn("term_no", F.monotonically_increasing_id()), "frequencies")
    held = kept.select("lang", "term", "term_no", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("all_count"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    held = held.select("lang", "term", "term_no", "all_count", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = held.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_lang = held.groupBy("lang").agg(F.sum("count").alias("all_total"))
    groups = rows.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").join(of_lang, "lang", "left")
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", zero("total"), zero("kinds"), zero("all_total"), no.alias("no"))
    groups = groups.withColumn("block", F.floor(F.col("no") / width).cast("int")).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    groups = small(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kinds") / unit_terms)).cast("int")), "groups")

    known = held.join(groups, ["lang", "source"]).withColumn("p", billionths(F.col("count"), F.col("total"), F.col("kinds")))
    more = known.withColumn("value", F.col("p") - billionths(F.col("all_count"), F.col("all_total"), F.col("kinds"))).where("value > 0")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term"))
    term = more.select("lang", "source", "term", "value", F.row_number().over(first).alias("rank")).where(F.col("rank") <= top)
    term = term.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    unit = ["lang", "shard", "i", "j"]
    columns = ["lang", "block", "blocks", "no", "kinds", "p"]
    absent = groups.withColumn("p", billionths(F.lit(0), F.col("total"), F.col("kinds")))
    absent = absent.select(*columns, F.lit(None).cast("long").alias("term_no"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    sent = known.select(*columns, "term_no", F.pmod(F.xxhash64("term_no"), F.col("shards")).cast("int").alias("shard")).unionByName(absent)
    sent = sent.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).select(*unit, "block", "no", "kinds", "p", "term_no")
    sums = sent.groupBy(*unit).applyInPandas(corrections, "lang string, a int, b int, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))).alias("x"), "value")
    both = both.select("lang", "x.no", "x.other", "value").join(groups.select("lang", "no", "source"), ["lang", "no"])
    both = both.join(groups.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pair.unionByName(term)
