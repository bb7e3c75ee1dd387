"""The divergence audit against plain counting, its merge, and edge cases."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import divergence  # noqa: E402

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top=50):
    docs = [(t or "", la or "", s or "") for t, la, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(TERM.findall(t.translate(UPPER)), s) for t, la, s in docs if la == lang]
        df = Counter(w for ws, _ in mine for w in set(ws))
        kept = [w for w in df if df[w] >= least]
        count = {s: Counter(w for ws, x in mine if x == s for w in ws if df[w] >= least) for s in {s for _, s in mine}}
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        everything = sum(count.values(), Counter())
        for s, c in count.items():
            pairs = [(sum(abs(share(c, w) - share(count[o], w)) for w in kept), o) for o in count if o != s]
            terms = [(share(c, w) - share(everything, w), w) for w in kept if c[w]]
            for part, found in (("pair", pairs), ("term", [x for x in terms if x[0] > 0])):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, v, rank))
    return sorted(out)


def run(spark, docs, **more):
    df = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], "text string, lang string, source string, value long, term string")
    return sorted(tuple(r) for r in divergence.divergence(df, **more).collect())


def test_against_plain_counting(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["The", "the", "É", "é", "漢字", "a-b", "x1y", "Z_z", " ", "ſ", "K"]) + rng.choice(["", "", "q", "Q", "é"]) for _ in range(rng.randrange(0, 30)))
    docs = [(say() if rng.random() < 0.95 else None, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "é", "z", None])) for _ in range(150)]
    docs += [docs[0]] * 70 + [("only", "fr", "s0"), (None, "it", "a"), ("!", "it", "b"), ("", "it", "c")]
    assert run(spark, docs, least_docs=3, width=2, unit_terms=3) == plain(docs, 3)
    assert run(spark, docs, least_docs=2, top=4) == plain(docs, 2, 4)


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
    assert run(spark, [(None, None, None), ("few", None, "a")]) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_runs_are_spilled_and_merged(spark):
    rng = random.Random(8)
    docs = [(" ".join(chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26)) for _ in range(40)), rng.choice(["l", "m"]), f"s{rng.randrange(9)}") for _ in range(80)]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    got = {(r.lang, bytes(r.term).decode()): dict(zip(r.sources, r.counts)) for r in divergence.frequencies(df, least_docs=2, block_bytes=20_000, page=7).collect()}
    count, seen = {}, Counter()
    for t, la, s in docs:
        for w in t.split():
            count.setdefault((la, w), Counter())[s] += 1
        seen.update((la, w) for w in set(t.split()))
    assert got == {k: dict(c) for k, c in count.items() if seen[k] >= 2}


def test_heap_merge_opens_pages_when_due():
    rng = random.Random(1)
    pages, expected = [], []
    for _ in range(30):
        terms = sorted({f"{rng.randrange(200):03}".encode() for _ in range(20)})
        pages += [SimpleNamespace(first=terms[at], terms=terms[at : at + 6]) for at in range(0, len(terms), 6)]
        expected += terms
    read = []

    def stream():
        for p in sorted(pages, key=lambda p: p.first):
            read.append(p)
            yield p

    got = []
    for term, at, page in divergence.heap_merge(stream()):
        assert page.terms[at] == term
        got.append(term)
        assert all(p.first <= term for p in read[:-1])
    assert got == sorted(expected)


def test_billionths_are_exact(spark):
    values = [(0, 0, 1), (7, 21, 3), (10**15 + 1, 10**18 - 7, 10**9), (3, 0, 0)]
    df = spark.createDataFrame(values, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.billionths(df.c, df.n, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else None for c, n, v in values]
