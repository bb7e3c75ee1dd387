"""Suffix-array dedup and whitening against plain versions, and their edge cases."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import suffixes, whitening  # noqa: E402


def brute_bytes(docs, depth):
    """Removed spans and kept bytes of (key, text) rows, by all windows."""
    raw = [(k, (t or "").encode()) for k, t in docs]
    low = {}
    for k, b in raw:
        for i in range(len(b) - depth + 1 if k is not None else 0):
            s = b[i : i + depth]
            low[s] = min(low.get(s, k), k)
    out = []
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1 if k is not None else 0):
            if low[b[i : i + depth]] < k:
                gone[i : i + depth] = b"\1" * depth
        spans = [(i, next((j for j in range(i, len(b)) if not gone[j]), len(b))) for i in range(len(b)) if gone[i] and not (i and gone[i - 1])]
        out.append((k, len(b), sum(gone), tuple(spans), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def run_bytes(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffixes.dedup_bytes(df, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=repr)


def texts(rng, n):
    """Texts that share passages, lines of one letter, copies and near copies."""
    say = lambda k: " ".join(rng.choice(["né", "alpha", "be", "漢字", "delta", "of", "x"]) + str(rng.randrange(30)) for _ in range(k))
    shared = [say(rng.randrange(8, 60)) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rng.randrange(7)
        if kind == 0 and out:
            t = rng.choice(out)
        elif kind == 1 and out:
            t = rng.choice(out)
            t = t[: len(t) // 2] + "!" + t[len(t) // 2 :]
        elif kind == 2:
            t = "a" * rng.randrange(40, 130)
        else:
            t = say(rng.randrange(0, 40)) + rng.choice(shared) + say(rng.randrange(0, 40))
        out.append(t)
    return out


@pytest.mark.parametrize("depth", [16, 33, 50])
def test_bytes_against_all_windows(spark, depth):
    rng = random.Random(depth)
    docs = [(rng.randrange(50), t) for t in texts(rng, 90)] + [(None, "q" * 80), (99, "q" * 80), (None, None), (7, None), (8, ""), (9, "z" * 49), (10, "z" * 49), (5, "\0" * 200), (6, "\0" * 120)]
    rng.shuffle(docs)
    assert run_bytes(spark, docs, depth=depth, pack_bytes=3000, bucket_bytes=5000) == brute_bytes(docs, depth)


def test_slices_do_not_matter(monkeypatch):
    """The digits of the passes, a few bytes at a time and at once."""
    rng = random.Random(3)
    text = "".join(rng.choice("abc é") for _ in range(3000)).encode()
    p = suffixes.Pack(np.array([4]), np.array([len(text)]), text, 50, 5)
    live = p.window.copy()
    a, runs = p.least()
    b = p.inner(live)
    p.kept.clear()
    monkeypatch.setattr(suffixes, "SLICE", 101)
    c, short = p.least()
    d = p.inner(live)
    full = lambda x, found: np.repeat(x.value[x.place], np.concatenate([f[1] for f in found]))
    assert np.array_equal(full(a, runs), full(c, short))
    assert np.array_equal(b.value[b.place], d.value[d.place]) and np.array_equal(b.bucket[b.place], d.bucket[d.place])


def test_bytes_of_one_copied_text(spark):
    """A third of all rows is one text, another third one text with small changes."""
    base = " ".join(f"word{i}" for i in range(60))
    docs = [(i, base) for i in range(40)] + [(100 + i, base[:150] + f"<{i}>" + base[150:]) for i in range(40)] + [(200 + i, f"own text number {i} " * 9) for i in range(40)]
    assert run_bytes(spark, docs, pack_bytes=2000, bucket_bytes=3000) == brute_bytes(docs, 50)


def test_packs_get_their_own_answers(spark, monkeypatch):
    """Answers go to the one pack that asked, however many packs a task has written; last digits have buckets of their own size."""
    rng = random.Random(6)
    docs = [(i, t) for i, t in enumerate(texts(rng, 60))]
    rows, asked = [], suffixes._asked
    monkeypatch.setattr(suffixes, "_asked", lambda packed, name, make: rows.append((packed, out := asked(packed, name, make))) or out)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = suffixes.dedup_bytes(df, pack_bytes=900, bucket_bytes=1000).collect()
    assert sum(r.n_removed for r in got) == sum(r[2] for r in brute_bytes(docs, 50))
    packs = {r.pack for r in rows[0][0].select("pack").collect()}
    assert len(packs) > 8
    for _, answers in rows:
        found = answers.collect()
        assert len(found) > 1 and len({r.pack for r in found}) == len(found) and {r.pack for r in found} <= packs
        assert all(len({(a.kind, a.bucket) for a in r.answers}) == len(r.answers) for r in found)
    most = {kind: max(a.bucket for _, t in rows for r in t.collect() for a in r.answers if a.kind == kind) for kind in (suffixes.LEAST, suffixes.WHOLE)}
    assert most[suffixes.LEAST] < max(4, -(-sum(len(t.encode()) for _, t in docs) // 8000)) <= most[suffixes.WHOLE]


def test_bytes_of_nothing(spark):
    assert run_bytes(spark, []) == []
    assert run_bytes(spark, [(None, None)]) == [(None, 0, 0, (), b"")]
    df = spark.createDataFrame([(1, "t" * 60, 5, "x")], "doc_id long, text string, n_bytes int, part string")
    assert suffixes.dedup_bytes(df).columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    with pytest.raises(ValueError):
        suffixes.dedup_bytes(df, depth=15)


def brute_white(rows, most=16, by_count=False):
    kept = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < whitening.LARGEST for c in v)]
    distinct = sorted({x for _, x in kept})
    weight = [sum(x == y for _, y in kept) if by_count else 1 for x in distinct]
    n = sum(weight)
    s = [sum(w * x[j] for w, x in zip(weight, distinct)) for j in range(len(distinct[0]))]
    c = np.array([[(n * v - t) / n for v, t in zip(x, s)] for x in distinct])
    e, u = np.linalg.eigh((c * np.array(weight)[:, None]).T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    trace = e.sum()
    out = {}
    for k, x in kept:
        d = [n * v - t for v, t in zip(x, s)]
        for i in range(min(most, len(e))):
            if e[i] > 1e-12 * trace:
                out.setdefault((k, i + 1), []).append((n, sum(v * v for v in d), float(np.dot(np.array(d) / n, u[:, i]) / math.sqrt(e[i])), e[i] / trace))
    return out


VEC = "vec_id long, embedding array<float>, label int, x string, component string"


def against(spark, rows, **more):
    got = whitening.whiten(spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], VEC), **more).collect()
    exp = brute_white(rows, by_count=more.get("by_count", False))
    mine = {}
    for r in got:
        assert r.identity_error < 1e-9
        mine.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert {k: len(v) for k, v in mine.items()} == {k: len(v) for k, v in exp.items()}
    for i in {c for _, c in exp}:
        pairs = [(m, x) for (k, c), v in exp.items() if c == i for m, x in zip(sorted(mine[k, c]), sorted(v))]
        assert all(m[:2] == x[:2] and abs(m[3] - x[3]) < 1e-10 for m, x in pairs)
        assert max(abs(m[2] - x[2]) for m, x in pairs) < 1e-7 or max(abs(m[2] + x[2]) for m, x in pairs) < 1e-7


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening_against_numpy(spark, by_count):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, base[i % 40 if i < 60 else 0].tolist()) for i in range(90)]  # a third is one vector
    rows += [(500, None), (501, [None] + [0.0] * 19), (502, [math.nan] * 20), (503, [math.inf] * 20), (504, [3e38] * 20), (None, base[1].tolist()), (3, base[2].tolist())]
    against(spark, rows, by_count=by_count)


def test_whitening_of_few_directions(spark):
    rows = [(i, [float(i), 2.0 * i, -0.0]) for i in range(5)]
    against(spark, rows)
    df = lambda r: spark.createDataFrame([(k, v, 1, "x", "y") for k, v in r], VEC)
    assert whitening.whiten(df([(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
    assert whitening.whiten(df([])).count() == 0
    assert whitening.whiten(df([(1, []), (2, None)])).count() == 0


def test_whitening_by_length_and_beyond_64_bits(spark):
    rng = np.random.default_rng(3)
    short, far = [(i, rng.normal(size=2).tolist()) for i in range(8)], [(100 + i, (rng.normal(size=3) * 1e11).tolist()) for i in range(9)]
    df = lambda r: spark.createDataFrame([(k, v, 1, "x", "y") for k, v in r], VEC)
    both = {(r.vec_id, r.component): r for r in whitening.whiten(df(short + far)).collect()}
    for part in (short, far):
        for (k, i), [(n, dev, w, ex)] in brute_white(part).items():
            r = both[k, i]
            assert (r.n, r.deviation) == (n, dev if dev < 1 << 63 else None) and abs(abs(r.whitened) - abs(w)) < 1e-7 and abs(r.explained - ex) < 1e-9
