"""Edge cases and brute-force versions of the training-data operators."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import forest, langid, licenses, linededup, media, mixing, ngramjoin, queries, sentencepieces, toxicity  # noqa: E402
from pointloom.llm.components import connected_components  # noqa: E402
from pointloom.llm.store import numbered  # noqa: E402

DOC = "doc_id long, text string, lang string, source string"


def find(n, pairs):
    p = list(range(n))

    def top(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        p[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, 400), (7, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    exp = find(401, [(a, b) for a, b in pairs if b is not None])
    linked = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    assert got == {i: exp[i] for i in linked}


# --- op5 -------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    e = sentencepieces.PrefixTableEncoder(queries.piece_model())
    rng = random.Random(5)
    alphabet = list("abc ethinon  \n\t.,é漢😀ß▁<>/s12́½")
    texts = ["", " ", "a" * 300, " " * 77, "\x00", "<s></s><0x41>", "x" * 20_000, "tail \n"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        ids = e.sp.encode(t, add_eos=True)
        assert e.encode(t) == ids
        assert e.decode(ids) == e.sp.decode(ids)


def test_pieces_on_rows(spark):
    rows = [(1, "hello world", "en", "s"), (1, "hello world", "en", "s"), (2, None, None, None), (3, "", "", "")]
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("lang", "ids")
    got = sentencepieces.encode_decode(df, queries.piece_model()).collect()
    assert len(got) == 4 and [r.decoded for r in got] == ["hello world", "hello world", "", ""]
    assert list(got[2].ids) == [2]
    digest = sentencepieces.encoding_digests(df, queries.piece_model()).collect()
    assert digest[2].ids_sha256 == hashlib.sha256(b"2").hexdigest() and digest[2].n_tokens == 1
    assert sentencepieces.encoding_digests(df.limit(0), queries.piece_model()).count() == 0


# --- op2 -------------------------------------------------------------------------------------------------------------


def brute_lines(docs, min_chars):
    """(row, line) of all lines in a later copy of a run of any length; ``docs`` are (key, text) in row order."""
    places = sorted((k is not None, k or 0, r, i) for r, (k, t) in enumerate(docs) if t is not None for i in range(t.count("\n") + 1))
    text = {r: [s.strip(" ") for s in t.split("\n")] for r, (_, t) in enumerate(docs) if t is not None}
    gone = set()
    for size in range(1, max(map(len, text.values()), default=0) + 1):
        seen = set()
        for *_, r, i in places:
            run = tuple(text[r][i : i + size])
            if len(run) == size and sum(map(len, run)) >= min_chars:
                if run in seen:
                    gone |= {(r, i + k) for k in range(size)}
                seen.add(run)
    return gone


def deduped(spark, docs, parts=3):
    """Rows of the operator in the order of ``docs``, which carry their number in an extra column."""
    df = spark.createDataFrame([(k, t, i, 7) for i, (k, t) in enumerate(docs)], "doc_id long, text string, no int, n_lines int").coalesce(1)
    return [(r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).orderBy("no").collect()]


def expected(docs, min_chars=20):
    gone, out = brute_lines(docs, min_chars), []
    for r, (_, t) in enumerate(docs):
        kept = None if t is None else [s for i, s in enumerate(t.split("\n")) if (r, i) not in gone]
        out.append((None, 0, 0) if t is None else ("\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_line_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["alpha beta gamma delta", "short", "", "x", " y ", "nine char", "twelve chars", "a common line of some length", *(words(rng, 5) for _ in range(8))]
    docs = [(rng.choice([None, i, i, i // 2]), "\n".join(rng.choice(pool) if rng.random() < 0.85 else words(rng, 6, 10**6) for _ in range(rng.randrange(1, 14)))) for i in range(70)]
    docs += [(i, docs[3][1]) for i in (100, 101)] + [(102, "intro\n" + docs[4][1] + "\noutro"), (103, "\n".join(["x"] * 60)), (104, "\n".join(["", "y"] * 30))]
    assert deduped(spark, docs) == expected(docs)


def test_short_lines_count_together(spark):
    for run in ("eight ch\nsomewhat\nchars 08", "twelve chars\nx\nchars twelve", "\n".join("abcdefg")):
        docs = [(1, f"{run}\nonly here, in the first"), (2, f"another beginning of it\n{run}")]
        enough = len(run.replace("\n", "")) >= 20
        assert deduped(spark, docs)[1] == (("another beginning of it" if enough else docs[1][1]), run.count("\n") + 2, (run.count("\n") + 1) * enough)


def test_line_dedup_edges(spark):
    t = "one line that is long enough\nanother line that is long enough"
    docs = [(1, t), (2, None), (3, ""), (None, t), (4, t), (4, t), (5, "y" * 50_000), (7, "the same line of two rows"), (7, "a line that one row holds"), (8, "the same line of two rows")]
    docs += [(9, "\n".join(f"line number {i} of a long document" for i in range(30_000))), (10, "\n".join(f"line number {i} of a long document" for i in range(0, 30_000, 2)))]
    got = deduped(spark, docs)
    assert got[3] == (t, 2, 0)  # null keys come first
    assert got[0] == got[4] == got[5] == ("", 2, 2) and got[1] == (None, 0, 0) and got[2] == ("", 1, 0)
    assert [x[0] for x in got[7:10]] == ["the same line of two rows", "a line that one row holds", ""]
    assert got[10][2] == 0 and got[11] == ("", 15_000, 15_000)
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        linededup.repeated_runs(spark.createDataFrame([], "doc long, row long, line long, h binary, chars long"), 0)


def test_repeated_runs_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a first line of the run\nshort\nthe last line of the run"), (2, "before\na first line of the run\nshort\nthe last line of the run\nafter")], "doc_id long, text string")
    found = linededup.repeated_runs(linededup.lines_of(numbered(docs.coalesce(1)))).collect()
    assert [(r.line, r.n_lines) for r in found] == [(1, 3)]


# --- op3 -------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    rng = random.Random(3)
    base = words(rng, 3000)
    texts = [base, base, base + " tail", "head " + base, "", None, "é" * 40, "z" * 100_000]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, digests string, media string")
    stored = media.store(df)
    back = {bytes(r.payload_id): bytes(r.media) for r in media.read_back(*stored).collect()}
    for t in texts:
        raw = (t or "").encode()
        assert media.unwrap(back[hashlib.sha256(raw).digest()]) == media.payload(t or "")
    assert stored[1].count() > 3  # the long texts share chunks
    got = {r.doc_id: r for r in media.describe_documents(df).collect()}
    for i, t in enumerate(texts):
        p = media.payload(t or "")
        assert got[i].n_bytes == len((t or "").encode()) and got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-64:])
    assert got[0].feature == got[1].feature
    assert media.describe_documents(df.limit(0)).count() == 0


def test_cuts_do_not_depend_on_neighbours():
    rng = random.Random(4)
    some = [media.wrap(media.payload(words(rng, n))) for n in (5, 900, 4000, 1, 2500)]
    assert media.cuts(some) == [media.cuts([m])[0] for m in some]


# --- op4 -------------------------------------------------------------------------------------------------------------


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for _ in range(12):
        base = words(rng, 80).split()
        for k in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            docs.append(" ".join(w))
    docs += [docs[0], docs[0].upper(), "", None, "one two", "one  two", "a b c d e", words(rng, 20_000)]
    df = spark.createDataFrame([(i * 3, t, 1, 2) for i, t in enumerate(docs)], "doc_id long, text string, rep int, links int")
    sets = []
    for t in docs:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [(a, b) for a, b in combinations(range(len(docs)), 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp = find(len(docs), links)
    for block in (1500, 3):
        got = {r.doc_id: (r.class_id, r.n_links, r.component_id) for r in ngramjoin.jaccard_join(df, block=block).collect()}
        for i in range(len(docs)):
            first = min([j for j in range(len(docs)) if sets[j] == sets[i] and sets[i]] or [i])
            assert got[3 * i] == (3 * first, sum(i in p for p in links), 3 * comp[i])
    assert ngramjoin.keep_one(df).count() == len(set(comp))
    assert ngramjoin.jaccard_join(df.limit(0)).count() == 0


def test_jaccard_join_rows_and_keys(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))
    rows = [("k2", a), ("k2", a), (None, b), (None, "alone " * 9), (None, "other words " * 5), (None, "other words " * 5), ("k1", ""), ("k0", None), ("k9", "zz " + a)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id or "~", r.class_id or "~", r.n_links, r.component_id or "~") for r in ngramjoin.jaccard_join(df).collect()))
    assert got == sorted([("k2", "k2", 3, "k2")] * 2 + [("~", "~", 3, "k2"), ("~", "~", 0, "~"), ("~", "~", 1, "~"), ("~", "~", 1, "~"), ("k1", "k1", 0, "k1"), ("k0", "k0", 0, "k0"), ("k9", "k9", 3, "k2")])
    left = [(r.doc_id, r.text) for r in ngramjoin.keep_one(df).collect()]
    assert sorted((k or "~", t or "") for k, t in left) == sorted([("k2", a), ("~", "alone " * 9), ("~", "other words " * 5), ("k1", ""), ("k0", "")])


def test_chains_are_compared_by_bands(spark):
    """Windows that slide over one long text: every text is like its neighbours only."""
    base = [f"w{i}" for i in range(5000)]
    docs = [" ".join(base[i * 10 : i * 10 + 110]) for i in range(380)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in map(str.split, docs)]
    links = [(a, b) for a in range(len(docs)) for b in range(a + 1, min(a + 8, len(docs))) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp = find(len(docs), links)
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngramjoin.jaccard_join(df).collect()}
    assert links and got == {i: (sum(i in p for p in links), comp[i]) for i in range(len(docs))}
    rows = numbered(df.withColumnRenamed("doc_id", "key"))
    sk = ngramjoin.sketches(rows, 5).withColumn("rep", ngramjoin.F.col("row"))
    groups = ngramjoin._groups(sk, 1500, 2_000_000).select(ngramjoin.F.inline("groups"))
    work = groups.where("band >= 0").groupBy("g").count().selectExpr("sum(count * count)").first()[0]
    assert groups.where("band < 0").isEmpty() and work < 380 * 380 / 3


def test_large_groups_travel_as_differences(spark, monkeypatch):
    """Variants of one text in many blocks, some texts in the group that are unlike its first, one very long."""
    rng = random.Random(12)
    base = words(rng, 400).split()
    docs = [" ".join(base)]
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs.append(" ".join(w))
    docs += [" ".join(base[k : k + 150]) for k in range(0, 250, 10)] + [" ".join(base) + " " + words(rng, 3000)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in map(str.split, docs)]
    links = [(a, b) for a, b in combinations(range(len(docs)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp, n = find(len(docs), links), [0] * len(docs)
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    tables = {}
    write = ngramjoin.materialise
    monkeypatch.setattr(ngramjoin, "materialise", lambda t, name: tables.setdefault(name, write(t, name)))
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngramjoin.jaccard_join(df, block=40).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(docs))}
    sent = tables["blocks"].where("NOT base").groupBy("plain").agg({"size": "sum", "*": "count"}).collect()
    assert {r.plain for r in sent} == {False, True}
    near = tables["blocks"].where("NOT base AND NOT plain").selectExpr("sum(length(grams)) AS sent", "sum(8 * size) AS whole").first()
    assert near.sent < near.whole / 4


def test_common_in_portions():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    for columns in (64, 1000, 1 << 16):
        assert list(ngramjoin.common(sets, i, j, columns)) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_posterior_needs_more_matches_with_more_values():
    plan = ngramjoin.least_matches(ngramjoin.Fraction(4, 5), 1e-6)
    assert [n for n, _ in plan] == [32, 64, 96, 128] and all(0 < m < 0.8 * n for n, m in plan)


# --- op1 -------------------------------------------------------------------------------------------------------------


def test_forest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([c + 0.12 * rng.normal(size=(rng.integers(1, 12), 64)) for c in centres])
    labels = [int(i) for i in rng.integers(0, 2, len(x))]
    rows = [(i, v.tolist(), y, "extra") for i, (v, y) in enumerate(zip(x, labels, strict=True))]
    n = len(rows)
    rows += [(n, rows[0][1], labels[0], ""), (n + 1, None, 0, ""), (n + 2, [0.0] * 64, 0, ""), (n + 3, rows[0][1], None, ""), (n + 4, [float("nan")] * 64, 0, ""), (n + 5, [None] + rows[0][1][1:], labels[0], ""), (n + 6, [], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    good = np.concatenate([x, x[:1]])
    good /= np.linalg.norm(good, axis=1, keepdims=True)
    y = np.array([*labels, labels[0]])
    link = (good @ good.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(link, False)
    comp = find(n + 7, zip(*np.nonzero(link), strict=True))
    for leaf, block in ((40, 2000), (100, 25)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df, leaf=leaf, block=block).collect()}
        for i in range(n + 7):
            assert got[i] == (int(link[i].sum()) if i <= n else 0, comp[i], comp[i] == i)
    assert forest.near_duplicates(df.limit(0)).count() == 0


def clustered(rng, n, width=32, noise=0.1):
    """About ``n`` vectors in clusters of one to twenty near copies."""
    sizes = []
    while sum(sizes) < n:
        sizes.append(int(rng.integers(1, 20)))
    centres = rng.normal(size=(len(sizes), width))
    x = np.repeat(centres, sizes, axis=0)
    return x + noise * rng.normal(size=x.shape)


def linked(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    return link


@pytest.mark.parametrize("n", [1500, 4000])
def test_forest_recall_with_deep_trees(spark, n):
    """Leaves of about 60 vectors, most splits learned beyond the sample; one cluster holds a third of all."""
    rng = np.random.default_rng(n)
    x = clustered(rng, n)
    x = np.concatenate([x, rng.normal(size=32) + 0.25 * rng.normal(size=(n // 3, 32))])
    labels = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    link = linked(x, labels)
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(df, leaf=60, sample=400).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= link.sum(axis=1)).all()
    recall = found.sum() / link.sum()
    print(f"{len(x)} vectors: recall {recall:.4f} of {link.sum()} link ends")
    assert recall > 0.97


@pytest.mark.parametrize("leaf, least", [(1000, 0.99), (200, 0.99), (50, 0.98)])
def test_forest_recall_near_the_threshold(spark, leaf, least):
    """Pairs planted at cosines of 0.930 to 0.940, at several depths of the trees."""
    rng = np.random.default_rng(leaf)
    n = 3000
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.94, (n, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = forest.near_duplicates(df, leaf=leaf).where("n_links > 0").count()
    print(f"leaf {leaf}: recall {found / (2 * n):.4f}")
    assert found / (2 * n) >= least


def test_forest_rows_and_sizes(spark):
    big, small = [1e200, 1e200, 0.0], [1e-300, 1e-300, 0.0]
    rows = [(1, big, "a", 1), (2, [1e200, 1.01e200, 0.0], "a", 2), (3, small, "a", 3), (7, [1.0, 0.0, 0.0], "a", 4), (7, [0.0, 0.0, 1.0], "a", 5), (7, [0.0, 0.01, 1.0], "a", 6), (None, [0.0, 0.0, 2.0], "a", 7), (None, [5.0, 5.0, 0.0], None, 8), (None, [0.0, -1.0, 0.0], "a", 9), (20, [float(i == 3) for i in range(50_000)], "a", 10), (21, [float(i == 3) * 2 for i in range(50_000)], "a", 11)]
    df = spark.createDataFrame([(k, v, y, i, i, i) for k, v, y, i in rows], "vec_id long, embedding array<double>, label string, n_links int, component_id int, kept int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in forest.near_duplicates(df).collect())
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (7, 0, 7, True), (7, 2, 7, True), (7, 2, 7, True), (-1, 2, 7, False), (-1, 0, -1, True), (-1, 0, -1, True), (20, 1, 20, True), (21, 1, 20, False)])


# --- op7, op8 --------------------------------------------------------------------------------------------------------


def sentences(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(["a", "en", "ion", "o", ""]) for _ in range(n))


STEMS = {"aa": ["kilo", "mora", "tipa", "wero"], "bb": ["schul", "grun", "pfla", "zwis"], "cc": ["queu", "beaux", "oise", "trei"]}


def test_marginals_against_all_labellings():
    """Forward-backward equals the sum over every labelling of a chain."""
    from itertools import product

    from pointloom.llm.crf import forward_backward

    rng = np.random.default_rng(9)
    lengths, k = np.array([1, 4, 0, 3, 5]), 3
    scores, t, start = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, pairs = forward_backward(scores, lengths, t, start, pairs=True)
    exp, both, at = np.zeros_like(scores), np.zeros((k, k)), 0
    for n in lengths:
        total, own, two = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for y in product(range(k), repeat=int(n)):
            w = np.exp(sum(scores[at + i, c] for i, c in enumerate(y)) + (start[y[0]] if n else 0) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for i, c in enumerate(y):
                own[i, c] += w
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        exp[at : at + n], both, at = own / total, both + two / total, at + n
    assert np.allclose(got, exp, atol=1e-5) and np.allclose(pairs, both, atol=1e-4)


def test_letters_and_offsets():
    from pointloom.llm.crf import KeyTable, spans_of, words_of

    for t in ("²", "½ Ⅷ ① ٣ _ 12", "x²y a\u0130b ǅ é 漢字_ß", "İİ ok", "", "E=mc²"):
        spans = spans_of(t)
        assert [t[a:b].lower() for a, b in spans] == words_of(t) and all(t[a:b].isalpha() for a, b in spans)
        assert sum(b - a for a, b in spans) == sum(c.isalpha() for c in t)
    keys = np.unique(np.concatenate([np.arange(0, 64_000, 64, dtype=np.uint64), np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)]))
    assert (KeyTable(keys).find(keys) == np.arange(len(keys))).all() and (KeyTable(keys).find(keys + np.uint64(1 << 63)) == -1).all()
    assert len(KeyTable(keys[:0]).find(keys)) == len(keys)


def test_held_out_quality(spark):
    """Languages and toxicity of rows that nothing was learned from."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{folder}/labels.parquet")
    found = [r for r in queries.op8_language_id(spark, folder).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()]
    right = sum(r.lang == r.lang_pred for r in found)
    print(f"languages: {right} of {len(found)} held out")
    assert right >= 0.97 * len(found) > 0
    found = queries.op7_toxicity(spark, folder).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    right = sum(r.toxic == r.predicted for r in found)
    print(f"toxicity: {right} of {len(found)} held out")
    assert right >= 0.93 * len(found) > 0


def test_samples_are_bounded(spark):
    from pointloom.llm.crf import bounded_sample

    rows = [("en", "one and the same text")] * 5000 + [("en", f"text {i}") for i in range(3000)] + [("xx", f"rare {i}") for i in range(5)] + [(None, "nothing")]
    df = spark.createDataFrame(rows, "lang string, text string").where("lang IS NOT NULL")
    got = bounded_sample(df, "lang", 50, 1, ["lang", "text"])
    assert len({tuple(r) for r in got}) == len(got) <= 200 and sum(r.lang == "xx" for r in got) == 5 and 50 <= sum(r.lang == "en" for r in got) <= 100


def test_samples_hold_every_value_whatever_is_repeated(spark):
    from collections import Counter

    from pointloom.llm.crf import bounded_sample

    fr = spark.range(400_000).selectExpr("'fr' AS lang", "'un texte qui revient toujours' AS text")
    more = spark.range(300).selectExpr("explode(array('fr', 'en')) AS lang", "concat('texte ', id, ' de ', id * 7) AS text")
    many = spark.range(600 * 4).selectExpr("concat('l', id % 600) AS lang", "concat('some text ', id) AS text")
    got = bounded_sample(fr.union(more).union(many), "lang", 150, 8, ["lang", "text"])
    count = Counter(r.lang for r in got)
    assert len(count) == 602 and all(count[f"l{i}"] == 4 for i in range(600)) and all(150 <= count[x] <= 300 for x in ("fr", "en"))
    model = langid.train(fr.union(more.where("lang = 'fr'")).union(more.where("lang = 'en'").selectExpr("lang", "concat('the words of ', text, ' are these')")))
    assert model.labels == ["en", "fr"]
    long = spark.range(40).selectExpr("concat('l', id % 2) AS lang", "repeat(concat('word', id, ' '), 5000) AS text")
    sizes = [len(r.text) for r in bounded_sample(long, "lang", 20, 1, ["lang", "text"], "text", 10_000, 80_000)]
    assert len(sizes) == 40 and set(sizes) == {1000}


def test_language_id(spark):
    rng = random.Random(8)
    rows = [(i, sentences(rng, STEMS[v], 40), v, "s") for i, v in enumerate(["aa", "bb", "cc"] * 40)]
    train = spark.createDataFrame(rows, DOC)
    model = langid.train(train)
    test = [(900 + i, sentences(rng, STEMS[v], 25), v, 0.5) for i, v in enumerate(["aa", "bb", "cc"] * 10)] + [(990, None, None, 0.0), (991, "12 !?", "aa", 0.0), (992, "", "aa", 0.0), (994, "² ½ Ⅷ", "aa", 0.0), (993, sentences(rng, STEMS["bb"], 30_000), "bb", 0.0)]
    df = spark.createDataFrame(test, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[d].lang_pred == v and 0 <= got[d].score <= 1 for d, _, v, _ in test if d not in (990, 991, 992, 994))
    assert all(got[d].lang_pred == "und" for d in (990, 991, 992, 994))
    mixed = sentences(rng, STEMS["aa"], 12) + " " + sentences(rng, STEMS["bb"], 12)
    tags = langid.tag_words(spark.createDataFrame([(1, mixed, "", "")], DOC), model).orderBy("begin").collect()
    assert [t.lang for t in tags] == ["aa"] * 12 + ["bb"] * 12 and all(mixed[t.begin : t.end] == t.word for t in tags)
    assert langid.predict(df, langid.train(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(160):
        w = sentences(rng, STEMS["aa"], 60).split()
        if i % 4 == 0:
            w[rng.randrange(60)] = "vile" + rng.choice(["a", "en", "ion"])
            w[rng.randrange(60)] = "vileness"
        rows.append((i, " ".join(w), "aa", "s"))
        labels.append((i, int(i % 4 == 0)))
    docs, y = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, y.where("doc_id < 120"))
    extra = spark.createDataFrame([(500, None, "", ""), (501, "", "", ""), (503, "İ kilo viletude " + rows[0][1], "", ""), (502, rows[0][1] + " kilo" * 20_000, "", "")], DOC)
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(extra), model).collect()}
    assert all(got[i].predicted == t and 0 <= got[i].score <= 1 for i, t in labels if i >= 120)
    text = dict((r[0], r[1]) for r in rows)
    spans = {text[i][s.begin : s.end][:4] for i, t in labels if t and i >= 120 for s in got[i].spans}
    assert spans == {"vile"}
    odd = "İ kilo viletude " + rows[0][1]
    assert got[503].predicted == 1 and "vile" in {odd[s.begin : s.end][:4] for s in got[503].spans}
    twice = spark.createDataFrame([(1, rows[0][1], 0.25, "x")] * 3, "doc_id long, text string, score double, spans string")
    assert len({(r.score, r.predicted, str(r.spans)) for r in toxicity.score(twice, model).collect()}) == 1
    assert got[500].predicted == 0 and got[501].predicted == 0 and got[502].predicted == 1
    none = toxicity.train(docs, y.limit(0))
    assert toxicity.score(docs.limit(2), none).count() == 2


# --- op6 -------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.", "a/b/LICENSE"),
        (2, "int main", "a/b/c/d/x.c"),
        (3, "Licensed under the Apache License, Version 2.0", "a/b/c/y.c"),
        (4, "prose about a license to wonder and many other things of this world", "a/z.c"),
        (5, None, "a/b/q.c"),
        (6, "", None),
        (7, "Released under the MIT License.", "a/b/c/d/e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = {r.doc_id: r.license for r in licenses.detect(df).collect()}
    assert found == {1: "MIT", 3: "Apache-2.0", 7: "MIT"}
    got = {r.doc_id: (r.license, r.from_path) for r in licenses.inherit(df.select("doc_id", "path"), licenses.detect(df)).collect()}
    assert got[2] == ("MIT", "a/b/c/d") and got[3] == ("Apache-2.0", "a/b/c/y.c") and got[4] == (None, None) and got[5] == ("MIT", "a/b") and got[6] == (None, None)
    assert licenses.detect(df.limit(0)).count() == 0


# --- op9 -------------------------------------------------------------------------------------------------------------


def fill(total, caps, weights):
    """Water filling among siblings in whole tokens, by repeated rounds."""
    done = {}
    while True:
        left = total - sum(done.values())
        todo = [k for k in caps if k not in done]
        w = sum(weights[k] for k in todo)
        full = [k for k in todo if caps[k] * w <= left * weights[k]]
        if not full:
            return done | {k: max(left, 0) * weights[k] // w for k in todo}
        done |= {k: caps[k] for k in full}


def test_mixing_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["web", "web", "web", "books"]), rng.choice(["en", "de", None]), f"s{rng.randrange(3)}", rng.randrange(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    from pyspark.sql import functions as F

    wd, wl = {"web": 1, "books": 3}, {"en": 5, "de": 2, "": 1}
    weights = {"domain": F.when(F.col("domain") == "web", 1).otherwise(3), "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 2).otherwise(1), "source": F.lit(1)}
    got = {r.doc_id: r.copies for r in mixing.mix(df, ["domain", "lang", "source"], weights, (1, 1), 3, seed=4).collect()}
    tokens = {}
    for _, a, b, c, n in rows:
        tokens[a, b or "", c] = tokens.get((a, b or "", c), 0) + n
    caps = {k: 3 * v for k, v in tokens.items()}
    plan = {}
    top = fill(sum(tokens.values()), {a: sum(v for k, v in caps.items() if k[0] == a) for a in wd}, wd)
    for a in wd:
        langs = {k[1] for k in caps if k[0] == a}
        mid = fill(top[a], {b: sum(v for k, v in caps.items() if k[:2] == (a, b)) for b in langs}, wl)
        for b in langs:
            leaf = {k: v for k, v in caps.items() if k[:2] == (a, b)}
            plan |= fill(mid[b], leaf, dict.fromkeys(leaf, 1))
    for leaf, budget in plan.items():
        whole, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, 0)
        mine = sorted(((hashlib.md5(f"4:{whole}:{i}".encode()).hexdigest(), i, n) for i, a, b, c, n in rows if (a, b or "", c) == leaf))
        run = 0
        for _, i, n in mine:
            run += n
            assert got[i] == whole + (rest > 0 and run <= rest)
    assert mixing.repeated(mixing.mix(df, ["domain", "lang", "source"], weights)).count() > 0
    assert mixing.mix(df.limit(0), ["domain", "lang", "source"], weights).count() == 0


def test_mixing_of_one_large_leaf(spark):
    """The cut inside a leaf that holds nearly all rows, digit by digit of the hash."""
    from pyspark.sql import functions as F

    rng = random.Random(10)
    rows = [(i, "one", rng.randrange(40)) for i in range(4000)] + [(9000, "two", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(7)
    for share in ((1, 3), (3, 2)):
        got = {r.doc_id: r.copies for r in mixing.mix(df, ["source"], {"source": F.lit(1)}, share, 2, seed=3).collect()}
        total = sum(n for *_, n in rows)
        budget = fill(total * share[0] // share[1], {"one": 2 * (total - 5), "two": 10}, {"one": 1, "two": 1})["one"]
        whole, rest = divmod(budget, total - 5)
        run = 0
        for _, i, n in sorted((hashlib.md5(f"3:{whole}:{i}".encode()).hexdigest(), i, n) for i, s, n in rows if s == "one"):
            run += n
            assert got[i] == whole + (run <= rest)


def test_mixing_rows_and_keys(spark):
    from pyspark.sql import functions as F

    rows = [(k, "web", "s", 10, 7, "x", 1) for k in (None, None, 5, 5, 6, 7, 8)] + [(9, None, None, 0, 7, "y", 2), (10, "web", "s", None, 7, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, source string, n_tokens long, copies int, tokens string, budget int")
    out = mixing.mix(df, ["domain", "source"], {"domain": F.lit(1), "source": F.lit(1)}, (1, 2))
    got = out.collect()
    assert sorted(out.columns) == sorted(df.columns) and len(got) == len(rows) and {r.tokens for r in got} == {"x", "y", "z"}
    assert all(len({r.copies for r in got if r.doc_id == k}) == 1 for k in (None, 5))
    assert 0 < sum(r.copies * (r.n_tokens or 0) for r in got) <= 35
