"""Main text of pages, the pipeline and the SQL twins."""

import pytest

pytest.importorskip("pointloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pointloom.llm import html_text  # noqa: E402


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit_tree(html_text.training_table(spark))


def test_labelled_pages_are_learned(tree):
    rows = html_text.labelled_rows(html_text.labelled_pages())
    assert sum(html_text.classify(tree, r[:-1]) == (r[-1] == 1.0) for r in rows) / len(rows) > 0.97


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="content">
<div class="cookie-banner"><p>We value your privacy, please accept everything at once.</p></div>
<header><a href="/">Site</a> <span>The daily page</span></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<article><h1>Fish &amp; chips</h1><p>A  first
paragraph &lt;here&gt; with <b>bold</b>text and <a href="x">one link</a> in it.<br>Next line<p>Unclosed second.
<!-- hidden <p>comment</p> --><ul><li>item one</li></ul>
<form><p>Leave your address</p></form><div id="comments"><p>First! What a fine article this is.</p></div></article>
<aside><p>Other stories of the day you may like to read as well.</p></aside><footer>&copy; us</footer>"""


def test_main_text(spark, tree):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<p>plain prose without any other markup around it", "x"), (4, "u", "<p>plain prose without any other markup around it", "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract(df, tree).collect()]
    assert got[0] == (1, "Fish & chips\n\nA first paragraph <here> with boldtext and one link in it. Next line\n\nUnclosed second.\n\nitem one")
    assert got[1:3] == [(2, ""), (3, "")] and got[3] == got[4] == (4, "plain prose without any other markup around it")
    assert html_text.extract(df.limit(0), tree).count() == 0
    assert html_text.text_blocks(df, tree).where("page_id = 1 AND keep").count() == 4


@pytest.mark.parametrize("page", ["<", "<p", "<p class='", "</p></p>", "a<b>c", "<a href=\"x>y", "<script>", "<!--", "&amp;&bogus;&#65;", "<p>" * 500 + "x", "x" * 100_000])
def test_broken_markup(page):
    html_text.blocks(page)


def plain_pipeline(rows, model):
    """The five stages in plain Python: rows are (doc_id, text, lang, source)."""
    import hashlib
    import re

    import numpy as np
    import sentencepiece
    from pointloom.llm import crf, langid, queries
    from test_training_data import brute_lines, fill, find

    sure = langid._summary(model.labels)
    kept = []
    for r in rows:
        words = crf.words_of(r[1])
        name, score = sure(words, next(model.marginals([words])) if words else np.zeros((0, 1)))
        if name != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            kept.append(r)
    gone = brute_lines([(k, t) for k, t, *_ in kept], 20)
    cleaned = []
    for i, (k, t, lang, source) in enumerate(kept):
        left = [s for j, s in enumerate(t.split("\n")) if (i, j) not in gone]
        text = "\n".join(left)
        if len(left) == t.count("\n") + 1 or text.split():
            cleaned.append((k, text, lang, source))
    sets = []
    for _, t, *_ in cleaned:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    first = {}
    for i, c in enumerate(find(len(sets), links)):
        first.setdefault(c, []).append(i)
    alone = [cleaned[min(part, key=lambda i: (cleaned[i][0] is None, cleaned[i][0] or 0, i))] for part in first.values()]
    domain = lambda s: next((n for n, (some, _) in queries.DOMAINS.items() if s in some), queries.OTHER_DOMAIN[0])
    leaf = lambda r: (domain(r[3]), r[2] or "", r[3] or "")
    count = lambda r: len(re.findall(r"[^ \t\r\n\f]+", r[1]))
    tokens = {}
    for r in alone:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + count(r)
    weights = [{n: w for n, (_, w) in queries.DOMAINS.items()} | dict([queries.OTHER_DOMAIN]), queries.LANGUAGES, {}]
    default = [0, queries.OTHER_LANGUAGE, 1]
    plan = {(): sum(tokens.values())}
    for depth in range(3):
        below = {}
        for path, budget in plan.items():
            caps = {}
            for k, v in tokens.items():
                if k[:depth] == path:
                    caps[k[: depth + 1]] = caps.get(k[: depth + 1], 0) + queries.MAX_EPOCHS * v
            below |= fill(budget, caps, {k: weights[depth].get(k[-1], default[depth]) for k in caps})
        plan = below
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = []
    for path, budget in plan.items():
        whole, rest = divmod(budget, tokens[path]) if tokens[path] else (0, 0)
        run = 0
        for _, r in sorted((hashlib.md5(f"9:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r) for r in alone if leaf(r) == path):
            run += count(r)
            ids = sp.encode(r[1], add_eos=True)
            out += [(r[0], r[2], r[3], tuple(ids), sp.decode(ids) == r[1])] * (whole + (rest > 0 and run <= rest))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    from pointloom.llm import langid

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(110).collect()
    some = [(r.doc_id, r.text, r.lang, r.source) for r in rows]
    some += [(9001, some[0][1], some[0][2], some[0][3]), (9002, None, "en", "src1"), (9003, "123 456 ²", "en", "src1"), (9004, "", None, None), some[5], some[5]]
    some += [(None, some[7][1] + " and a little more of it", "en", None), (9005, some[9][1] + " one two three", some[9][2], None), (9006, some[9][1] + "\n" + some[11][1], None, "elsewhere")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, r[1]) for r in some], "doc_id long, text string, lang string, source string, n_chars long, score double, ids string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    place = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.lang, r.source, tuple(r.ids), r.round_trip) for r in got.collect()), key=place) == sorted(plain_pipeline(some, langid.train(docs)), key=place)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.limit(120).collect()
    first = rows[0]
    extra = [(9001, first.text, first.lang, first.source, first.n_chars), (9002, None, "en", "src1", 0), (9003, "123 456", "en", "src1", 7)]
    df = spark.createDataFrame([tuple(r) for r in rows] + extra, docs.schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    seen = df
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in seen.select("doc_id").collect()}
        seen = stage(spark, seen, str(tmp_path)).persist()
        after = {r.doc_id for r in seen.select("doc_id").collect()}
        assert after <= before, name
        if name == "language_id":
            assert not {9002, 9003} & after and len(after) >= 115
        if name == "line_dedup":
            assert 9001 not in after and first.doc_id in after
        if name != "sentencepiece":
            assert seen.columns == corpus_pipeline.COLUMNS
    assert seen.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen.count()
