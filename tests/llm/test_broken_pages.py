"""Unclosed and self-closed markup against hand-written texts."""

import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import html_text  # noqa: E402

LONG = "The river had risen for three days before anyone in the valley began to worry about the old stone bridge."
MORE = "Engineers measured the piers every hour and found that the foundations had moved by less than a finger."


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit_tree(html_text.training_table(spark))


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<body><p class='meta'>By Ann<p>{LONG}<p>{MORE}</body>", [LONG, MORE]),
        (f"<body><p class='text'>{LONG}<p class='text'>{MORE}<footer>All rights reserved by the valley paper.</footer></body>", [LONG, MORE]),
        (f"<body><svg class='icon'/><p>{LONG}</p><math display='block'/><p>{MORE}</p></body>", [LONG, MORE]),
        (f"<body><svg><path d='x'/></svg><p>{LONG}</p></body>", [LONG]),
        (f"<body><p class='ad'>Buy soap<p>{LONG}<p>{MORE}</body>", [LONG, MORE]),
        (f"<body><p class='byline'>By Ann<p>{LONG}<p>{MORE}</body>", [LONG, MORE]),
        (f"<body><p title='a hidden gem'>{LONG}</p><p data-note='hidden'>{MORE}</p></body>", [LONG, MORE]),
        (f"<body><div class='search-results content'><p>{LONG}</p><p>{MORE}</p></div></body>", [LONG, MORE]),
        (f"<body><div id='form-of-art'><p>{LONG}</p><p>{MORE}</p></div></body>", [LONG, MORE]),
        (f"<body class='with-sidebar'><div class='has-comments'><p>{LONG}</p><p>{MORE}</p></div></body>", [LONG, MORE]),
        (f"<head><title>x</title><body><p>{LONG}</p><p>{MORE}</p></body>", [LONG, MORE]),
        *[(f"<body><p>{LONG}</p><{n}>Share<p>{MORE}</p></body>", [LONG, MORE]) for n in ("button", "select", "noscript", "object", "video", "audio", "canvas", "svg")],
        *[(f"<body><p>{LONG}</p><{n}>Share<p>{MORE}</p><{n}>Print</{n}></body>", [LONG, MORE]) for n in ("button", "svg")],
        (f"<body><object><object>x</object>y</object><p>{LONG}</p></body>", [LONG]),
        (f"<body><p>{LONG}</p><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> here, as every child knows by now.</p></body>", [LONG, "Energy is E=m here, as every child knows by now."]),
        (f"<article><p>{LONG}</p><div class='notice-board'><p>{MORE}</p></div><div class='related-work'><p>{LONG}</p></div></article>", [LONG, MORE, LONG]),
        (f"<body><div><p>{LONG}</p><p>{MORE}</p></div><div><h2>3 comments</h2><p>{MORE}</p><p>Fine.</p></div></body>", [LONG, MORE]),
        (f"<article><p>{LONG}</p><p>{MORE}</p><p><a href='/s'>The minutes of the council</a></p><h2>Sources</h2><ul><li><a href='/1'>A map of the valley</a></li><li><a href='/2'>The survey of the piers</a></li></ul></article>", [LONG, MORE, "The minutes of the council", "Sources", "A map of the valley", "The survey of the piers"]),
        ("<body><p>Hello.</p><p>Ok.</p></body>", ["Hello.", "Ok."]),
        (f"<body><div><p>{LONG}</p><p>{MORE}</p></div><p>Copyright 2020 the paper of the valley and all of its friends.</p></body>", [LONG, MORE]),
        (f"<body><div style='display: none'>Secret words.</div><p>{LONG}</p><p>{MORE}</p></body>", [LONG, MORE]),
    ],
)
def test_text(tree, page, expected):
    assert [t for t, x in html_text.blocks(page) if html_text.classify(tree, x)] == expected


def test_marks_end_with_their_paragraph():
    at = html_text.FEATURES.index
    got = {t: (x[at("aside")], x[at("main")]) for t, x in html_text.blocks("<p class='meta'>a<p>b<p class='content'>c<div>d</div>")}
    assert got == {"a": (0.75, 0.0), "b": (0.0, 0.0), "c": (0.0, 1.0), "d": (0.0, 0.0)}


def test_features_of_neighbours():
    got = html_text.blocks("<p>one two three</p><p><a href='/'>four</a> five</p><p>six</p>")
    assert [x[:6] for _, x in got] == [[3, 0, 2, 0, 0, 0.5], [2, 3, 1, 0.5, 0, 0], [1, 2, 0, 0, 0.5, 0]]


@pytest.mark.parametrize("page", ["<b>" * 40_000 + "</i>" * 40_000, "<div>" + "<b>" * 40_000 + "<p>x</p>" * 40_000, "<div class=ad>x" * 40_000, "<p>x" * 80_000, "<head><body>" * 20_000, "<button>x" * 40_000, "<svg>x" * 40_000, "<h2>Comments</h2>" * 20_000])
def test_time_in_proportion(page):
    import time

    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 4


def test_held_out_layouts(spark):
    """Trained without some layouts and articles, the tree still labels their blocks."""
    pages = html_text.labelled_pages()
    n = len(html_text.ARTICLES)
    held = [i for i in range(len(pages)) if i // n % 4 == 1 or i % n % 4 == 3]
    tree = html_text.fit_tree(html_text.training_table(spark, [p for i, p in enumerate(pages) if i not in held]))
    rows = html_text.labelled_rows([pages[i] for i in held])
    right = sum(html_text.classify(tree, r[:-1]) == (r[-1] == 1.0) for r in rows)
    print(f"held-out blocks: {right} of {len(rows)} right")
    for layout in sorted({i // n for i in held if i // n % 4 == 1}):
        own = html_text.labelled_rows([pages[i] for i in held if i // n == layout])
        print(f"layout {layout}: {sum(html_text.classify(tree, r[:-1]) == (r[-1] == 1.0) for r in own)} of {len(own)}")
    assert right / len(rows) > 0.95


def test_tree_uses_words_and_links(tree):
    used = set()

    def walk(t):
        if not isinstance(t, bool):
            used.add(html_text.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert used >= {"words", "links"} and used & {"words_before", "words_after", "links_before", "links_after"}


def test_articles_of_the_tables(spark, tree):
    """All pages of a table against a reader of their article elements that knows no blocks or trees."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.cut(tag)

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.cut(tag)

        def cut(self, tag):
            if tag in ("p", "h1", "article"):
                self.parts.append("")
            elif tag == "br":
                self.parts[-1] += " "

        def handle_data(self, data):
            if self.inside:
                self.parts[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages, tree).collect():
        reader = Article()
        reader.feed(r.html or "")
        assert r.text == "\n\n".join(" ".join(p.split()) for p in reader.parts if p.strip()), r.page_id
