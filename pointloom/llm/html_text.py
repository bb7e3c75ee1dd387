"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks (runs of text between block elements).  Each
block has its word count and link density and those of the blocks before and
after it.  Two weak features come from the markup: whether the block lies in an
element that names itself as main text, and how small a part of the page's
words the innermost element holds that names itself as menu, advert, notice or
the like (an element around the whole page counts for nothing, and
readers' comments, by their name or by the heading over them, count in full).
Two more are whether a block outside the main part claims rights, and whether a
block ends like a sentence.  A decision
tree trained with MLlib on a small table of blocks labelled by hand
(:func:`labelled_pages`) decides which blocks belong to the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
SPACE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# fixed values: element names of the markup language
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}  # without an end tag they go on to the end of the page
SKIPPED = {"noscript", "template", "svg", "object", "video", "audio", "canvas", "select", "button", "annotation"}  # nothing inside them is text; without an end tag they hold nothing
FOREIGN = {"svg", "math"}  # a slash ends these at once
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
CELL = {"td", "th"}
# words by which elements name themselves; evidence for the tree, not a rule
ASIDE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "search", "fieldset", "head", "header"}
ASIDE_WORDS = {
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "ad", "ads", "advert", "advertisement", "banner", "cookie", "cookies", "consent", "notice", "promo", "sponsor", "sponsored", "comment", "comments",
    "reply", "replies", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "newsletter", "subscribe", "signup", "login", "popup", "modal", "widget", "copyright", "contentinfo", "complementary", "byline", "meta",
}
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}
# words that go with those above in names such as footer-links; any other word beside them makes a name of its own, as in notice-board
FILLERS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "form", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "middle", "outer", "page", "panel",
    "article", "articles", "post", "posts", "stories", "story", "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper",
}
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story"}
#: A heading over the comments of readers.
COMMENTS = re.compile(r"(?:\d+ |all |reader |readers' |user )*(?:comments?|replies)(?: \(\d+\)| so far)?[:.]?|leave a (?:comment|reply)[:.]?", re.I)
#: How a sentence ends.
STOPS = set(".!?:…。！？\"'”’»)")
#: A line that claims rights.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)|.{0,80}\ball rights reserved\b", re.I)

FEATURES = ["words", "words_before", "words_after", "links", "links_before", "links_after", "aside", "main", "rights", "stop"]


def _names(rest: str) -> tuple[int, bool]:
    """Whether the attributes of an element speak of a side part (2: of readers' comments), and of the main part."""
    aside, main = 0, False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                parts = {p.lower() for p in NAME_PART.findall(token) if len(p) > 1}
                if parts & ASIDE_WORDS:
                    if parts <= ASIDE_WORDS | FILLERS:
                        aside = max(aside, 2 if parts & COMMENT_WORDS else 1)
                elif parts & MAIN_WORDS:
                    main = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and INVISIBLE.search(value):
            aside = max(aside, 1)
    return aside, main


def ends_of(page: str, name: str) -> dict[int, int]:
    """Ends of the elements of a name, by the ends of their start tags; elements without an end tag are left out."""
    open_at: list[int] = []
    out = {}
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\\s/>])[^>]*>", re.I).finditer(page):
        if not m[1]:
            open_at.append(m.end())
        elif open_at:
            out[open_at.pop()] = m.end()
    return out


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of every non-empty flat block of a page, in order; time in proportion to the page."""
    found: list[tuple[str, int, int, int, bool]] = []  # text, words, linked words, innermost side part, in the main part
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, number of the side part it opens (or -1), main mark
    open_names: Counter[str] = Counter()
    block_at: list[int] = []  # places of the open block elements on the stack
    sides: list[int] = []  # open side parts, innermost last
    spans: list[list[int]] = []  # first block and end of each side part, and whether it holds comments
    ends: dict[str, dict[int, int]] = {}  # of skipped elements, by name
    main = 0

    def close(i: int) -> None:
        """Pop the elements from ``i`` on and take their marks back."""
        nonlocal main
        while len(stack) > i:
            n, side, b = stack.pop()
            open_names[n] -= 1
            main -= b
            if side >= 0:
                spans[sides.pop()][1] = len(found)
            if n in BLOCK:
                block_at.pop()

    def close_named(name: str) -> None:
        i = len(stack) - 1
        while stack[i][0] != name:
            i -= 1
        close(i)

    def flush() -> None:
        if text:
            s = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if s:
                n = s.count(" ") + 1
                k = len(html.unescape(" ".join(linked)).split())
                found.append((s, n, min(k, n), sides[-1] if sides else -1, main > 0))
            text.clear()
            linked.clear()

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            text.append(page[at:stop])
            if open_names["a"]:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name, rest = m["name"].lower(), m["rest"]
        if m["end"]:
            if name in RAW or name in SKIPPED or name in VOID:
                continue
            if name in BLOCK:
                heads = name in HEADINGS and len(found)
                flush()
            elif name in CELL:
                text.append(" ")
            if open_names[name]:  # an end tag without its element ends nothing
                close_named(name)
                if name in HEADINGS and heads is not False and len(found) == heads + 1 and stack and stack[-1][1] < 0 and COMMENTS.fullmatch(found[-1][0]):
                    # what follows in the element around the heading is a side part
                    stack[-1] = (stack[-1][0], len(spans), stack[-1][2])
                    sides.append(len(spans))
                    spans.append([len(found) - 1, 0, 1])
                    found[-1] = (*found[-1][:3], sides[-1], found[-1][4])
            continue
        if name in FOREIGN and rest.endswith("/"):
            text.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            text.append(" ")
            continue
        if name in SKIPPED:
            if name not in ends:
                ends[name] = ends_of(page, name)
            at = max(at, ends[name].get(at, at))
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name == "body" and open_names["head"]:
                close_named("head")
            # a block ends the open paragraph, also below inline elements
            elif block_at and stack[block_at[-1]][0] == "p" and (name == "p" or block_at[-1] == len(stack) - 1):
                close(block_at[-1])
        elif name == "br" or name in CELL:
            text.append(" ")
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        aside, central = _names(rest) if rest and name not in ("html", "body") else (0, False)
        central = central or name in MAIN_TAGS
        aside = aside or int(name in ASIDE_TAGS and not (name == "header" and main))
        side = -1
        if aside:
            side = len(spans)
            spans.append([len(found), 0, int(aside == 2)])
            sides.append(side)
        main += central
        open_names[name] += 1
        if name in BLOCK:
            block_at.append(len(stack))
        stack.append((name, side, int(central)))
    flush()
    close(0)
    until = [0]
    for x in found:
        until.append(until[-1] + x[1])

    def side_of(span: list[int]) -> float:
        part = (until[span[1]] - until[span[0]]) / until[-1]
        return 1.0 if span[2] else 1 - part

    out = []
    for i, (s, n, _, side, central) in enumerate(found):
        around = [found[j] if 0 <= j < len(found) else ("", 0, 0) for j in (i, i - 1, i + 1)]
        small = 0.0 if side < 0 else side_of(spans[side])
        out.append((s, [float(n), float(around[1][1]), float(around[2][1]), *(x[2] / x[1] if x[1] else 0.0 for x in around), small, float(central), float(not central and RIGHTS.match(s) is not None), float(s[-1] in STOPS)]))
    return out


# the small labelled table: snippets labelled by hand, a plus sign opens the blocks that belong to the article
ARTICLES = [
    "<h1>+The night the bridge held</h1><p>+The river had risen for three days before anyone in the valley began to worry about the old stone bridge.</p><p>+Nobody slept.</p><p>+Engineers measured the piers every hour and found that the foundations had moved by less than a finger. <a href='/x'>Read why</a></p>",
    "<h1>+Rain</h1><p>+Wind.</p><p>+It began on a Sunday.</p><p>+By noon the square was under water and the market women had carried their baskets up to the steps of the town hall, where they went on selling as if nothing had happened.</p><p>+The end.</p>",
    "<h2>+How to mend a kettle</h2><p>+You need little more than patience, some solder and a clean cloth.</p><ul><li>+Bring a torch.</li><li>+Wear gloves.</li><li>+Empty the kettle.</li></ul><p>+Heat the seam slowly and let the solder run by itself, for a hurried seam leaks within the month.</p><blockquote>+My grandmother mended hers four times and it outlived her.</blockquote>",
    "<p>+A reader wrote to us about the colour of the water, which had turned from green to a heavy brown.</p><p>+We asked <a href='/m'>the mill</a>, <a href='/t'>the tannery</a> and the <a href='/c'>council</a>, and all three said that somebody else would surely know more about it.</p><h3>+What we found</h3><p>+Nothing.</p><p>+The samples were clear by the time they reached the laboratory in the city, as samples tend to be.</p>",
    "<h1>+Council votes on the new school after a long debate that lasted well into the morning hours of Thursday</h1><p>+It was close.</p><p>+Seven members were in favour and six against, while the mayor, who had promised to abstain, left the room before the count and did not come back until the lights had been put out.</p><p>+<a href='/source'>The minutes</a></p><p>+Work begins in spring.</p>",
    "<h1>+Notes</h1><p>+One.</p><p>+Two words.</p><p>+Three short words.</p><p>+Then a paragraph that is a good deal longer than the ones before it and says what the notes are about.</p><p>+Last.</p>",
    "<p>+Plain prose opens this page without any heading at all, and it goes on for a while so that the reader knows where the text begins.</p><p>+It ends here.</p>",
    "<h1>+Table of the tides</h1><table><tr><td>+High water at the harbour mouth comes an hour later each day of the week.</td></tr><tr><td>+Low water follows six hours after that.</td></tr></table><p>+Boats should not leave on the ebb when the wind stands in the west.</p><pre>+mon 6 tue 7 wed 8</pre>",
    "<h1>+Sources of the river</h1><p>+Four springs feed it, and each has been claimed as the true one.</p><ul><li>+<a href='/a'>A map of the springs</a></li><li>+<a href='/b'>The survey of 1887</a></li><li>+<a href='/c'>Letters to the editor</a></li></ul><p>+See also <a href='/d'>the mill</a>.</p>",
    "<p>+Hello.</p><p>+Ok.</p>",
    "<h1>+On notices</h1><div class='notice-board'><p>+The board outside the town hall has carried the same three notices since the flood, and people still stop to read them.</p></div><div class='related-work'><p>+Others have written about the mill before, among them the schoolmaster, whose account differs from ours in almost every point.</p></div><p>+So be it.</p>",
]
_MENU = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "Sport", "Culture", "About us"))
_STORIES = "".join(f"<li><a href='/s{i}'>{t}</a></li>" for i, t in enumerate(("The mill that would not stop turning even in winter", "Ten walks", "A letter from the harbour master to his successor")))
# what stands before and after an article, by layout
LAYOUTS = [
    ("<nav><ul>" + _MENU + "</ul></nav><div class='ad'>Buy two lamps and pay for one this week only.</div><article>", "</article><footer>All rights reserved by the valley paper.</footer>"),
    ("<nav><ul>" + _MENU + "</ul></nav><div class='ad'>New soap.</div><article>", "</article><footer>&copy; valley.example &middot; Made by hand. Since the flood. With care.</footer>"),
    ("<header><h2>Valley Paper</h2><p>Independent since the flood.</p></header><main>", "</main><aside><h3>Most read</h3><ul>" + _STORIES + "</ul></aside><footer><p>We use cookies to make this site work better for you and for our partners in advertising.</p></footer>"),
    ("<div id='cookie-notice'><p>We use cookies to make this site work better for you and for our partners.</p><a href='#'>Accept</a></div><div class='content'>", "</div><div class='sidebar'><p>Our weather man looks back on forty years of storms, and forward to a few more, in tomorrow's issue.</p></div>"),
    ("<ul>" + _MENU + "</ul><div>", "</div><p><a href='/p'>Previous</a> <a href='/q'>Next</a></p><ul>" + _STORIES + "</ul>"),
    ("<p><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sport</a></p><div class='page with-sidebar'>", "</div><p><a href='/imprint'>Imprint</a> <a href='/privacy'>Privacy</a> <a href='/jobs'>Jobs</a></p>"),
    ("<div class='banner'>We value your privacy and would like you to accept everything at once.</div><div class='share'><a href='#'>Share</a> <a href='#'>Print</a></div>", "<form><p>Subscribe to our letter and get one story a week.</p><input></form><div class='related'><a href='/1'>The mill that would not stop turning</a></div>"),
    ("<article>", "<section class='comments'><h2>Comments</h2><p>I was there and it was louder than you say.</p><p>First!</p><p>My uncle built that, and he always said that they had used far too little lime for it to last a century.</p></section></article>"),
    ("<div class='post'>", "<div class='widget newsletter'><p>One story a week, free of charge, and never more than that.</p></div></div><div role='contentinfo'><p>Contact the editors at the old mill.</p></div>"),
    ("", ""),
    ("<body class='article-page no-ads'><div class='wrap search-results content'>", "</div></body>"),
    ("<div>Buy two lamps today</div><ul>" + _MENU + "</ul><ul>" + _STORIES + "</ul>", "<ul>" + _STORIES + "</ul><p><a href='/top'>Back to top</a></p>"),
    ("<form id='page'><div class='navbar'>" + _MENU + "</div><div class='story'>", "</div></form><div id='footer'>Terms of use. Printed on paper.</div>"),
    ("<div>Advertisement</div><div>Sign in</div><div>Thursday edition</div><div>", "</div><div>Terms of use</div><div>&copy; Valley Paper</div><div>Contact</div>"),
    ("<table><tr><td>Valley Paper</td><td>" + _MENU + "</td></tr></table><div>Advertisement</div><div>", "</div><div>More from the valley</div><ul>" + _STORIES + "</ul><div>Printed on paper</div>"),
    ("<p>Skip to the text</p><p>Log in</p><p>Search</p><div>", "</div><p>Share</p><p>Print</p><p>Save for later</p><p>Report a mistake</p>"),
    ("<ul>" + _MENU + "</ul><div>Advertisement</div>", "<div>Advertisement</div><ul>" + _MENU + "</ul><div>Made by hand</div>"),
    ("<div>", "</div><p>Copyright 2020 the valley paper and its many friends in town, printed by hand.</p>"),
    ("<ul>" + _MENU + "</ul><div>", "<div><h2>3 comments</h2><p>I was there and it was louder than you say.</p><p>My uncle built that, and he always said that they had used far too little lime for it to last a century.</p></div></div>"),
    ("<article>", "<div><h3>Comments (2)</h3><p>First!</p><p>What a fine piece, and what a pity that nobody asked the people on the other side of the water.</p></div></article><p>(c) Valley Paper. All rights reserved.</p>"),
    ("<div class='byline'>By Ann Miller, our own correspondent in the valley</div><main>", "<div class='ad-box'><p>A new car is waiting for you at the corner of Mill Street and the market, and it wants to be driven today.</p></div></main>"),
]


def labelled_pages() -> list[str]:
    """The pages of the labelled table: every article in every layout."""
    return [f"<html><head><title>Page</title></head>{a}{x}{b}</html>" for a, b in LAYOUTS for x in ARTICLES]


def labelled_rows(pages: list[str]) -> list[tuple]:
    """Features and ``label`` (1: keep) of the blocks of labelled pages."""
    return [(*x, float(text.startswith("+"))) for page in pages for text, x in blocks(page)]


def training_table(spark: SparkSession, pages: list[str] | None = None) -> DataFrame:
    """The labelled blocks as a table of features and ``label``."""
    return spark.createDataFrame(labelled_rows(labelled_pages() if pages is None else pages), ", ".join(f"{c} double" for c in [*FEATURES, "label"]))


def fit_tree(table: DataFrame, depth: int = 9) -> tuple:
    """Fit the tree and return it as nested (feature, threshold, left, right) or a class."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(table).coalesce(1)
    model = DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, maxBins=128, seed=10).fit(ready)

    def plain(node) -> tuple | bool:
        if node.subtreeDepth() == 0:
            return node.prediction() == 1.0
        return node.split().featureIndex(), node.split().threshold(), plain(node.leftChild()), plain(node.rightChild())

    return plain(model._call_java("rootNode"))


def classify(tree: tuple | bool, x: list[float]) -> bool:
    """Walk the tree."""
    while not isinstance(tree, bool):
        f, at, left, right = tree
        tree = left if x[f] <= at else right
    return tree


def extract(pages: DataFrame, tree: tuple | bool, html_column: str = "html") -> DataFrame:
    """Add ``text``, the article's blocks joined by two line ends, to every row.

    Null pages count as empty; a page without article blocks gets an empty
    text.  A column ``text`` of ``pages`` is replaced; repeated rows are kept.
    """

    @F.pandas_udf(T.StringType())
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(["\n\n".join(t for t, x in blocks(p or "") if classify(tree, x)) for p in s], dtype=object)

    keep = [c for c in pages.columns if c != "text"]
    return pages.select(*keep, main_text(F.coalesce(F.col(html_column), F.lit(""))).alias("text"))


def text_blocks(pages: DataFrame, tree: tuple | bool, key: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per block: ``(key, block, text, <features>, keep)``, for inspection."""
    fields = [pages.schema[key], *T.StructType.fromDDL("block long, text string").fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES), T.StructField("keep", T.BooleanType())]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(k, i, t, *x, classify(tree, x)) for k, p in zip(df[key], df["_h"], strict=True) for i, (t, x) in enumerate(blocks(p))]
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    return pages.select(key, F.coalesce(F.col(html_column), F.lit("")).alias("_h")).mapInPandas(work, T.StructType(fields))
