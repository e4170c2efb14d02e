"""Main text of pages that differ from the shared template."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tallyforge.llm.html_text import FEATURES, decide, extract, grow, labelled_rows, main_text

ROWS = labelled_rows()
TREE = grow(ROWS)
LONG = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p>{LONG}</p><section id="related-work"><p>Earlier studies of it.</p></section></article>', f"{LONG}\nEarlier studies of it."),
        (f'<article><p class="share-price">It fell.</p><h2 id="comments-on-method">On method</h2><h3 id="social-theory">Theory</h3><p>{LONG}</p></article>', f"It fell.\nOn method\nTheory\n{LONG}"),
        (f"<body><div><h2>Intro</h2><p>{LONG}</p></div></body>", f"Intro\n{LONG}"),
        (f'<article><p>{LONG}</p><section class="replies"><p>{LONG} I disagree</p></section></article>', LONG),
        (f"<article><p>{LONG} <math><mi>x</mi></math></p></article>", f"{LONG} x"),
        (f'<article><p>{LONG}</p><div class="related-posts"><p>More of this</p></div><div id="comments"><p>nice</p></div></article>', LONG),
        (f'<body><div class="site-footer"><p>{LONG}</p></div><main><p>Kept</p></main></body>', "Kept"),
        (f'<body><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul><p>{LONG}</p><p>{LONG}</p><p>© 2020 all rights reserved</p></body>', f"{LONG}\n{LONG}"),
        (f'<article><p title="a > b">{LONG}</p><p class=it\'s>don\'t stop</p></article>', f"{LONG}\ndon't stop"),
        (f"<article><p>1 < 2 and a &lt; b</p><p>{LONG}</p></article>", f"1 < 2 and a < b\n{LONG}"),
    ],
)
def test_main_text(page, want):
    assert main_text(page, TREE) == want


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='>", "<", "</", "<!", "<p><!-- ", "<a b=\"x' "])
def test_long_broken_pages_take_linear_time(piece):
    main_text(piece * 100, TREE)
    began = time.time()
    main_text(piece * (1_000_000 // len(piece)), TREE)
    main_text(piece * (500_000 // len(piece)) + ">", TREE)
    assert time.time() - began < 6


OTHER = " ".join(["other"] * 40)
#: Parts that do not belong to an article, inside or beside it.
STRANGE = (
    '<div class="comment-body"><p>{}</p></div>', '<div class="reader-feedback"><p>{}</p></div>', '<section class="discussion"><p>{}</p></section>', '<article class="comment"><p>{}</p></article>',
    '<p class="advert">{}</p>', '<div class="talk"><p>{}</p></div>', '<div role="complementary">{}</div>', "<aside>{}</aside>", '<ul class="related-posts"><li>{}</li></ul>', '<p class="ad">{}<p class="ad">{}',
)


@pytest.mark.parametrize("part", STRANGE)
def test_parts_that_are_not_the_article(part):
    part = part.replace("{}", OTHER)
    assert main_text(f"<body><article><p>{LONG}</p>{part}</article></body>", TREE) == LONG
    assert main_text(f"<body>{part}<article><p>{LONG}</p></article></body>", TREE) == LONG
    assert main_text(f"<body><article><p>{LONG}</p></article>{part}</body>", TREE) == LONG


@pytest.mark.parametrize("part", ['<div class="banner"><p>{}</p></div>', '<section class="search"><p>{}</p></section>', '<details class="notice"><p>{}</p></details>', '<section id="discussion"><p>{}</p></section>', '<h2 id="comments">{}</h2>'])
def test_prose_of_an_article_outweighs_a_hint(part):
    assert main_text(f"<article><p>{LONG}</p>{part.format(OTHER)}</article>", TREE) == f"{LONG}\n{OTHER}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a href='/'>Home</a><article><p>{LONG}</p></article>", LONG),
        (f"<form><header>Shop</header><article><h1>Title</h1><p>{LONG}</p></article></form>", f"Title\n{LONG}"),
        ("<body><p>One short line.</p></body>", "One short line."),
        ("<body><nav><a href='/'>Home</a></nav><p>One short line.</p><footer>us</footer></body>", "One short line."),
        (f"<body><p>{LONG}</p><p>{LONG} <a>five words of a link</a></p><p>{LONG}</p></body>", f"{LONG}\n{LONG} five words of a link\n{LONG}"),
        (f"<article></article><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>", f"Title\n{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><p>See <a>this one</a></p><ul><li><a>a link</a></li></ul><p>End</p></article>", f"{LONG}\nSee this one\na link\nEnd"),
        (f"<body><p><a>{OTHER}</a></p><p>{LONG}</p><p><a>{OTHER}</a></p></body>", LONG),
        (f'<article><div class="notice">Updated twice since then</div><p>{LONG}</p><div class="share-buttons">Tell your friends</div></article>', LONG),
        ("", ""),
    ],
)
def test_pages_of_other_shapes(page, want):
    assert main_text(page, TREE) == want


def test_long_unmatched_tags_take_linear_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "</p>" * 50_000, "<nav><article>" * 40_000, "<p>x" * 100_000):
        main_text(page, TREE)
    assert time.time() - began < 6


def test_neighbours_decide_where_no_element_does():
    used = set()

    def walk(tree):
        if isinstance(tree, tuple):
            used.add(FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(TREE)
    assert {"words", "links"} <= used and used & {"words_before", "links_before", "words_after", "links_after"}
    assert all(decide(TREE, row[:-1]) == row[-1] for row in ROWS)


class Plain(HTMLParser):
    """The text of article elements, cut at every tag that is none of the inline ones of these pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, [""]

    def _cut(self, tag):
        if tag == "br":
            self.parts[-1] += " "
        elif tag not in ("a", "b", "i", "em", "strong", "span"):
            self.parts.append("")

    def handle_starttag(self, tag, attrs):
        self._cut(tag)
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        self._cut(tag)
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(p.split()) for p in self.parts) if t)


def test_a_plain_reader_finds_the_same_text_of_all_pages(spark):
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    want = {}
    for row in table:
        plain = Plain()
        plain.feed(row["html"] or "")
        plain.close()
        want[row["page_id"]] = plain.text()
    got = {r["page_id"]: r["text"] for r in extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert got == want and any(want.values())
