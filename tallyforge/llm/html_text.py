"""Main text of web pages: flat text blocks classified by a decision tree (operator 9).

A page is cut at block-level tags into flat blocks. A block is described by its word count and link density, those of
the blocks before and after it, its size beside the page's largest block, and what it stands in: an article or main
element, and a part of the page that frames it. Such parts are told by their element (navigation, header, footer,
sidebar, form) or by the words of a class, id or role: sure ones (adverts, comments, related links) on any element, mere
hints (banner, notice, search, sharing) that the tree may overrule where long prose stands in an article. The tree is
grown from the small table of labelled pages below; the main blocks are joined in page order.

Defined cases: null html counts as empty; a page without main blocks gives the empty text; broken markup is read as far
as it goes (an unclosed comment or script hides the rest; an article ends a navigation, header, footer or form that is
still open); repeated rows get a row each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import small_batches

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)")
#: What ends a tag, or opens a quoted value that must be passed first.
STOP = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")

#: Element kinds of HTML.
HIDDEN = frozenset("script style noscript template svg iframe object canvas audio video select textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot semantics".split())
FRAME = frozenset("nav footer aside form menu dialog button head".split())
MAIN = frozenset("article main".split())
#: Frames that an article or main element ends: around a whole page, or left open before it.
ENDED_BY_MAIN = frozenset("nav footer header form menu dialog button head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Roles of parts that frame a page.
FRAME_ROLES = frozenset("navigation banner search complementary contentinfo dialog alertdialog form menu menubar toolbar".split())
#: Words of a class or id that mark framing parts, on any element. A name marks one if all its words are of these lists
#: or neutral, so that "related-posts" does and "related-work" does not.
SURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising advertorial breadcrumb breadcrumbs comment commenter commenters commenting commentary comments commentlist consent cookie cookies disqus footer"
    " masthead nav navbar navigation newsletter pager pagination popup promo promos promoted promotion recommended related replies reply respond responses sidebar signup sponsor sponsored sponsors"
    " subscribe toolbar ugc widget widgets".split()
)
#: Words that mark comments as a class; as an id they name a chapter as often, and are a hint.
SURE_CLASS_WORDS = frozenset("discussion discussions discuss feedback talk".split())
#: Words that hint at framing parts.
HINT_WORDS = frozenset("alert banner disclaimer menu modal notice notices notification search share sharing social".split())
NEUTRAL_WORDS = frozenset(
    "area aria articles author bar block body bottom box btn button buttons card container content fixed form forum global group header holder icons inner item items left link links list main"
    " message meta module outer overlay page pages panel policy post posts primary reader readers region right row secondary section sections site slot stories text thread threads top unit user users"
    " wrap wrapper".split()
)
MAIN_WORDS = frozenset(("articlebody", "article-body", "post-content", "entry-content", "article-content", "post-body", "main-content", "maincontent"))

FEATURES = ("place", "words", "links", "words_before", "links_before", "words_after", "links_after", "share")
#: Of a page's free words (outside of marked parts), the part that its article and main elements must hold to be its main text.
MAIN_SHARE = 0.125
#: Labelled pages: a block begins with + if it is main text, with - if not; @n stands for n words, ~n for n linked words.
#: First pages with an article or main element, then those where such an element holds little or nothing, then others.
LABELLED = (
    "<nav><li>-~1</li><li>-~1</li><li>-~2</li></nav><article><h1>+@8</h1><p>+@60</p><p>+@5</p><p>+@90 ~4</p></article><footer>-@9</footer>",
    "<header><p>-@4</p><li>-~1</li></header><main><h1>+@2</h1><p>+@1</p><li>+~3</li><li>+~4</li><p>+@30 ~25</p><h2>+@3</h2><p>+@200</p></main><aside><h3>-@2</h3><p>-@80</p></aside><footer><p>-@40 ~4</p></footer>",
    "<div class='ad'>-@12</div><article><h1>+@6</h1><p>+@25 ~2</p><div class='ad'><p>-@45</p></div><p>+@55</p><p class='advert'>-@8</p><li>+~1</li><li>+~2</li></article><div id='comments'><p>-@120</p><p>-@3</p></div>",
    "<p>-@20</p><article><p>+@40</p><div class='comment-body'><p>-@60</p><p>-@150 ~2</p></div></article><p>-@35</p><p>-@70</p><p>-@9 ~2</p>",
    "<div><li>-~1</li><li>-~1</li></div><div><p>-@5</p></div><main><h1>+@7</h1><p>+@300</p><aside>-@25</aside><form>-@4</form></main><div><h3>-@2</h3><p>-@100</p><p>-@45</p><li>-~6</li></div>",
    "<article><p>+@35</p><div class='banner'><p>+@40</p></div><p>+@10</p><section class='search'><p>+@55</p></section><p>+@80</p><div class='share'>-@2</div><div class='share'><li>-~1</li><li>-~1</li></div></article>",
    "<article><h1>+@5</h1><div class='notice'>-@9</div><p>+@70</p><div class='social'>-@4 ~3</div><p>+@28</p><details class='notice'><p>+@90</p><p>+@38 ~1</p></details><div class='search'>-@3</div></article>",
    "<div class='banner'><p>-@30</p></div><main><p>+@50</p><div class='menu'><li>-~2</li><li>-~3</li></div><p>+@3</p><div class='notice'><p>-@12</p></div></main><div class='disclaimer'><p>-@60</p></div>",
    "<article><p>+@30</p><div class='notice'><p>-@18</p></div><p>+@24</p><div class='share'>-@12</div><div class='banner'>-@20</div><p>+@28</p><div class='search'>-@6</div></article>",
    "<article><div class='notice'>-@22</div><h1>+@4</h1><p>+@48</p><div class='banner'>-@14</div><p>+@40</p><div class='disclaimer'>-@24</div></article>",
    "<article><p>+@6</p></article><footer>-@30</footer>",
    "<article><h1>+@2</h1><p>+@300</p><p>+@5</p><p>+@1</p><li>+~2</li><p>+@3 ~1</p><p>+@2</p></article>",
    "<nav>-~4</nav><article><p>+@400</p><p>+@3</p><p>+@20</p><p>+@2</p><p>+@9</p></article><footer>-@2</footer>",
    "<article><h2>+@1</h2><p>+@90</p><p>+@6</p></article><footer>-@14</footer>",
    "<article><h1>+@3</h1><p>+@500</p><h2>+@2</h2><p>+@6</p><p>+@8 ~2</p><p>+@30</p><p>+@4</p></article><footer>-@1 ~2</footer>",
    "<main><p>+@7</p><p>+@2</p><p>+@900</p><p>+@1</p><p>+@3</p><p>+@1</p><p>+@5 ~3</p><p>+@25</p><p>+@8</p></main><nav>-~9</nav>",
    "<nav>-~4</nav><main><h1>+@4</h1></main><footer>-@3</footer>",
    "<article><h2>-@3</h2></article><h1>+@6</h1><p>+@120</p><p>+@80</p><p>+@60 ~2</p><p>-@4</p>",
    "<article></article><li>-~1</li><li>-~2</li><h1>+@5</h1><p>+@40</p><p>+@30</p><p>+@7</p><p>+@55</p><li>-~5</li><li>-~4</li>",
    "<li>-~1</li><li>-~3</li><li>-~1</li><h1>+@4</h1><p>+@60</p><p>+@90 ~9</p><h2>+@2</h2><p>+@45</p><p>+@18</p><p>+@25</p><p>+@12</p><p>+@50</p><p>-@6</p><li>-~2</li><li>-~2</li>",
    "<h1>+@7</h1><p>+@33</p><p>+@3</p><p>+@70</p><div class='banner'><p>-@25</p></div><p>+@40</p><div class='notice'>-@40</div><p>-@6</p><li>-~1</li>",
    "<p>+@38</p>",
    "<p>+@5</p>",
    "<nav>-~3</nav><p>+@9</p><footer>-@6</footer>",
    "<h1>+@3</h1><p>+@7</p>",
    "<li>-~1</li><li>-~1</li><h2>+@2</h2><p>+@40</p>",
    "<div class='sidebar'><p>-@90</p></div><p>+@26</p><div class='related'><li>-~8</li></div>",
    "<li>-~3</li><li>-~1</li><li>-~4</li><p>-@5 ~4</p><li>-~2</li><p>-@9 ~40</p><p>-~55</p><p>-@20 ~30</p><p>-@3 ~28</p>",
    "<p>-~35</p><h1>+@5</h1><p>+@60 ~12</p><p>+@90 ~25</p><p>-@12 ~60</p><p>-@2 ~30</p>",
    "<p>+@300 ~9</p><p>-@8 ~1</p><p>-@2</p>",
    "<p>-@1 ~3</p><p>+@120 ~25</p><h3>+@4</h3><p>+@31 ~3</p><p>-@4</p><li>-~9</li><p>-@9 ~4</p>",
    "<div class='comments'><p>-@50</p><p>-@9</p></div><h1>+@9</h1><p>+@45</p><p>+@48</p><p>+@14</p><p>+@28</p><div class='comments'><p>-@70</p><p>-@30</p></div>",
    "<h1>+@5</h1><p>+@60</p><p>+@45 ~8</p><p>+@38 ~10</p><p>+@70</p><p>+@20</p>",
    "<p>+@40</p><p>+@40</p><p>-@5</p>",
    "<li>-~2</li><h1>+@6</h1><p>+@30</p><p>+@55 ~14</p><p>+@52</p><p>-@7</p>",
    "<h2>+@4</h2><p>+@44</p><p>+@24 ~5</p><p>+@36</p><p>+@3</p><p>+@41</p><p>-@9</p>",
    "<p>-@3</p><li>-~1</li><li>-~1</li><h1>+@4</h1><p>+@35</p><p>+@28</p><p>-@8</p><li>-~2</li>",
    "<p>-@4</p><li>-~1</li><p>+@80</p><p>+@90</p><p>+@9</p><p>+@6</p><p>+@120 ~20</p><p>-@3 ~3</p><p>-@6</p>",
    "<h1>+@6</h1><p>+@65 ~12</p><p>+@2</p><p>+@2</p><p>+@1</p><p>+@200</p><p>+@13</p><p>+@150</p><p>-@4 ~8</p><p>-@4</p>",
    "<li>-~1</li><h1>+@1</h1><p>+@150</p><h2>+@1</h2><p>+@130</p><p>+@33 ~6</p><li>-~12</li><li>-~14</li><p>-@12 ~9</p>",
    "<li>-~4</li><p>-@6 ~3</p><p>-@5 ~2</p><p>+@29</p><p>+@17 ~1</p><p>+@33 ~9</p><p>-@15 ~11</p>",
)


def labelled_rows() -> list[tuple]:
    """The features of the blocks of the labelled pages, each followed by 1 for main text and 0 for the rest."""
    rows = []
    for page in LABELLED:
        page = re.sub(r"@(\d+)", lambda m: " word" * int(m[1]), page)
        page = re.sub(r"~(\d+)", lambda m: " <a>" + "word " * int(m[1]) + "</a>", page)
        found = blocks(page)
        for b in found:
            b.words -= 1  # the label
        rows += [(*row, int(b.text.startswith("+"))) for b, row in zip(found, features(found), strict=True)]
    return rows


def grow(rows: list[tuple], depth: int = 12) -> tuple | int:
    """A decision tree by least Gini impurity: (feature, threshold, tree if at most it, tree if above) or a class.

    A split that sets apart a quarter of the rows or more, all of one class, goes before those that do not.
    """
    ones = sum(r[-1] for r in rows)
    best_class = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return best_class

    def impurity(part: list[tuple]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            below, above = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            pure = any(4 * len(part) >= len(rows) and len({r[-1] for r in part}) == 1 for part in (below, above))
            cost = impurity(below) + impurity(above) - len(rows) * pure
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, cut, below, above)
    if best is None or best[0] >= impurity(rows) - 1e-12:
        return best_class
    _, k, cut, below, above = best
    return (k, cut, grow(below, depth - 1), grow(above, depth - 1))


def decide(tree: tuple | int, row: tuple) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_main: bool
    mark: int  # 2 in a part that surely frames the page, 1 in one that may, else 0

    @property
    def links(self) -> float:
        return min(1.0, self.linked / self.words) if self.words else 0.0


def _close_of(page: str, name: str, at: int) -> tuple[int, int]:
    """Where the end tag of a hidden element starts and ends; the page's end if there is none."""
    m = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
    return (m.start(), m.end()) if m else (len(page), len(page))


class Tags:
    """Ends of a page's tags. What a search to the page's end did not find is not looked for again, so a page is read in linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.missing = page, page.rfind(">"), set()

    def end(self, start: int) -> int:
        """Where the tag that begins at start ends (its >); quoted values may hold one. -1 if nothing ends it."""
        if start > self.last:
            return -1
        at = start
        while m := STOP.search(self.page, at):
            quote = m[1]
            if not quote:
                return m.start()
            close = -1 if quote in self.missing else self.page.find(quote, m.end())
            if close < 0:
                self.missing.add(quote)
                break
            at = close + 1
        return self.page.find(">", start)  # a tag with unbalanced quotes


def mark_of(name: str, key: str, value: str) -> int:
    """How surely one word group of an attribute marks a part that frames the page: 2 surely, 1 perhaps, 0 not."""
    if key == "role":
        return 2 * (value.lower() in FRAME_ROLES)
    words = PART.findall(value.lower())
    own = [w for w in words if not w.isdigit() and w not in NEUTRAL_WORDS]
    if not own or (key == "id" and name in HEADINGS):  # ids of headings repeat their text
        return 0
    if not all(w in SURE_WORDS or w in SURE_CLASS_WORDS or w in HINT_WORDS for w in own):
        return 0
    return 2 if any(w in SURE_WORDS or (key == "class" and w in SURE_CLASS_WORDS) for w in own) else 1


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open block elements: name, whether it makes main, its mark
    opened: Counter[str] = Counter()  # their names
    loose: list[int] = []  # places in the stack of frames that an article would end
    runs: list[tuple[str, bool]] = []
    main = link = at = 0
    marked = [0, 0, 0]  # open elements of each mark
    tags = Tags(page)

    def leave(depth: int) -> None:
        nonlocal main
        for closed, makes_main, mark in stack[depth:]:
            main -= makes_main
            marked[mark] -= 1
            opened[closed] -= 1
        del stack[depth:]
        while loose and loose[-1] >= depth:
            loose.pop()

    def flush() -> None:
        if not runs:
            return
        words = html.unescape("".join(t for t, _ in runs)).split()
        if words:
            linked = len(html.unescape(" ".join(t for t, inside in runs if inside)).split())
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), main > 0, 2 if marked[2] else int(marked[1] > 0)))
        runs.clear()

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            runs.append((page[at:start], link > 0))
        if start == len(page):
            break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        m = NAME.match(page, start)
        odd = page[start + 1 : start + 2] in ("!", "?", "/")
        stop = tags.end(start) if m or odd else -1
        if stop < 0:
            runs.append(("<", link > 0))
            at = start + 1
            continue
        at = stop + 1
        if not m:
            continue
        ends, name, attributes = bool(m[1]), m[2].lower(), page[m.end() : stop]
        if name in HIDDEN:
            if not ends and not attributes.endswith("/"):
                at = _close_of(page, name, at)[1]
            runs.append((" ", False)) if name in INLINE else None
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if ends else 1
            elif name in ("br", "img", "wbr"):
                runs.append((" " if name != "wbr" else "", link > 0))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        link = 0
        if ends:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                leave(depth)
            continue
        if stack and stack[-1][0] == "p":  # a block ends an open paragraph
            leave(len(stack) - 1)
        marks = [(k.lower(), v) for k, *values in ATTRIBUTE.findall(attributes) for v in "".join(values).split()] if attributes else []
        mark = max((mark_of(name, k, v) for k, v in marks), default=0)
        makes_main = mark < 2 and (name in MAIN or any(v.lower() in MAIN_WORDS for _, v in marks) or ("role", "main") in marks)
        if name in FRAME or (name == "header" and not main):
            mark = 2
        if attributes.endswith("/"):
            continue
        if makes_main and not main:
            for k in loose:
                marked[2] -= 1
                marked[0] += 1
                stack[k] = (stack[k][0], stack[k][1], 0)
            loose.clear()
        if mark == 2 and name in ENDED_BY_MAIN:
            loose.append(len(stack))
        stack.append((name, makes_main, mark))
        opened[name] += 1
        main += makes_main
        marked[mark] += 1
    flush()
    return out


def features(found: list[Block]) -> list[tuple]:
    """The features of a page's blocks: their own, their neighbours', and what they are beside the rest of the page."""
    free = [b for b in found if not b.mark]
    total, inside = sum(b.words for b in free), sum(b.words for b in free if b.in_main)
    largest = max((b.words - b.linked for b in free), default=0)
    has_main = total > 0 and inside >= MAIN_SHARE * total

    def place(b: Block) -> int:
        """From surely framing (0) over beside the main element, hinted, free, and hinted in it, to free in it (5)."""
        if b.mark == 2:
            return 0
        if has_main:
            return 5 - b.mark if b.in_main else 1
        return 3 - b.mark

    rows = []
    for i, b in enumerate(found):
        before, after = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        around = [v for x in (before, after) for v in ((x.words, x.links) if x else (0, 0.0))]
        rows.append((place(b), b.words, b.links, *around, min(1.0, b.words / largest) if largest > 0 else 0.0))
    return rows


def main_text(page: str | None, tree: tuple | int) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    tree = grow(labelled_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
