"""Main-text extraction: flat text blocks, features of a block and its neighbours, a decision tree.

A page is cut into blocks: the text between block-level tags, as it stands in the page. A block's features are its word
count and link density, those of the blocks before and after it, and what its enclosing elements say of themselves
(navigation, footers, asides, forms, names like "ad" or "comments"; articles, and whether it stands beside one;
headings). A decision tree, grown by Gini impurity on the blocks of a small labelled table of pages (``LABELLED``), says
which blocks belong to the article; ties go to the first feature and the smallest threshold. Where elements say nothing of
themselves it decides by the words and links of a block and of its neighbours.

Scripts, styles, comments, controls (``SKIPPED``) and other markup never reach a block; formulas and fallback texts
(of objects, canvases, audio, video and noscript) do. Character references are decoded, white space inside a
block becomes one space, blocks are joined by a blank line.

Defined results: null, empty and textless html gives '' and 0; unclosed elements and comments end with the page (of ``SKIPPED`` only those with an end tag are left out); end tags
without a start are passed over; repeated rows give the same text; pages of any length are read whole; an empty table
gives an empty result. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|$)""", re.S)
HINTS = re.compile(r"""\b(?:class|id|role|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD_BREAK = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Elements of raw text, which without an end tag take the rest of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose contents are controls, graphics or not shown; without an end tag their contents are read like others.
SKIPPED = frozenset("template svg select option button annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role values.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side rail aside footer foot masthead header topbar comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget popup modal overlay pagination pager "
    "tags toolbar copyright legal skip complementary contentinfo dialog".split()
)
#: Openings of such words.
BOILER_STEMS = ("advert", "adsby", "adslot", "adbanner", "sponsor", "promo", "banner", "cookie", "consent", "navbar", "navig", "breadcrumb", "sidebar", "footer", "masthead", "comment", "disqus", "newsletter", "subscri", "recommend", "pagination", "popup", "copyright", "disclaimer")
MAIN_WORDS = frozenset("article content post entry story main articlebody text".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "main", "heading", "in_list", "beside_main")

#: Labelled blocks: pages in which the article's blocks carry the attribute data-keep.
LABELLED = (
    '<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav><div class="ad">Buy our shoes at half the price today.</div>'
    "<article><h1 data-keep>Rain falls on the old town</h1><p data-keep>Heavy rain fell on the old town this morning, and the market closed early for once.</p>"
    "<p data-keep>It rained.</p><p data-keep>Traders packed their stalls before noon and went home, where they waited for the sun to come back.</p></article>"
    "<footer>&copy; 2020 Example Press. All rights reserved.</footer></body>",
    '<body><header><a href=/>Example</a> <a href=/about>About us</a></header><main><h1 data-keep>A short note</h1><p data-keep>Yes.</p><p data-keep>The committee met on Tuesday and agreed on '
    'the plan that had been put forward in spring.</p><h2 data-keep>What comes next</h2><ul><li data-keep>A first draft in May</li><li data-keep>A vote in June</li></ul></main>'
    '<aside><h3>Most read</h3><ul><li><a href=/1>Ten things to see in the town</a></li><li><a href=/2>Why the bridge is closed</a></li></ul></aside><footer><p>Contact the editors by mail or by phone on weekdays.</p></footer></body>',
    '<body><div id="cookie-notice">We use cookies to make this site better. By going on you agree to that.</div><div class="menu"><a href=/a>Start</a><a href=/b>Contact</a></div>'
    '<div class="content"><h1 data-keep>On bread</h1><p data-keep>Good bread needs time more than it needs skill, as every baker will tell you if you ask in the morning.</p>'
    '<p data-keep>Flour, <a href=/w>water</a>, salt.</p></div><div id="comments"><h3>2 comments</h3><p>I tried this recipe at home and the bread came out flat, what did I do wrong here?</p>'
    "<p>Use more water and let it stand over night, then it will rise.</p></div></body>",
    '<body><div><a href=/>Home</a> | <a href=/x>Archive</a> | <a href=/y>Links</a></div><h1 data-keep>The river in winter</h1><p data-keep>The river froze from bank to bank that winter, and for three '
    'weeks children walked to school across it instead of over the bridge.</p><p data-keep>Nobody fell in, though the mayor had warned them again and again about the thin places near the mill.</p>'
    '<p><a href=/p>Previous post</a> <a href=/q>Next post</a></p><form><label>Your name</label><p>Leave your address and we write to you once a week.</p></form></body>',
    '<body><article><header><h1 data-keep>Letters from the coast</h1></header><p data-keep>The letters came in a tin box that had been under the stairs for longer than anyone in the house could say.</p>'
    '<blockquote data-keep>Dear Anna, the sea is grey today.</blockquote><p data-keep>There were forty.</p><div class="share">Share this with your friends</div><section class="comments"><p>What a lovely story, thank '
    'you for putting these letters where all of us can read them.</p></section></article><div class="sidebar"><p>Our book of the month is about the lighthouse keepers of the north.</p></div></body>',
    '<body><div class="banner">Sale ends on Sunday</div><div class="post"><p data-keep>Sold out.</p><p data-keep>All tickets for the concert were gone within an hour of the opening of the office on Monday.</p><p data-keep>More '
    'will follow.</p></div><div class="related"><p>Also in this series: how the hall was built and who paid for the great organ in it.</p></div><div class="newsletter"><p>Get our letter every week.</p></div></body>',
    '<body><main><table><tr><td data-keep>Length</td><td data-keep>Twelve metres over all</td></tr><tr><td data-keep>Built</td><td data-keep>In the yard at the north end of the harbour</td></tr></table><p data-keep>See <a href=/k>keel</a>'
    ' and <a href=/m>mast</a>.</p></main><div role="contentinfo"><p>Text under a free licence; further terms may apply to pictures.</p></div></body>',
    "<body><p><a href=/1>One</a></p><p><a href=/2>Two</a></p><p><a href=/3>Three</a></p></body>",
    "<body><article><p data-keep>One line is all that was ever written down about it.</p></article></body>",
    "<body><p data-keep>Closed until spring.</p></body>",
    "<body><div>The Valley Courier, founded when the railway came to the valley</div><article><h1 data-keep>Mill for sale</h1><p data-keep>The old mill has been for sale since the spring and nobody has asked for its price.</p><p data-keep>It "
    "stands empty.</p></article><p>The Courier is printed on paper from the valley and is sold at the station, at the baker's and in both inns.</p></body>",
    "<body><p>Today: sun</p><main><h2 data-keep>Two goals</h2><p data-keep>The first came early.</p><p data-keep>Nobody saw the second, since by then the fog lay on the field and even the players had lost each other.</p></main><div><p>All "
    "times are those of the station clock.</p></div></body>",
    '<body><article><p data-keep>Fog.</p></article><div class="ad">Fly to the islands in the sun for less than you think, book your seat before the end of the month and save.</div><footer><p>Published every day but '
    "Sunday by the society of friends of the old town, printed on our own press in the yard behind the church.</p></footer></body>",
    '<body><div class="nav"><a href=/1>Home</a> <a href=/2>Forum</a></div><h2 data-keep>How we mended the roof</h2><p data-keep>It leaked.</p><p data-keep>We took the old tiles off one by one, numbered them with chalk and laid '
    'them out on the grass so that each could go back to its own place when the laths were done.</p><p data-keep>Rain came.</p><p data-keep>On the fourth day we had half of the south side covered, and on the sixth the chimney was dry for '
    'the first time in years.</p><p data-keep>Then we slept.</p><div class="comment"><p>Which chalk did you use, and did it not wash off when the rain that you write about came down on the grass?</p></div><div id="footer"><p>Written by the house, for '
    "the house; copy what you like as long as you say where you have it from and do not sell it to others.</p></div></body>",
    '<body><div class="ad">Win a trip.</div><h1 data-keep>Snow</h1><p data-keep>Snow lay on the fields for nine weeks, longer than in any winter that the oldest man in the village could call to mind.</p><p data-keep>Then it was gone.</p>'
    '<div class="promo"><p>Boots and coats for the whole family, made by hand in the valley and sent to your door within three days of your order.</p></div><p data-keep>What it left behind was mud, and in the mud the roads that the carts had cut.</p>'
    '<div class="newsletter"><p>Write your address here and you will hear from us on the first of each month.</p></div><div class="sidebar"><p>Our almanac has the weather of each day of the past year, with the names of those who noted it down.</p></div></body>',
    '<body><p data-keep>Minutes of the meeting of the third of May, kept by the clerk in the absence of the chair.</p><p data-keep>Present: nine.</p><p data-keep>The clerk read the letter from the county and the council took note of it without a vote.</p>'
    '<p data-keep>The bridge was spoken of.</p><p data-keep>The meeting closed at ten.</p><div class="cookie"><p>This page keeps two small files on your machine, one for the language that you choose and one that says you have read this.</p></div><form><p>Tell us what you '
    "think of this page, in as many words as you need, and leave a number where we can reach you.</p></form></body>",
    # pages that say nothing of themselves: only words, links and neighbours tell
    "<body><div>Harbour Gazette</div><div><a href=/>Home</a> <a href=/s>Sport</a> <a href=/l>Letters</a></div><div data-keep>The ferry was late again on Friday, and those who had come to meet it sat on the quay wall and ate what they had brought for "
    "the way home.</div><div data-keep>Nobody minded.</div><div data-keep>When it came at last the captain stood at the rail and called out the names of all who had letters, one after the other, until the bag was empty.</div><div><a href=/o>Older</a> "
    "<a href=/n>Newer</a></div><div>Printed in the yard.</div></body>",
    "<body><table><tr><td><a href=/1>Start</a></td><td><a href=/2>Prices</a></td><td><a href=/3>Way here</a></td></tr></table><div data-keep>We bake twice a week, on Tuesdays and on Fridays, and what is left on the evening of the second day goes to the "
    "hens behind the mill.</div><div data-keep>Rye keeps longest.</div><div data-keep>Wheat loaves are for those who eat them on the same day, with butter or, as the miller does, with nothing but a little salt on the crust.</div><table><tr><td>Telephone</td>"
    "<td><a href=/m>Map</a></td></tr><tr><td>Open till six</td><td><a href=/h>Hours</a></td></tr></table></body>",
    "<body><div><a href=/a>All walks</a></div><div data-keep>The path starts behind the church and climbs through the beeches to a bench, from which in clear weather the lake and the two islands in it can be seen.</div><div data-keep>Take water along, and "
    "read the <a href=/w>notes on weather in spring</a> first.</div><div data-keep>From the bench it is an hour to the pass; the last part is steep, and after rain the stones are slippery enough to make one wish for a stick.</div><div>Also near: <a href=/b>Mill "
    "round</a> <a href=/c>Lake shore</a></div><div>Signs by the club</div></body>",
    "<body><p>Town library</p><p><a href=/c>Catalogue</a> <a href=/v>Visit</a></p><p data-keep>The reading room stays open through the summer, but the cellar, where the newspapers lie, is closed while the pipes are mended.</p><p data-keep>Ask at the desk.</p>"
    "<p data-keep>Books that were due in these weeks may be brought back in autumn without a fine, as long as they are dry and nobody has written in them.</p><p><a href=/i>Imprint</a></p><p>Bell tower lane</p></body>",
    "<body><div><a href=/>Index</a> <a href=/z>Z</a></div><div data-keep>Bees fly from ten degrees on, and on the first warm day of the year the whole yard hums with them from the hedge to the gate.</div><div data-keep>They know the way.</div><div data-keep>What "
    "they carry home in March is pollen of hazel and willow, yellow and grey, and one can tell by the colour of their legs which of the two has opened.</div><div data-keep>Later come the plums.</div></body>",
)


class Block:
    __slots__ = ("boiler", "heading", "in_list", "keep", "linked", "main", "text", "words")

    def __init__(self, text: str, linked: int, boiler: int, main: int, heading: bool, in_list: bool, keep: bool):
        self.text, self.words, self.linked = text, text.count(" ") + 1, linked
        self.boiler, self.main, self.heading, self.in_list, self.keep = boiler, main, heading, in_list, keep


def hint_of(tag: str, attributes: str) -> tuple[int, int]:
    """(boiler, main): what an element says of itself."""
    boiler, main = int(tag in BOILER_TAGS), int(tag in MAIN_TAGS)
    if attributes:
        for found in HINTS.findall(attributes):
            name, _, value = found.partition("=")
            name, value = name.strip().lower(), value.strip().strip("\"'")
            if name in ("class", "id", "role", "aria-label"):
                words = {w.lower() for part in value.split() for w in WORD_BREAK.split(part.lower()) if w}
                boiler |= not words.isdisjoint(BOILER_WORDS) or any(w.startswith(BOILER_STEMS) for w in words)
                main |= not words.isdisjoint(MAIN_WORDS)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                boiler = 1
    return int(boiler), int(main)


def blocks_of(page: str | None) -> list[Block]:
    page = page or ""
    blocks: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, boiler, main, keep
    parts: list[str] = []
    linked_parts: list[str] = []
    endless: set[str] = set()
    link, at, boiler, main, keep, heading, lists = False, 0, 0, 0, False, "", 0

    def close() -> None:
        nonlocal parts, linked_parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(linked_parts).split()) if linked_parts else 0
                blocks.append(Block(text, linked, boiler, main, bool(heading), lists > 0, keep))
        parts, linked_parts = [], []

    def add(text: str) -> None:
        parts.append(text)
        if link:
            linked_parts.append(text)

    while True:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag in BLOCK:
                close()
                heading = "" if tag in HEADINGS else heading
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        lists -= sum(s[0] in ("ul", "ol") for s in stack[i:])
                        del stack[i:]
                        boiler, main, keep = stack[-1][1:] if stack else (0, 0, False)
                        break
            continue
        if tag in RAW or tag in SKIPPED:
            if not m[0].endswith("/>") and tag not in endless:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    endless.add(tag)
            if tag in ("title", "textarea"):
                close()
        elif tag == "a":
            link = True
        elif tag in BLOCK:
            close()
            if tag in HEADINGS:
                heading = tag
            elif tag in ("p", "li", "div"):
                heading = ""
            if tag in VOID:
                continue
            if tag in ("p", "li") and any(s[0] == tag for s in stack[-3:]):
                # an open paragraph or item ends where the next begins
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        boiler, main, keep = stack[-1][1:] if stack else (0, 0, False)
                        break
                    if stack[i][0] in ("ul", "ol", "table", "article", "section", "div"):
                        break
            own_boiler, own_main = hint_of(tag, m[3])
            if tag in ("body", "html"):
                own_boiler = own_main = 0
            if tag == "header" and not main:
                own_boiler = 1
            boiler, main, keep = min(2, boiler + own_boiler), min(2, main + own_main), keep or "data-keep" in m[3]
            lists += tag in ("ul", "ol")
            stack.append((tag, boiler, main, keep))
        elif tag == "br":
            add(" ")
    close()
    return blocks


def matrix_of(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES); places before the first and after the last count as empty."""
    own = np.array([[min(b.words, 100), min(1.0, b.linked / b.words)] for b in blocks]).reshape(-1, 2)
    none = np.zeros((1, 2))
    has_main = any(b.main > 0 for b in blocks)
    rest = np.array([[b.boiler > 0, b.main > 0, b.heading, b.in_list, has_main and not b.main] for b in blocks], float).reshape(-1, 5)
    return np.hstack([own, np.vstack([none, own[:-1]])[: len(own)], np.vstack([own[1:], none])[-len(own) :] if len(own) else own, rest])


class Tree:
    """A decision tree grown by Gini impurity; ties go to the first feature and the smallest threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(2 * y.sum() > len(y))))
        if depth == 0 or y.min() == y.max():
            return me
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= t
                n = left.sum()
                if least <= n <= len(y) - least:
                    gini = sum(k * p * (1 - p) for k, p in ((n, y[left].mean()), (len(y) - n, y[~left].mean())))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, f, float(t), left)
        if best is None:
            return me
        _, f, t, left = best
        a = self._grow(x[left], y[left], depth - 1, least)
        b = self._grow(x[~left], y[~left], depth - 1, least)
        self.nodes[me] = (f, t, a, b, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def go(node: int, rows: np.ndarray) -> None:
            f, t, a, b, answer = self.nodes[node]
            if f < 0 or not len(rows):
                out[rows] = answer
                return
            left = x[rows, f] <= t
            go(a, rows[left])
            go(b, rows[~left])

        go(0, np.arange(len(x)))
        return out


def train(pages: tuple[str, ...] = LABELLED) -> Tree:
    found = [blocks_of(p) for p in pages]
    return Tree(np.vstack([matrix_of(b) for b in found]), np.array([b.keep for p in found for b in p]))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, ok in zip(blocks, tree.predict(matrix_of(blocks)), strict=True) if ok)


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = [blocks_of(h) for h in b.column(2).to_pylist()]
                texts = [""] * len(found)
                if any(found):
                    keep = tree.predict(np.vstack([matrix_of(x) for x in found if x])).tolist()
                    at = 0
                    for j, x in enumerate(found):
                        texts[j] = "\n\n".join(y.text for y, ok in zip(x, keep[at : at + len(x)], strict=True) if ok)
                        at += len(x)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
SQL: dict[str, str] = {}
