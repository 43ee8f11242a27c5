"""Blocks and main text against a plain parser, and what the tree looks at."""

from html.parser import HTMLParser

import pytest

from palimpsest.llm import extraction
from palimpsest.session import table


class PlainBlocks(HTMLParser):
    """Text between block tags, by the standard parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.skip, self.depth = [], [], 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "textarea", "template", "svg", "select", "option", "button"):
            self.skip += 1
        if tag in extraction.BLOCK:
            self.end()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "textarea", "template", "svg", "select", "option", "button"):
            self.skip = max(0, self.skip - 1)
        if tag in extraction.BLOCK:
            self.end()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_blocks_of_all_pages(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        assert [b.text for b in extraction.blocks_of(r.html)] == PlainBlocks(r.html or "").blocks


def test_main_text_is_whole_blocks_in_order(spark, sf_dir):
    """Each block is kept or not as a whole, by a walk through the tree's nodes."""
    tree = extraction.train()
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(table(spark, sf_dir, "pages"), tree).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        blocks = extraction.blocks_of(r.html)
        kept = []
        for b, row in zip(blocks, extraction.matrix_of(blocks), strict=True):
            at = 0
            while tree.nodes[at][0] >= 0:
                f, t, low, high, _ = tree.nodes[at]
                at = low if row[f] <= t else high
            if tree.nodes[at][4]:
                kept.append(b.text)
        text = "\n\n".join(kept)
        assert got[r.page_id] == (text, len(text))


def test_the_tree_looks_at_words_links_and_neighbours():
    used = {extraction.FEATURES[f] for f, *_ in extraction.train().nodes if f >= 0}
    assert {"words", "links", "links_before", "links_after"} <= used


def test_pages_that_say_nothing_of_themselves():
    long = "The mill stands at the upper end of the valley, where the stream is quick enough even in a dry summer to turn the wheel for some hours a day."
    page = f"<body><div>Valley News</div><div><a href=/>Front</a> <a href=/x>Sport</a></div><div>{long}</div><div>It is old.</div><div>{long}</div><div><a href=/p>Before</a> <a href=/n>After</a></div><div>Post box nine</div></body>"
    assert extraction.main_text(page, extraction.train()) == f"{long}\n\nIt is old.\n\n{long}"
    inside = f'<body><div class="more-content"><p>{long}</p></div></body>'
    assert extraction.main_text(inside, extraction.train()) == long


@pytest.mark.parametrize("left_out", range(0, len(extraction.LABELLED), 3))
def test_labelled_pages_that_were_left_out(left_out):
    pages = extraction.LABELLED
    tree = extraction.train(pages[:left_out] + pages[left_out + 1 :])
    blocks = extraction.blocks_of(pages[left_out])
    wrong = sum(int(p != b.keep) for p, b in zip(tree.predict(extraction.matrix_of(blocks)), blocks, strict=True))
    assert wrong <= 1


def test_a_very_long_page():
    page = "<article>" + "<p>One two three &amp; four.</p>" * 50_000 + "</article>"
    text = extraction.main_text(page, extraction.train())
    assert text.count("\n\n") == 49_999 and text.startswith("One two three & four.")
