"""Texts in formulas and fallbacks are read, and unclosed controls do not take the rest of the article."""

import pytest

from palimpsest.llm import extraction

LONG = "The committee met on Tuesday and agreed on the plan that had been put forward in spring."


@pytest.mark.parametrize("tag", ["math", "object", "noscript", "canvas", "audio", "video"])
def test_contents_are_read(tag):
    assert [b.text for b in extraction.blocks_of(f"<article><p>One <{tag}>two</{tag}> three</p></article>")] == ["One two three"]


@pytest.mark.parametrize("tag", ["button", "option", "svg", "math", "object", "template"])
def test_unclosed_elements_lose_nothing(tag):
    page = f"<article><p>{LONG}</p><{tag}><p>{LONG}</p></article>"
    assert extraction.main_text(page, extraction.train()) == f"{LONG}\n\n{LONG}"


def test_controls_and_raw_text_are_left_out():
    page = "<p>One <button>Send</button><svg><title>t</title></svg>two<math><annotation>x^2</annotation></math></p><script>three"
    assert [b.text for b in extraction.blocks_of(page)] == ["One two"]
