"""The share of letters means the same at every length and in every script."""

import pytest

from palimpsest.llm import quality

ALPHABETIC = 8


@pytest.mark.parametrize("text", ["It's well-known, isn't it? ", "天気がいい。散歩に行こう。", "a1 ²½ x_y 😀 é"])
def test_letters_are_counted_at_all_lengths(text):
    share = sum(map(str.isalpha, text)) / len(text)
    for n in (1, 2, 10, 200):
        assert quality.features(text * n)[ALPHABETIC] == pytest.approx(share)
