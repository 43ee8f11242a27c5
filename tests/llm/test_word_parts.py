"""The packing's word encoder cuts at white space and before tails of punctuation: the tokenizer's ids, and the pattern only for what is new."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing

PIECES = ["it's", "'s", "o'clock", "'sam", "they'Ll", "''s", "a'", "x-y", "--", "...", "!!'t", "3.14", "2024,", "¼", "a²", "ª.", "­", "so­ft", "ŉ", "ſt", "Ÿ", "ÀÉ", "·", "«ja»", "<|", "<", "end.", "END", "一二", "İ", "é", " ", "\x1f", "\x85"]
SPACES = [" ", "  ", "\t", "\n\n", "\x0b", "\x0c", "\r\n", ""]


def ids(enc, texts):
    return [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)]


@pytest.mark.parametrize("most", [1, 40, 1 << 21])
def test_parts_have_the_tokenizers_ids(monkeypatch, most):
    monkeypatch.setattr(packing, "CUT_CHARS", most)
    monkeypatch.setattr(packing, "CACHE_WORDS", 30)
    path = packing.default_tokenizer()
    enc, tok = packing.WordEncoder(path, 2), Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    texts = ["", None, " ", "\n", "'", "."] + ["".join(x + y for x, y in zip(rng.choice(PIECES, n), rng.choice(SPACES, n), strict=True)) for n in rng.integers(1, 12, 300)]
    for some in (texts, texts[::-1], texts[:50]):
        assert ids(enc, some) == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in some]


def test_texts_without_white_space(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 4000)
    path = packing.default_tokenizer()
    enc, tok = packing.WordEncoder(path, 2), Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcÉ019/+='s."), 900)) + end for end in ("", " a b'", "\nx", "x" * 400) for _ in range(10)] + ["", None, "short one"]
    for some in (texts, texts[::-1]):
        assert ids(enc, some) == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in some]
    kept = max(len(x.encode()) for x in enc.words.words.to_pylist())
    assert kept <= 500 and enc.before


def test_every_plain_character():
    path = packing.default_tokenizer()
    enc, tok = packing.WordEncoder(path, 2), Tokenizer.from_file(path)
    plain = [c for c in map(chr, range(0x180)) if not enc.odd(c)]
    texts = [f"ab{c}cd {c}x x{c} 1{c} {c}{c}. .{c}" for c in plain]
    assert len(plain) > 300 and ids(enc, texts) == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_the_pattern_is_for_new_parts():
    enc = packing.WordEncoder(packing.default_tokenizer(), 2)
    texts = [f"Words, and words again: {i % 3} (it's so)." for i in range(100)]
    first = enc.encode(texts)
    calls = []
    enc.words_of = lambda t: calls.append(t) or []
    assert enc.encode(texts[::-1]) == first[::-1] and not calls
