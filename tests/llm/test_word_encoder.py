"""The packing's word encoder: the tokenizer's ids at any state of its cache, and with vocabularies of another cut."""

import json

import numpy as np
from tokenizers import Tokenizer

from palimpsest.llm import packing


def ids(enc, texts):
    return [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)]


def test_words_that_leave_the_cache_and_come_back(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    path = packing.default_tokenizer()
    enc, tok = packing.WordEncoder(path, 2), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    letters = list("abcdefghÀÉßñœŽ'.,!19 \t")
    batches = [["".join(rng.choice(letters, 40)) for _ in range(6)] for _ in range(30)]
    for texts in [*batches, *batches[::-1]]:
        assert ids(enc, texts) == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert enc.before and len(enc.words) < 400


def test_another_cut(tmp_path):
    """A vocabulary that keeps capitals is not cut by the known pattern."""
    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        spec = json.load(file)
    spec["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(spec, file)
    enc, tok = packing.WordEncoder(path, 2), Tokenizer.from_file(path)
    texts = ["The END of it's", "", "a b"]
    assert not enc.known and ids(enc, texts) == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
