"""Models held against plain versions that share no code with them."""

import math
import re
from collections import Counter

import numpy as np

from palimpsest.llm import extraction, language_id, toxicity
from palimpsest.llm.sampling import held_out
from palimpsest.session import table


def plain_toxicity(text, weights):
    """Noisy-or over the distinct evidence of sentences, each a sigmoid of its features' weights."""
    floor = toxicity.FLOOR
    seen = set()
    for sentence in re.split(r"(?<=[.!?])(?![.!?])|\n", (text or "").lower()):
        own = set()
        for word in re.findall(r"[^\W\d_]+", sentence):
            for f in [word] + [word[:k] + "*" for k in range(4, 9) if k < len(word)]:
                if f in weights:
                    own.add(f)
        if own:
            seen.add(frozenset(own))
    clean = 1.0
    for own in seen:
        p = 1 / (1 + math.exp(-(math.log(floor / (1 - floor)) + sum(weights[f] for f in own))))
        clean *= min(1.0, (1 - p) / (1 - floor))
    return 1 - clean


def test_toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    assert model.weights
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op1_toxicity(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - plain_toxicity(texts[r.doc_id], model.weights)) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_toxicity_is_trained_through_the_noisy_or():
    """A word that only ever stands beside a toxic one in clean documents too gets no weight; sentences are not labelled."""
    rows = [(f"Fine day {i}. You vile{i % 3} zounder. All good.", 1) for i in range(60)] + [(f"Fine day {i}. A good zebra walk. All good.", 0) for i in range(60)]
    model = toxicity.SentenceModel.fit([(toxicity.bag_of(t), y) for t, y in rows])
    score, spans = model.score("A good day. You zounder. Nice.")
    assert score > 0.7 and max(spans, key=lambda x: x[2])[:2] == (11, 24) and model.score("A good day. Nice.")[0] < 0.1


class PlainPpm:
    """PPM, method C with exclusion, a symbol at a time; contexts of fewer than ``least`` occurrences are unknown."""

    def __init__(self, texts, order, least, alphabet):
        self.order, self.alphabet, self.counts = order, alphabet, {}
        for t in texts:
            symbols = [None] * order + list(t)
            for i in range(order, len(symbols)):
                for k in range(order + 1):
                    self.counts.setdefault(tuple(symbols[i - k : i]), Counter())[symbols[i]] += 1
        self.counts = {c: n for c, n in self.counts.items() if not c or sum(n.values()) >= least}

    def bits(self, text):
        symbols = [None] * self.order + list(text)
        return sum(self.cost(tuple(symbols[i - self.order : i]), symbols[i]) for i in range(self.order, len(symbols)))

    def cost(self, context, symbol):
        known = 0
        for k in range(self.order + 1):
            if k and context[self.order - k :] not in self.counts:
                break
            known = k
        unknown = symbol not in self.alphabet
        # all bytes never seen are one symbol, told apart by 8 bits more
        return (8 if unknown else 0) - math.log2(self.probability(context[self.order - known :] if known else (), "?" if unknown else symbol))

    def probability(self, context, symbol):
        everything = [*self.alphabet, "?"]
        p = {s: 1 / len(everything) for s in everything}
        for k in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - k :], Counter())
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            rest = sum(q for s, q in p.items() if s not in seen)
            p = {s: seen[s] / (total + distinct) if s in seen else q * distinct / rest / (total + distinct) for s, q in p.items()}
        return p[symbol]


def test_language_code_lengths():
    samples = {"a": [b"abracadabra abra cadabra", b"barbara abba"], "b": [b"bob bobs boob oboe", b"sob"]}
    alphabet = sorted({x for texts in samples.values() for t in texts for x in t})
    for order, least in ((0, 1), (1, 1), (2, 1), (3, 2)):
        trees = language_id.ContextTrees(samples, order=order, least=least)
        plain = [PlainPpm(samples[x], order, least, alphabet) for x in ("a", "b")]
        for text in (b"abra", b"bobcat abacus", b"zebra", b"x"):
            assert np.allclose(trees.bits([text])[0], [m.bits(text) for m in plain], atol=1e-3)
