"""Toxicity of long texts: repetition is no evidence, and texts of any length are trained on."""

import random

from palimpsest.llm import toxicity


def test_a_repeated_weak_word_is_not_toxic():
    rng = random.Random(4)
    words = [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}" for _ in range(20_000)]
    words[::13] = ["weakly"] * len(words[::13])
    text = ". ".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    model = toxicity.SentenceModel({"weakly": 0.9}, -4.595)
    score, spans = model.score(text)
    assert len(spans) > 1000 and 0 < score < 0.05 and score == model.score("A weakly word.")[0]


def test_sentences_combine():
    model = toxicity.SentenceModel({"vile": 5.0, "scum": 5.0}, -4.595)
    one, both = model.score("You vile man.")[0], model.score("You vile man. You scum!")
    assert both[0] > one and abs((1 - both[0]) - (1 - one) ** 2) < 1e-9 and len(both[1]) == 2


def test_long_texts_are_trained_on(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [(i, ". ".join(" ".join(word() for _ in range(9)) for _ in range(350)) + (". You zounderkite." if i % 2 else ".")) for i in range(60)]
    assert min(len(t) for _, t in texts) > 20_000
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int"))
    assert model.score("Go, zounderkite.")[0] > toxicity.THRESHOLD and model.score("Go, friend.")[0] == 0
