"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence has the score p_s = sigmoid(b + sum of the weights of its features), with b
the log odds of FLOOR; a document is toxic with 1 - product of q_s over its sentences, where q_s = (1 - p_s) / (1 - FLOOR),
1 at most, leaves the floor out: a sentence without evidence says nothing, so length alone makes nothing toxic. Sentences
with the same features are one instance, so neither does repetition. No sentence is ever labelled: the weights are fitted
by gradient descent on the documents' labels through the noisy-or, of which a share NOISE is taken to be wrong either way.
Training and scoring have the same instances and the same formula. After training the sentence scores say where the
document offends.

Features of a sentence are its distinct words and their openings of 4 to 8 letters, so that inflected forms share
evidence; words are runs of letters of the lower-cased text. Features that the training labels favour by a likelihood
ratio of at least EVIDENCE get a weight; near copies count once there. While fitting, a random part of the features is
left out of each step: otherwise the words that explain most documents take all the weight, and rarer ones would not
suffice by themselves.

Training takes a bounded sample of labelled rows: SAMPLE_ROWS of each label, by the smallest hash of the id. It runs in
one task; only the weights go to the driver. Texts of any length are trained on and scored whole.

Defined results: null and empty texts score 0; without labelled rows of both kinds all score 0; repeated label rows of an
id count once, as toxic if one says so; repeated documents score alike. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.sampling import bounded_sample, held_out
from palimpsest.session import table

SAMPLE_ROWS = 3000
NOISE = 0.03
EVIDENCE = 10.0
FLOOR = 1e-2
RIDGE = 0.2
#: Share of the features that a step leaves out.
DROPPED = 0.3
OPENINGS = (4, 8)
THRESHOLD = 0.7
SEED = 5

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+")


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Code-point bounds of sentences: up to and with full stops, exclamation and question marks, or a line's end."""
    return [m.span() for m in SENTENCE.finditer(text)]


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(OPENINGS[0], min(OPENINGS[1], len(word) - 1) + 1))]


class Bag(NamedTuple):
    """What training needs of a text: a digest, and of each distinct sentence with a word its distinct words with blanks
    between."""

    key: str
    sentences: list[str]


def digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def bag_of(text: str) -> Bag:
    low = text.lower()
    return Bag(digest(low).hex(), sorted({" ".join(sorted(set(WORD.findall(x)))) for x in set(SENTENCE.findall(low))} - {""}))


def unlike(rows: list[tuple[Bag, int]]) -> list[tuple[Bag, int]]:
    """``rows`` without those that share half of their longer sentences with earlier ones."""
    seen: set[bytes] = set()
    out = []
    for bag, y in rows:
        own = {digest(x) for x in bag.sentences if len(x) > 20}
        if not own or 2 * len(own & seen) < len(own):
            out.append((bag, y))
        seen |= own
    return out


class SentenceModel:
    def __init__(self, weights: dict[str, float], bias: float = math.log(FLOOR / (1 - FLOOR))):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple[str, ...]] = {}

    @classmethod
    def fit(cls, rows: list[tuple[Bag, int]], steps: int = 300, rate: float = 0.15, ridge: float = RIDGE, dropped: float = DROPPED, evidence: float = EVIDENCE) -> SentenceModel:
        once = {(bag.key, y): bag for bag, y in rows}
        bags = unlike([(once[k], k[1]) for k in sorted(once)])
        n1 = sum(y for _, y in bags)
        n0 = len(bags) - n1
        if not n1 or not n0:
            return cls({})
        in1, in0 = Counter(), Counter()
        for bag, y in bags:
            if y:
                in1.update({f for w in set(" ".join(bag.sentences).split()) for f in features_of(w)})
        for bag, y in bags:
            if not y:
                in0.update({f for w in set(" ".join(bag.sentences).split()) for f in features_of(w) if f in in1})
        share = n1 / (n0 + n1)
        # a longer feature must say more than the longest shorter one that is in already
        rates: dict[str, float] = {}
        for f in sorted(in1, key=lambda f: (len(f), f)):
            a, n = in1[f], in1[f] + in0[f]
            opening = f[:-1] if f[-1] == "*" else f
            base = next((rates[o] for k in range(min(OPENINGS[1], len(opening)), OPENINGS[0] - 1, -1) if (o := opening[:k] + "*") in rates), share)
            if a / n > base:
                ratio = 2 * a * math.log(a / n / base) + (2 * (n - a) * math.log((n - a) / n / (1 - base)) if n > a else 0)
                if ratio >= evidence:
                    rates[f] = min(a / n, 1 - 0.5 / n)
        model = cls(dict.fromkeys(sorted(rates), 2.0))
        place = {f: i for i, f in enumerate(model.weights)}
        # the sparse design: instances are the distinct sets of features of a document's sentences, as they are scored
        doc, inst, col = [], [], []
        n = 0
        for d, (bag, _) in enumerate(bags):
            for found in {model.features_in(x.split()) for x in bag.sentences}:
                if found:
                    doc.append(d)
                    inst += [n] * len(found)
                    col += [place[f] for f in found]
                    n += 1
        y = np.array([y for _, y in bags], float)
        doc, inst, col = np.array(doc, int), np.array(inst, int), np.array(col, int)
        w, bias = np.full(len(place), 2.0), model.bias
        m, v = np.zeros_like(w), np.zeros_like(w)
        rng = np.random.Generator(np.random.PCG64(SEED))
        for t in range(1, steps + 1):
            on = rng.random(len(w)) >= dropped
            z = bias + np.bincount(inst, (w * on)[col], minlength=n)
            above = z > bias
            p = above / (1 + np.exp(-z))
            clean = np.exp(np.bincount(doc, above * (math.log1p(math.exp(bias)) - np.logaddexp(0, z)), minlength=len(y)))
            toxic = NOISE + (1 - 2 * NOISE) * (1 - clean)
            slope = np.where(y == 1, -1 / toxic, 1 / (1 - toxic)) * (1 - 2 * NOISE) * clean
            g = np.bincount(col, (slope[doc] * p)[inst], minlength=len(w)) * on + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 0.05})

    def features_in(self, words: Iterable[str]) -> frozenset[str]:
        """The features with a weight that these words have."""
        memo = self.words
        if len(memo) > 100_000:
            memo.clear()
        out: set[str] = set()
        for w in words:
            own = memo.get(w)
            if own is None:
                own = memo[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                out.update(own)
        return frozenset(out)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of each sentence with a known feature."""
        if not text or not self.weights:
            return 0.0, []
        low = text.lower()
        if not self.features_in(set(WORD.findall(low))):
            return 0.0, []
        if len(low) != len(text):  # a letter that lower-cases to two; keep the offsets of the text
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        found, left = [], {}
        for a, b in sentences_of(low):
            own = self.features_in(set(WORD.findall(low[a:b])))
            if own:
                # in a fixed order, so that equal sentences have equal sums
                z = self.bias + sum(self.weights[f] for f in sorted(own))
                found.append((a, b, 1 / (1 + math.exp(-z))))
                left[own] = min(1.0, (1 + math.exp(self.bias)) / (1 + math.exp(z)))
        return 1 - math.prod(sorted(left.values())), found


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SentenceModel:
    """From the labels of those ``rows`` (an expression on the id) of ``labels``. The bags of the sample, which is bounded,
    are made where the texts lie and meet in one task that fits the weights."""
    if rows is not None:
        labels = labels.where(rows)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("stratum"))
    sample = bounded_sample(known, "stratum", SAMPLE_ROWS, SEED)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [bag_of(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([m.key for m in made], pa.string()), pa.array([m.sentences for m in made], pa.list_(pa.string()))], names=["stratum", "key", "sentences"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(Bag(key, sentences), y) for b in batches for y, key, sentences in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        weights = SentenceModel.fit(found).weights
        yield pa.record_batch([pa.array(list(weights), pa.string()), pa.array(list(weights.values()), pa.float64())], names=["feature", "weight"])

    some = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    found = some.join(sample, F.col("id_") == F.col("id")).select("stratum", "text").mapInArrow(bags, "stratum int, key string, sentences array<string>")
    weights = found.repartition(1).mapInArrow(fit, "feature string, weight double")
    return SentenceModel(dict(sorted((r.feature, r.weight) for r in weights.collect())))


def score_toxicity(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, offending: the sentences (start, end, score; code points) of score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sentence = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                made = [shared.value.score(t) for t in b.column(1).to_pylist()]
                spans = [[{"start": a, "end": e, "score": p} for a, e, p in found if p >= 0.5] for _, found in made]
                yield pa.record_batch(
                    [b.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array([int(s >= threshold) for s, _ in made], pa.int32()), pa.array(spans, pa.list_(sentence))],
                    names=["doc_id", "score", "predicted", "offending"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without those of score ``threshold`` or more, its columns unchanged. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                yield b.filter(pa.array([shared.value.score(t)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then the offending sentences."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "offending")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
