"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ORDER preceding bytes. A context's distribution is PPM method C with
exclusion: a byte seen in the context has probability count / (total + distinct); the escape, distinct /
(total + distinct), is shared by the unseen bytes in proportion to their probability in the context one byte shorter;
the empty context escapes to the uniform distribution. Statistics are frozen after training, so the code length of a
text in a language is the exact sum over its bytes of -log2 of these probabilities, in the longest context of that
language's tree. The language of least code length is predicted.

The trees are merged into one automaton: a node for each context of any language. A position's node is found in ORDER
table look-ups, for all positions of a chunk at once. A language has a row of code lengths for each context of its own
only; a node points to the row of the longest context of that language that ends there, so rows grow with the training
sample of a language, not with that of all.

Training takes a bounded sample of labelled rows: for each language the SAMPLE_ROWS with the smallest hash of the id,
those longer than SAMPLE_TEXT characters left out. Scoring reads all texts whole.

Defined results: 'und' and score 0 for null texts and those without a letter; ties go to the language first in the
alphabet; without labelled rows everything is 'und'; repeated rows are scored alike. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.sampling import bounded_sample, held_out, sampled_texts
from palimpsest.session import table

ORDER = 4
SAMPLE_ROWS = 200
SAMPLE_TEXT = 10_000
#: A context is in a language's tree if it was seen so often there.
LEAST_COUNT = 6
#: Bytes scored at a time.
CHUNK = 1 << 18
SEED = 11


class ContextTrees:
    """The merged automaton: child[node, byte] goes one byte further back, own[row[language, node], byte] is in bits."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST_COUNT):
        self.langs = sorted(samples)
        self.order = order
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        # bytes never seen share one symbol, which each of them codes with 8 more bits
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        size = int(seen.sum()) + 1
        begin = size  # the place before a text
        self.begin = begin
        base = size + 1
        counts = [self._counts([self.symbol[np.frombuffer(t, np.uint8)] for t in samples[x]], base, least) for x in self.langs]
        codes = [np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.zeros(0, np.int64) for k in range(order + 1)]
        # nodes of depth k are contexts of k bytes, numbered by their code, the nearest byte as the lowest digit
        first = np.cumsum([0] + [len(c) for c in codes])
        n = int(first[-1])
        child = np.empty((n, base), np.int32)
        child[:] = np.arange(n)[:, None] + n  # no longer context there: node i is final as n + i
        for k in range(1, order + 1):
            parent = codes[k] % base ** (k - 1)
            child[first[k - 1] + np.searchsorted(codes[k - 1], parent), codes[k] // base ** (k - 1)] = first[k] + np.arange(len(codes[k]))
        self.nodes = n
        self.row = np.empty((len(self.langs), n), np.int32)
        made = [np.zeros((0, size), np.float32)]
        for i, c in enumerate(counts):
            begins_at = sum(map(len, made))
            p = self._mix(np.full((1, size), 1 / size), c[0][1])
            row = np.zeros(len(codes[0]), np.int64)
            self.row[i, first[0] : first[1]] = begins_at
            for k in range(1, order + 1):
                row = row[np.searchsorted(codes[k - 1], codes[k] % base ** (k - 1))]
                own = np.searchsorted(codes[k], c[k][0])
                new = self._mix(p[row[own]], c[k][1])
                row[own] = len(p) + np.arange(len(own))
                p = np.concatenate([p, new])
                self.row[i, first[k] : first[k + 1]] = begins_at + row
            made.append((-np.log2(p)).astype(np.float32))
        cost = np.zeros((sum(map(len, made)), base), np.float32)
        cost[:, :size] = np.concatenate(made)
        cost[:, 0] += 8
        self.own = cost.reshape(-1)
        self.child = child.reshape(-1)
        self.base = base

    @property
    def cost(self) -> np.ndarray:
        """(nodes, symbols, languages): the code lengths spelt out, with a row for every context in every language."""
        return self.own.reshape(-1, self.base)[self.row].transpose(1, 2, 0)

    def _counts(self, texts: list[np.ndarray], base: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth: context codes, and counts of the next symbol in them."""
        begin = np.full(self.order, self.begin)
        joined = np.concatenate([np.concatenate([begin, t]) for t in texts]) if texts else begin
        at = np.arange(self.order, len(joined))
        at = at[joined[at] != self.begin]
        code, found = np.zeros(len(at), np.int64), []
        for k in range(self.order + 1):
            if k:
                code = code + joined[at - k] * base ** (k - 1)
            ctx, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
            keep = n >= (least if k else 0)
            place = np.cumsum(keep) - 1
            ok = keep[inverse]
            table_ = np.zeros((int(keep.sum()), self.begin), np.float64)
            np.add.at(table_, (place[inverse[ok]], joined[at[ok]]), 1)
            if not k and not len(table_):
                ctx, keep, table_ = np.zeros(1, np.int64), np.ones(1, bool), np.zeros((1, self.begin))
            found.append((ctx[keep], table_))
        return found

    @staticmethod
    def _mix(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """PPM method C with exclusion of the bytes that a context has seen."""
        if not len(counts):
            return p
        total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        rest = np.where(counts > 0, 0, p)
        left = rest.sum(1, keepdims=True)
        some = left > 1e-12
        scale = np.where(some, distinct / np.maximum(left, 1e-12), 0)
        whole = np.where(some, total + distinct, np.maximum(total, 1))
        return np.where(total > 0, np.where(counts > 0, counts, rest * scale) / whole, p)

    def bits(self, data: list[bytes]) -> np.ndarray:
        """(texts, languages) code lengths."""
        out = np.zeros((len(data), len(self.langs)))
        gap = np.full(self.order, self.begin)
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, d in enumerate(data):
            sym = self.symbol[np.frombuffer(d, np.uint8)]
            for s in range(0, len(sym), CHUNK):
                group.append((i, np.concatenate([gap if s == 0 else sym[s - self.order : s], sym[s : s + CHUNK]])))
                size += len(group[-1][1])
                if size >= CHUNK:
                    self._add(out, group)
                    group, size = [], 0
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, np.ndarray]]) -> None:
        """Adds the code lengths of pieces, each led by the ORDER symbols before it."""
        joined = np.concatenate([p for _, p in group])
        m = len(joined) - self.order
        node = np.zeros(m, np.int64)
        for k in range(1, self.order + 1):
            further = self.child[np.minimum(node, self.nodes - 1) * self.base + joined[self.order - k : self.order - k + m]]
            node = np.where(node < self.nodes, further, node)
        node = np.where(node < self.nodes, node, node - self.nodes)
        ends = np.cumsum([len(p) for _, p in group])
        begins = np.concatenate([[0], ends[:-1]])
        edges = np.stack([begins, ends - self.order], 1).ravel()[:-1]  # between pieces lie the next one's leading symbols
        which = [i for i, _ in group]
        for i, row in enumerate(self.row):
            cost = self.own[row[node].astype(np.int64) * self.base + joined[self.order :]]
            np.add.at(out[:, i], which, np.add.reduceat(cost, edges, dtype=np.float64)[::2])


LETTER_LIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Some numerals are like letters to the pattern, so what it finds is looked at."""
    return bool(text) and any(m[0].isalpha() for m in LETTER_LIKE.finditer(text))


def predict(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits: score is the posterior of the predicted language, bits its code length."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                texts = b.column(1).to_pylist()
                n = len(texts)
                has = np.array([bool(model.langs) and has_letter(t) for t in texts])
                best, score, least = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
                if has.any():
                    where = np.flatnonzero(has)
                    bits = model.bits([texts[j].encode("utf-8", "surrogatepass") for j in where])
                    best[where] = bits.argmin(1)
                    least[where] = bits.min(1)
                    score[where] = 1 / np.exp2(np.maximum(least[where, None] - bits, -200)).sum(1)
                yield pa.record_batch([b.column(0), pa.array(names[best].tolist()), pa.array(score), pa.array(least)], names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def train(docs: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Trees of the labelled ones among ``rows`` of docs."""
    labelled = docs.where(rows).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = bounded_sample(labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("stratum")), "stratum", SAMPLE_ROWS, SEED)
    texts: dict[str, list[bytes]] = {}
    for _, lang, text in sampled_texts(labelled, sample, "stratum", id_col, text_col, SAMPLE_TEXT):
        texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
    return ContextTrees(texts)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then the code length in the predicted language."""
    docs = table(spark, sf_dir, "documents")
    trees = train(docs, ~held_out("doc_id"))
    return predict(docs, trees).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
