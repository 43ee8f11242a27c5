"""Mixture-controlled packing: deficit round-robin over source queues into fixed token windows.

Each source is a queue of tokens. The windows are filled so that, after every window, each queue has been served
its share of all tokens so far to within one token: a queue's deficit is carried from window to window and, because
the served count is a closed form of the window's number, from partition to partition without any shared state.
Queue s with weight w gives its token q the virtual time (q + 1/2) / w; the schedule is the order of these times, and
window k takes the tokens of ranks [k * size, (k + 1) * size). A drained queue leaves its share to the others.

Steps: (1) tokenise, one pass, written with each row's running offset inside its (file partition, queue);
(2) sum by (partition, queue) and turn the sums into offsets; (3) cut every document at the window boundaries.
The texts are never shuffled, and the ids only with more than MAX_QUEUES sources: then a document is cut at the
boundaries of blocks of windows, and a block's tokens meet in one task, which orders them by their virtual times.

Defined results: a null or empty text is a document of the closing id only; a null source is a queue of its own;
repeated rows are packed once each; an empty table gives no piece. Columns other than id, text and source are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import table, written

WINDOW_TOKENS = 4096
END_ID = 2
#: With more distinct sources than this, pieces are cut a block of windows at a time. The result is the same.
MAX_QUEUES = 1024
#: Windows of a block.
BLOCK = 128
#: Words, or bytes, of a worker's cache; beyond it they are kept as those of before, and those before go.
CACHE_WORDS, CACHE_BYTES = 150_000, 16 << 20
#: Characters of the texts that are cut into words at a time; a longer text is cut alone.
CUT_CHARS = 1 << 21
#: A text with more bytes than this between white space is cut by the pattern.
LONG_CHUNK = 256

TOKENS_SCHEMA = "doc_id long, queue string, part int, local_start long, doc_tokens long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "queue string, ids binary"
)

_TOKENIZERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the spans, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Words:
    """Distinct words and their ids, one word's after the other's."""

    def __init__(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray):
        self.words, self.sizes, self.ids = words, sizes, ids
        self.starts = np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return len(self.words)

    @property
    def full(self) -> bool:
        return len(self) > CACHE_WORDS or self.words.nbytes + self.ids.nbytes > CACHE_BYTES

    def at(self, words: pa.Array) -> np.ndarray:
        """Places of ``words`` here, -1 of those that are not."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def take(self, places: np.ndarray) -> Words:
        sizes = self.sizes[places]
        return Words(self.words.take(pa.array(places)), sizes, self.ids[spans(self.starts[places], sizes)])

    def plus(self, *others: Words) -> Words:
        every = [x for x in (self, *others) if len(x)] or [self]
        return self if every == [self] else Words(pa.concat_arrays([x.words for x in every]), np.concatenate([x.sizes for x in every]), np.concatenate([x.ids for x in every]))


class WordEncoder:
    """Ids of whole texts as little-endian uint16 (uint32 for large vocabularies) bytes.

    A vocabulary of the known CUT cuts a text into words and encodes each for itself. Words end at white space, and at the
    last letter or number before it, so texts are cut there without the pattern; only what is new is cut by it, as it can
    still be several words. These parts repeat, and are kept: those of late, and of the time before that what was met again. New ones are
    encoded many to a call, by the model alone, as they are normalised and cut already; each word ends with the only
    piece that carries the word-end mark. A text with
    characters outside PLAIN, which could be normalised or cut differently here, or with a special token's opening
    mark, goes to the tokenizer whole, and so do all texts with a vocabulary that cuts otherwise.
    """

    #: Here lower() and NFC do as the tokenizer does, and white space is the same.
    PLAIN = "\t\n\x0b\x0c\r -~\u00a1-\u012f\u0131-\u017f"
    END_MARK = "</w>"
    #: How the vocabulary's file states the pattern and the steps before the model.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    CUT = [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.is_end = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = piece.endswith(self.END_MARK)
        steps = []
        for step, inner in ((self.tokenizer.normalizer, "normalizers"), (self.tokenizer.pre_tokenizer, "pretokenizers")):
            steps += [] if step is None else json.loads(step.__getstate__()).get(inner, [])
        self.known = steps == self.CUT
        self.model_only = Tokenizer(self.tokenizer.model)
        self.model_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on; the space stays.
        itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = sorted(set(range(0x100)) - set(itself))
        self.of_byte = {x: 0x100 + i for i, x in enumerate(others) if x != 0x20}
        kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(0x180))}
        letters, numbers = (re.escape("".join(c for c, k in kinds.items() if k == x)) for x in "LN")
        #: The vocabulary's own pattern, for plain texts: contractions, runs of letters, single digits, runs of others.
        self.words_of = re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}{numbers}]+").findall
        self.odd = re.compile(f"[^{self.PLAIN}]").search
        #: The characters of the pattern's last case.
        self.others = "".join(c for c, k in kinds.items() if k not in "LN" and not c.isspace())
        self.none = Words(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, self.dtype))
        self.words = self.before = self.none

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> Words:
        """The parts ``new`` with their ids."""
        cut = [[p] if p.isalpha() else self.words_of(p) for p in new]
        ids: list[list[int]] = [[]] * len(new)
        plain = [p.isascii() for p in new]
        # what is plain stands for itself in the byte-level alphabet
        for kind in (True, False):
            of = [i for i, x in enumerate(plain) if x is kind]
            groups = [of[i : i + 128] for i in range(0, len(of), 128)]
            lines = [" ".join([w for i in g for w in cut[i]]) for g in groups]
            if not kind:
                lines = [x.encode().decode("latin-1").translate(self.of_byte) for x in lines]
            for some, found in zip(groups, self.model_only.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                got = found.ids
                ends = np.concatenate([[0], np.flatnonzero(self.is_end[got]) + 1])
                last = np.cumsum([0, *(len(cut[i]) for i in some)])
                if len(ends) == last[-1] + 1 and ends[-1] == len(got):
                    at = ends[last].tolist()
                    for i, x, y in zip(some, at, at[1:], strict=False):
                        ids[i] = got[x:y]
                else:
                    for i in some:
                        ids[i] = self.tokenizer.encode(new[i], add_special_tokens=False).ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return Words(pa.array(new, pa.large_string()), sizes, np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())))

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Places of the distinct ``parts`` among the kept ones, which they all are then."""
        at = self.words.at(parts)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            was = self.before.at(parts.take(pa.array(lost)))
            back, new = lost[was >= 0], lost[was < 0]
            at[back] = len(self.words) + np.arange(len(back))
            at[new] = len(self.words) + len(back) + np.arange(len(new))
            self.words = self.words.plus(self.before.take(was[was >= 0]), self._learn(parts.take(pa.array(new)).to_pylist()))
        return at

    def _cut(self, texts: list[str | None], parted: bool = False) -> list[bytes]:
        """Ids of the plain ``texts``, in lower case; of null none. parted: their words stand between white space."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = cut.flatten().dictionary_encode()
        of, of_chunk = chunks.dictionary, chunks.indices.to_numpy()
        until = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))])
        long = pc.binary_length(of).to_numpy(zero_copy_only=False) > LONG_CHUNK
        if long.any() and not parted:
            rows = set((np.searchsorted(until, np.flatnonzero(long[of_chunk]), "right") - 1).tolist())
            return self._cut([" ".join(self.words_of(t)) if i in rows else t for i, t in enumerate(texts)], True)
        heads = pc.utf8_rtrim(of, characters=self.others)
        begin = np.frombuffer(of.buffers()[1], np.int64)[of.offset :][: len(of) + 1] if len(of) else np.zeros(1, np.int64)
        n = pc.binary_length(heads).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(n < np.diff(begin))
        sizes = np.diff(begin)[tailed] - n[tailed]
        raw = np.frombuffer(of.buffers()[2] or b"", np.uint8)[spans(begin[tailed] + n[tailed], sizes)]
        tails = pa.LargeStringArray.from_buffers(len(tailed), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(raw))
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        # of each distinct chunk its head and its tail, if it has one
        at = self._places(parts.dictionary)[parts.indices.to_numpy()]
        known = self.words
        two, size = np.zeros((len(of), 2), np.int64), np.zeros((len(of), 2), np.int64)
        two[:, 0], two[tailed, 1] = known.starts[at[: len(of)]], known.starts[at[len(of) :]]
        size[:, 0], size[tailed, 1] = known.sizes[at[: len(of)]], known.sizes[at[len(of) :]]
        ids, size = known.ids[spans(two.ravel(), size.ravel())], size.sum(1)
        raw = ids[spans((np.cumsum(size) - size)[of_chunk], size[of_chunk])].tobytes()
        edges = (np.concatenate([[0], np.cumsum(size[of_chunk])])[until] * self.dtype.itemsize).tolist()
        return [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        plain = [None if not self.known or "<|" in t or self.odd(t) else t.lower() for t in texts]
        out: list[bytes] = []
        for group in groups_of([len(t) for t in texts], CUT_CHARS):
            if self.words.full:
                self.before, self.words = self.words, self.none
            out += self._cut([plain[i] for i in group])
        return [(self._whole(t) if p is None else x) + self.end for t, p, x in zip(texts, plain, out, strict=True)]


def groups_of(sizes: list[int], most: int) -> Iterator[range]:
    """Places that follow each other, of ``most`` in sum, or one."""
    first, n = 0, 0
    for i, x in enumerate(sizes):
        if i > first and n + x > most:
            yield range(first, i)
            first, n = i, 0
        n += x
    if sizes:
        yield range(first, len(sizes))


def encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder for a worker process."""
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordEncoder(path, end_id)
    return _TOKENIZERS[path, end_id]


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row of ids for each document, with its offset in its (partition, queue); see TOKENS_SCHEMA."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path, end_id), TaskContext.get().partitionId(), {}
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                ids = enc.encode(b.column(1).to_pylist())
                queues = b.column(2).to_pylist()
                starts, counts = [], []
                for q, x in zip(queues, ids, strict=True):
                    n = len(x) // enc.dtype.itemsize
                    starts.append(at.get(q, 0))
                    counts.append(n)
                    at[q] = starts[-1] + n
                yield pa.record_batch(
                    [b.column(0), b.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "local_start", "doc_tokens", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("queue")).mapInArrow(run, TOKENS_SCHEMA)


class Schedule:
    """How many tokens of each queue the first x tokens of the schedule hold."""

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        self.totals = np.array(totals, np.int64)
        w = np.array(totals if weights is None else weights, np.float64)
        self.w = np.where(self.totals > 0, np.maximum(w, 1e-12), 1.0)
        self.total = int(self.totals.sum())

    @cached_property
    def ends(self) -> np.ndarray:
        return np.unique(np.concatenate([[0.0], self.totals / self.w]))

    @cached_property
    def at(self) -> np.ndarray:
        return np.array([np.minimum(self.totals, e * self.w).sum() for e in self.ends])

    def upto(self, t: float) -> np.ndarray:
        """How many tokens of each queue have a virtual time of ``t`` or less."""
        c = np.clip(np.floor(t * self.w + 0.5), 0, self.totals).astype(np.int64)
        c += (c < self.totals) & ((c + 0.5) / self.w <= t)
        return c - ((c > 0) & ((c - 0.5) / self.w > t))

    def key(self, x: int) -> tuple[float, int]:
        """(virtual time, queue) of the token of rank ``x`` < total."""
        bits = lambda t: int(np.float64(t).view(np.int64))
        time = lambda b: float(np.int64(b).view(np.float64))
        # positive numbers have the order of their bits
        lo, hi = 0, bits((self.totals / self.w).max())
        while hi - lo > 1:
            m = (lo + hi) // 2
            lo, hi = (m, hi) if self.upto(time(m)).sum() <= x else (lo, m)
        before, until = self.upto(time(lo)), self.upto(time(hi))
        return time(hi), int(np.flatnonzero(until > before)[x - int(before.sum())])

    def served(self, x: np.ndarray) -> np.ndarray:
        """(len(x), queues) counts; row i sums to min(x[i], total). A function of each x alone, so all tasks agree."""
        x = np.clip(np.asarray(x, np.int64), 0, self.total)
        level = np.interp(x, self.at, self.ends)[:, None]
        c = np.minimum(self.totals, np.floor(level * self.w + 0.5).astype(np.int64))
        rows = np.arange(len(x))
        short = x - c.sum(1)
        while (short > 0).any():
            nxt = np.where(c < self.totals, (c + 0.5) / self.w, np.inf)
            c[rows, nxt.argmin(1)] += short > 0
            short -= short > 0
        while (short < 0).any():
            last = np.where(c > 0, (c - 0.5) / self.w, -np.inf)
            c[rows, last.shape[1] - 1 - last[:, ::-1].argmax(1)] -= short < 0
            short += short < 0
        return c


def cut(starts: np.ndarray, counts: np.ndarray, q: int, plan: Schedule, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents of queue q: document's place in the input, start, length, window, offset."""
    lo, hi = int(starts.min()), int((starts + counts).max())

    def window_of(p: int) -> int:
        """The window that holds token p of queue q, by bisection on its monotone count."""
        a, b = 0, -(-plan.total // size)
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if plan.served(np.array([m * size]))[0, q] <= p else (a, m)
        return a

    first, last = window_of(lo), window_of(hi - 1)
    found = []
    for k in range(first, last + 1, 4096):
        ks = np.arange(k, min(k + 4096, last + 1) + 1)
        c = plan.served(ks * size)
        edge, before = c[:, q], np.diff(c, axis=0)[:, :q].sum(1)
        s, e = np.maximum(starts, edge[0]), np.minimum(starts + counts, edge[-1])
        live = np.flatnonzero(s < e)
        if not len(live):
            continue
        w0 = np.searchsorted(edge, s[live], "right") - 1
        w1 = np.searchsorted(edge, e[live] - 1, "right") - 1
        n = w1 - w0 + 1
        doc = np.repeat(live, n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w0, n)
        begin, end = np.maximum(s[doc], edge[w]), np.minimum(e[doc], edge[w + 1])
        ok = begin < end
        doc, w, begin, end = doc[ok], w[ok], begin[ok], end[ok]
        found.append((doc, begin - starts[doc], end - begin, ks[w], before[w] + begin - edge[w]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cut_by_blocks(placed: DataFrame, names: list[str | None], plan: Schedule, window: int, wide: np.dtype, with_ids: bool, block: int) -> DataFrame:
    """Pieces of ``placed`` (doc_id, queue, start, doc_tokens, ids) for any number of queues."""
    context, size = placed.sparkSession.sparkContext, window * block
    shared = context.broadcast((plan, {x: i for i, x in enumerate(names)}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value[0].key(i * size) for i in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([t for t, _ in found], pa.float64()), pa.array([s for _, s in found], pa.int64())], names=["t", "s"])

    firsts = placed.sparkSession.range(1, max(1, -(-plan.total // size))).mapInArrow(find, "t double, s long").collect()
    # complex numbers have the order of (time, queue)
    edges = context.broadcast(np.sort(np.array([complex(r.t, r.s) for r in firsts], np.complex128)))

    def runs(*of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places and lengths of the runs in which none of the arrays changes."""
        first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in of], axis=0)])
        return first, np.diff(np.r_[first, len(of[0])])

    def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in the row of each token."""
        return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, place = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                q = np.array([place[x] for x in b.column(1).to_pylist()])
                starts, counts = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                doc, at = spread(counts)
                blocks = np.searchsorted(edges.value, (starts[doc] + at + 0.5) / plan.w[q[doc]] + 1j * q[doc], "right")
                first, n = runs(doc, blocks)
                d, a, k = doc[first], at[first], wide.itemsize
                raws = b.column(4).to_pylist()
                ids = [raws[x][k * y : k * (y + z)] for x, y, z in zip(d.tolist(), a.tolist(), n.tolist(), strict=True)]
                taken = pa.array(d)
                yield pa.record_batch(
                    [pa.array(blocks[first].astype(np.int64)), pa.array(q[d].astype(np.int64)), pa.array(starts[d] + a), pa.array(a), b.column(0).take(taken), b.column(3).take(taken), b.column(1).take(taken), pa.array(ids, pa.binary())],
                    names=["block", "s", "token", "start", "doc_id", "doc_tokens", "queue", "ids"],
                )

    def place_block(t: pa.Table) -> pa.Table:
        t = t.sort_by([("s", "ascending"), ("token", "ascending")]).combine_chunks()
        s, token, start = (t.column(x).to_numpy() for x in ("s", "token", "start"))
        ids = [np.frombuffer(x, wide) for x in t.column("ids").to_pylist()]
        row, at = spread(np.array([len(x) for x in ids]))
        win, place = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        win[np.lexsort((s[row], (token[row] + at + 0.5) / shared.value[0].w[s[row]]))] = np.arange(len(row)) // window
        place[np.argsort(win, kind="stable")] = np.arange(len(row))
        first, n = runs(row, win)
        r, a, w = row[first], at[first], win[first]
        pieces = [ids[x][y : y + z].astype("<u4").tobytes() for x, y, z in zip(r.tolist(), a.tolist(), n.tolist(), strict=True)]
        taken = pa.array(r)
        of = {
            "doc_id": t.column("doc_id").take(taken), "start": pa.array(start[r] + a), "length": pa.array(n), "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
            "doc_tokens": t.column("doc_tokens").take(taken), "sequence_id": pa.array(t.column("block")[0].as_py() * block + w), "offset": pa.array(place[first] - w * window),
            "queue": t.column("queue").take(taken), "ids": pa.array(pieces if with_ids else [None] * len(pieces), pa.binary()),
        }
        return pa.table(of)

    cut_up = placed.mapInArrow(slices, "block long, s long, token long, start long, doc_id long, doc_tokens long, queue string, ids binary")
    return cut_up.groupBy("block").applyInArrow(place_block, PIECE_SCHEMA)


def pack(docs: DataFrame, window: int = WINDOW_TOKENS, weights: dict[str, float] | None = None, path: str | None = None, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of all documents (PIECE_SCHEMA). Only the last window can be short; all else is full, without padding.

    weights: target share of each source; null takes the corpus' own shares, with which all queues drain together.
    """
    tokens = written(tokenize(docs, path, end_id, id_col, text_col, source_col), "tokens")
    sums = tokens.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sums.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    totals = sorted(((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    names = [r[0] for r in totals]
    plan = Schedule([r[1] for r in totals], None if weights is None else [weights.get(x, 0.0) for x in names])
    wide = np.dtype("<u2" if encoder(path or default_tokenizer(), end_id).dtype.itemsize == 2 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(names)}
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                q = np.array([place[x] for x in b.column(1).to_pylist()])
                starts = b.column(2).to_numpy(zero_copy_only=False)
                counts = b.column(3).to_numpy(zero_copy_only=False)
                ids = [np.frombuffer(x.as_buffer(), wide) for x in b.column(4)]
                for one in np.unique(q):
                    rows = np.flatnonzero(q == one)
                    doc, start, length, seq, offset = cut(starts[rows], counts[rows], int(one), plan, window)
                    order = np.lexsort((start, doc))
                    doc, start, length, seq, offset = rows[doc[order]], start[order], length[order], seq[order], offset[order]
                    pieces = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                    yield pa.record_batch(
                        [
                            b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                            pa.array(counts[doc]), pa.array(seq), pa.array(offset), b.column(1).take(pa.array(doc)), pa.array(pieces if with_ids else [None] * len(pieces), pa.binary()),
                        ],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"],
                    )

    placed = tokens.join(bases.withColumnsRenamed({"part": "b_part", "queue": "b_queue"}), (F.col("part") == F.col("b_part")) & F.col("queue").eqNullSafe(F.col("b_queue")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("local_start")).alias("start"), "doc_tokens", "ids")
    if len(names) > MAX_QUEUES:
        return cut_by_blocks(placed, names, plan, window, wide, with_ids, BLOCK)
    return placed.mapInArrow(run, PIECE_SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then the piece's queue."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
