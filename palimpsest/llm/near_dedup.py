"""Near-duplicate detection: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation, components.

A signature is CHUNKS * WIDTH symbols of BITS bits, each bits of a minimum over the document's shingles. Two of them at
distance <= CHUNKS * (ERRORS + 1) - 1 symbols have, by the pigeonhole principle, a chunk with at most ERRORS wrong
symbols; every chunk is therefore indexed once for each choice of ERRORS of its symbols left out. All pairs under the
threshold of 15 of 40 symbols meet in an index entry; two documents of similarity 0.85 differ in 6 on average, and meet
in no entry with probability 5e-7 (at 0.8: 2e-5).

Large groups: an entry (key) with g members is not expanded into its g * g / 2 pairs. First the pairs of each entry's
members with its smallest one and the pairs of neighbours in the order of the signatures are confirmed, both linear in g;
the links found are contracted into components, which takes groups of copies together. What is left to look at are pairs
of an entry in different components. A document takes part only if enough of its shingles occur in other components: a
link needs SIMILARITY percent of its shingles there. That bound is exact and linear in the shingles. The rest of an entry
is dealt into blocks of bounded size, every pair of blocks is one group of rows, its pairs are compared inside the task,
by size, by the shingles that both can share at most and then by their sets, and only links leave it. A pair that meets in
several entries is compared in the first. No pair is left out for being unlikely.

Nothing here that grows with the corpus is broadcast, as the driver would have to hold it.

Sets are of 64-bit hashes of whole shingles: of two texts of n shingles together some two shingles are taken for one with
probability n * n / 2**65.

Defined results: equal word sequences form one class before any comparison. A null, empty or white text has no
shingles and is alone. Texts of any length are compared whole. Rows with the same id are compared like any others and
each returns its row; a null id has component_id of the smallest id that it reaches, or null. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import discard, fresh, shuffled, table, written

SHINGLE_WORDS = 5
SIMILARITY = 80
CHUNKS, WIDTH, ERRORS, BITS = 8, 5, 1, 11
#: A block of an entry's members holds so many of them, or so many bytes of their sets, on average.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Bytes of sets after which a worker hands on a batch of them.
BATCH_BYTES = 4 << 20
#: Columns of the matrices with which two blocks are compared.
COLUMNS = 1 << 12
SEED = 20_240_601
#: Words of a worker whose hashes are kept; the cache starts anew beyond it.
CACHE_WORDS = 150_000

SKETCH_SCHEMA = "doc_id long, text_hash long, fp binary, n_shingles long, sig array<int>"


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z) text: runs without blank, tab, LF, VT, FF and CR."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], k: int) -> set:
    """Distinct k-word shingles; of fewer words the whole sequence; of none nothing."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class Sketcher:
    def __init__(self, k: int, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = CHUNKS * WIDTH
        self.k = k
        self.mul = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.weights = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.kept: dict[bytes, bytes] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """The set of shingles: sorted distinct 64-bit hashes; none without words."""
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.k:
            return np.array([int.from_bytes(hashlib.blake2b(b" ".join(words) + b" short", digest_size=8).digest(), "little")], np.uint64)
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        kept = self.kept
        for w in set(words).difference(kept):
            kept[w] = hashlib.blake2b(w, digest_size=8).digest()
        h = np.frombuffer(b"".join(map(kept.__getitem__, words)), np.uint64)
        n = len(h) - self.k + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(self.k):
            mixed += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(31))) * self.weights[i]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)

    def sketch(self, text: str | None) -> tuple[bytes, int, list[int] | None]:
        """Fingerprint of the word sequence, number of distinct shingles, signature (null without words)."""
        words = words_of(text)
        fp = fingerprint(words)
        hashes = self.hashes(words)
        if not len(hashes):
            return fp, 0, None
        low = hashes.astype(np.uint32)
        least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 4096):
            np.minimum(least, (low[i : i + 4096, None] * self.mul + self.add).min(0), out=least)
        least *= np.uint32(0x9E3779B1)
        return fp, len(hashes), (least >> np.uint32(32 - BITS)).tolist()


def fingerprint(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SKETCH_SCHEMA for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(k)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                made = [maker.sketch(t.as_py()) for t in b.column(2)]
                yield pa.record_batch(
                    [b.column(0), b.column(1), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.list_(pa.int32()))],
                    names=["doc_id", "text_hash", "fp", "n_shingles", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, SKETCH_SCHEMA)


def hashed(texts: pa.Array, maker: Sketcher) -> Iterator[pa.RecordBatch]:
    """(fp, hashes) of each text. Words as Python objects take many times the bytes of their text, and sets about as many
    as it: the words of one text at a time are held, and the sets of a batch of bounded bytes."""
    fps, sets, size = [], [], 0
    for i, t in enumerate(texts):
        words = words_of(t.as_py())
        fps.append(fingerprint(words))
        sets.append(maker.hashes(words).tobytes())
        size += len(sets[-1])
        if size >= BATCH_BYTES or i == len(texts) - 1:
            yield pa.record_batch([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "hashes"])
            fps, sets, size = [], [], 0


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the ``wanted`` (node, class_id). Ids can repeat or be null, so the words decide the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(k)
        for b in batches:
            yield from hashed(b.column(0), maker)

    ids = wanted.select("class_id").distinct()
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(shuffled(ids), F.col("id").eqNullSafe(F.col("class_id")), "left_semi")
    of_node = some.select("text").mapInArrow(run, "fp binary, hashes binary").select(F.xxhash64("fp").alias("node"), "hashes")
    return of_node.join(shuffled(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])


def index_entries(classes: DataFrame) -> DataFrame:
    """(key, slot, node): for each chunk, each choice of a symbol left out; the slot says which."""
    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            kept = [F.col("sig")[c * WIDTH + j] for j in range(WIDTH) if j != out]
            keys.append(F.xxhash64(F.lit(c * WIDTH + out), *kept))
    return classes.where("sig is not null").select("node", F.posexplode(F.array(*keys)).alias("slot", "key"))


def neighbours(members: DataFrame) -> DataFrame:
    """(a, b): nodes that follow each other in the order of an entry's signatures. Entries are cut where sorted ranges of
    rows end, so that none has to fit a task; what is missed there is for the later rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            key, node = (b.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                key, node = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node])
            if len(key):
                last = key[-1], node[-1]
            same = (key[1:] == key[:-1]) & (node[1:] != node[:-1])
            x, y = node[1:][same], node[:-1][same]
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    # each entry begins its order at another symbol; ranges are told by its first ones, as the driver samples them
    turn = F.pmod("key", F.lit(CHUNKS * WIDTH)).cast("int")
    order = F.concat(F.slice("sig", turn + 1, F.lit(CHUNKS * WIDTH)), F.slice("sig", F.lit(1), turn))
    keyed = members.select("key", "node", order.alias("order")).repartitionByRange("key", F.slice("order", 1, WIDTH), "node").sortWithinPartitions("key", "order", "node")
    return keyed.select("key", "node").mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union of their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                ok = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = 0
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(shuffled(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a"))), "a")
    return with_a.join(shuffled(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b"))), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def first_slots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y): the first slot in which two signatures meet, -1 where they do not."""
    out = np.full((len(x), len(y)), -1, np.int16)
    for c in reversed(range(CHUNKS)):
        wrong, place = np.zeros(out.shape, np.int8), np.zeros(out.shape, np.int8)
        for j in reversed(range(WIDTH)):
            differs = x[:, None, c * WIDTH + j] != y[None, :, c * WIDTH + j]
            wrong += differs
            place[differs] = j
        near = wrong <= ERRORS
        out[near] = place[near] + c * WIDTH
    return out


def candidates(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group of rows (an entry's two blocks, or one with itself): places of each block's rows, and which pairs are to
    be compared here."""
    side = t.column("side").to_numpy()
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = t.column("one")[0].as_py() == t.column("other")[0].as_py()
    y = x if alone else y
    comp, n, out = (t.column(c).to_numpy() for c in ("comp", "n_shingles", "outside"))
    sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    low, high = np.minimum(n[x, None], n[y]), np.maximum(n[x, None], n[y])
    # both sets share what they have outside at most, and a link needs so much
    near = (comp[x, None] != comp[y]) & (100 * low >= percent * high) & ((100 + percent) * np.minimum(out[x, None], out[y]) >= percent * (low + high))
    if alone:
        near &= np.arange(len(x))[:, None] < np.arange(len(x))
    if near.any():
        near &= first_slots(sig[x], sig[y]) == t.column("slot")[0].as_py()
    return x, y, near


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)) sizes of intersections, by products of 0/1 matrices of bounded width."""
    sizes = [len(h) for h in (*x, *y)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    some = times[column] > 1
    row, column = row[some], (np.cumsum(times > 1) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        m = np.zeros((len(sizes), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - begin] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out.astype(np.int64)


def grouped(members: DataFrame) -> GroupedData:
    """By pairs of blocks. Comparing costs more than the rows' bytes tell, so the partitions' number is not left to them."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, "key", "one", "other").groupBy("key", "one", "other")


def involved(members: DataFrame, percent: int) -> DataFrame:
    """The rows of each group that have a pair to compare."""

    def run(t: pa.Table) -> pa.Table:
        x, y, near = candidates(t, percent)
        return t.take(pa.array(np.unique(np.concatenate([x[near.any(1)], y[near.any(0)]]))))

    return grouped(members).applyInArrow(run, members.schema)


def links_of(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links between different components within each group."""

    def run(t: pa.Table) -> pa.Table:
        x, y, near = candidates(t, percent)
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in t.column("hashes")]
        n, node = t.column("n_shingles").to_numpy(), t.column("node").to_numpy()
        both = shared_counts([sets[i] for i in x], [sets[i] for i in y])
        i, j = np.nonzero(near & (both > 0) & (100 * both >= percent * (n[x, None] + n[y] - both)))
        return pa.table({"a": np.minimum(node[x[i]], node[y[j]]), "b": np.maximum(node[x[i]], node[y[j]])})

    return grouped(members).applyInArrow(run, "a long, b long")


def in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (key, n_shingles, outside, ...) once for each pair of blocks that they are in: one <= other, and the
    row's side. Entries of two members that cannot link are left out here."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
    can = (100 * F.min("n_shingles") >= percent * F.max("n_shingles")) & ((100 + percent) * F.min("outside") >= percent * F.sum("n_shingles"))
    count = members.groupBy("key").agg(blocks.alias("blocks"), ((F.count("*") > 2) | can).alias("can")).where("can").drop("can")
    dealt = members.join(shuffled(count), "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"one": F.least("own", "with"), "other": F.greatest("own", "with"), "side": (F.col("own") > F.col("with")).cast("int")}).drop("own", "with", "blocks")


def spanning(members: DataFrame) -> DataFrame:
    """``members`` (key, comp, ...) of the entries that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return members.join(shuffled(keys), "key")


def outside(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, outside): how many of a node's shingles occur in other components, of ``nodes`` (node, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column(2)[i].as_buffer(), np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), b.column(k)[i].as_py())) for k in (0, 1)] + [pa.array(h)], names=["node", "comp", "h"])

    each = nodes.join(shuffled(sets), "node").select("node", "comp", "hashes").mapInArrow(run, "node long, comp long, h long")
    shared = each.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    return each.join(shuffled(shared), "h").groupBy("node").agg(F.count("*").alias("outside"))


def signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b): comp is the smallest node it reaches.

    Alternates large and small stars, which join a component of n nodes in O(log n) rounds.
    """
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    before = signature(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        root = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(shuffled(root), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(shuffled(low), "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        after = written(small, "links")
        discard(edges)
        if (now := signature(after)) == before:
            found = written(after.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(after.select(F.col("lo").alias("node"), F.col("lo").alias("comp"))).distinct(), "components")
            discard(after)
            return found
        edges, before = after, now


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept, class_id (smallest id of equal words),
    text_hash, node (of its component; of all rows without shingles the same)."""
    rows = written(sketches(docs, k, id_col, text_col), "sketches")
    # a node is a class of equal word sequences, named by a hash of its fingerprint
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.withColumn("node", F.xxhash64("fp")), "classes")
    entries = index_entries(classes)
    shared = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("key", "first")
    open_ = written(entries.join(shuffled(shared), "key").select("key", "slot", "node", "first"), "entries")
    wanted = classes.join(shuffled(open_.select("node").distinct()), "node", "left_semi").select("node", "class_id")
    sets = written(sets_of(docs, wanted, k, id_col, text_col), "sets")
    own = shuffled(classes.select("node", "n_shingles", "sig"))

    stars = open_.where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    tested = stars.unionByName(neighbours(open_.join(own, "node"))).distinct()
    comps = components(confirm(tested, sets, percent))

    placed = open_.join(shuffled(comps), "node", "left").select("key", "slot", "node", F.coalesce("comp", "node").alias("comp"))
    left = written(spanning(placed), "left")
    reach = outside(left.select("node", "comp").distinct(), sets)
    enough = written(reach.join(own, "node").where(100 * F.col("outside") >= percent * F.col("n_shingles")).select("node", "outside", "n_shingles", "sig"), "enough")
    members = in_blocks(spanning(left.join(shuffled(enough.select("node", "outside", "n_shingles")), "node")), percent)
    with_sig = written(involved(members.join(shuffled(enough.select("node", "sig")), "node"), percent), "members")
    found = written(links_of(with_sig.join(shuffled(sets), "node"), percent).distinct(), "confirmed")
    if not found.isEmpty():
        # the links between components, contracted
        of = lambda side: shuffled(comps.select(F.col("node").alias(side), F.col("comp").alias(f"c_{side}")))
        ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        above = shuffled(components(ends).select(F.col("node").alias("under"), F.col("comp").alias("over")))
        moved = comps.unionByName(above.join(shuffled(comps), F.col("under") == F.col("node"), "left_anti").select(F.col("under").alias("node"), F.col("under").alias("comp")))
        comps = written(moved.join(above, F.col("comp") == F.col("under"), "left").select("node", F.coalesce("over", "comp").alias("comp")), "components")
    discard(open_, sets, left, enough, with_sig, found)

    of_node = classes.select("node", "fp", "class_id").join(shuffled(comps), "node", "left").select("fp", "class_id", F.coalesce("comp", "node").alias("comp"))
    least = of_node.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    of_fp = of_node.join(shuffled(least), "comp").select(F.col("fp").alias("class_fp"), "class_id", "component_id", "comp")
    alone = F.col("n_shingles") == 0
    joined = rows.select("doc_id", "text_hash", "fp", "n_shingles").join(shuffled(of_fp), F.col("fp") == F.col("class_fp"))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "text_hash", F.col("comp").alias("node"),
    )


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, its columns unchanged: of the rows with the kept id, or without ids in a
    group of none, one of those with the smallest hash of the text."""
    name, text_hash = fresh(docs, "kept_id", "kept_hash")
    kept = near_duplicates(docs, k, percent, id_col, text_col).where("kept").groupBy("node", (F.col("n_shingles") == 0).alias("alone"), F.col("doc_id").alias(name), F.col("text_hash").alias(text_hash))
    kept = written(kept.agg(F.count("*").alias("n")), "candidates")
    one = kept.where("not alone").groupBy("node").agg(F.min_by(F.struct(name, text_hash, "n"), text_hash).alias("one")).select("one.*")
    kept = written(one.unionByName(kept.where("alone").select(name, text_hash, "n")), "kept")
    # only rows that repeat have to be gathered to keep one of each
    once, more = kept.where("n = 1").drop("n"), written(kept.where("n > 1").drop("n"), "repeated")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(text_hash))
    return docs.join(shuffled(once, kept.count()), same, "left_semi").unionByName(docs.join(shuffled(more, more.count()), same, "left_semi").dropDuplicates([id_col, text_col]))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 3-word shingles, 85 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_hash", "node")


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
SQL: dict[str, str] = {}
