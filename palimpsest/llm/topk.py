"""Exact top-k inner-product search by distributed histogram selection.

Queries go out in blocks of bounded bytes; every task scores its rows against the block. Round by round, each task
counts its scores in BINS equal cells of each query's current interval, the counts are summed over all tasks, and the
cell that holds the k-th score becomes the interval, until it is one integer wide: the k-th score itself. A last pass
keeps the scores not below it, at most k a task and query by (score descending, vec_id ascending), which loses nothing
of the first k; a global ranking breaks ties by vec_id.

Scores are exact integers: components become floor(SCALE * x). Where the bound of all scores is under 2**53 they are made
in doubles, under 2**62 in 64-bit integers, beyond in integers of any length (slow; scores outside a long are ranked as they
are and shown as the nearest long).

Defined results: vectors null, empty or with null or non-finite components take no part; only vectors of equal length, of
any length, are compared; a repeated row is a candidate of its own. Rows that share a query id are all asked (equal ones
once) and rank together under it; rows with the query's id are not its candidates; ties go to the smaller vec_id; null ids
take no part. An empty table gives no row. Vectors with a component
beyond the doubles after scaling take no part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import discard, table, written

K = 10
SCALE = 1024
EVERY = 100
BINS = 1024
#: Bytes of the query vectors that the driver sends out at a time.
BLOCK_BYTES = 1 << 20
#: Scores of a block that a task holds at a time.
SCORES = 1 << 21
LONG = (1 << 63) - 1
#: Decimal digits that no score exceeds.
DIGITS = 640


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): usable rows, with integer components as doubles."""
    x = F.col("x")
    scaled = lambda e: e * F.lit(float(scale))
    good = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(scaled(e)) < float("inf")))
    # doubles from 2**53 on are whole, and floor() ends with a long
    floor = lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e).cast("double")).otherwise(e)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(x.isNotNull()).where(good).select("id", F.transform("x", lambda e: floor(scaled(e))).alias("v"))


def matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the flat components."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def whole(x: np.ndarray, kind: type) -> np.ndarray:
    """Integer-valued doubles as integers."""
    return x.astype(np.int64) if kind is np.int64 else np.array([int(e) for e in x.ravel()], object).reshape(x.shape)


def products(v: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact scores; the queries' type says how: doubles, 64-bit integers or integers of any length."""
    if queries.dtype == np.float64:
        return (v @ queries.T).astype(np.int64)
    return whole(v, np.int64 if queries.dtype == np.int64 else object) @ queries.T


def scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores by row and query) of the rows with the queries' length."""
    dim = queries.shape[1]
    rows = max(1, SCORES // max(len(queries), 1))
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            b = whole.slice(i, rows)
            n, flat = matrix(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            fit = n == dim
            if fit.any():
                v = flat[np.repeat(fit, n)].reshape(-1, dim)
                yield ids[fit], products(v, queries)


def histogram_pass(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(q, cell, n): counts of cell = (score - low) // width, those at or above low; the top cell takes what lies above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ids), BINS), np.int64)
        base = np.arange(len(ids)) * BINS
        for own, s in scored(batches, vectors):
            cell = np.clip((s - low) // width, -1, BINS - 1).astype(np.int64)
            live = (cell >= 0) & (own[:, None] != ids)
            counts += np.bincount((cell + base)[live], minlength=counts.size).reshape(counts.shape)
        # cells below the one with this task's own k-th score cannot hold the k-th of all
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        q, cell = np.nonzero((counts > 0) & (above < k))
        yield pa.record_batch([pa.array(q), pa.array(cell), pa.array(counts[q, cell])], names=["q", "cell", "n"])

    return rows.mapInArrow(run, "q long, cell long, n long").groupBy("q", "cell").agg(F.sum("n").alias("n"))


def score_bound(vectors: np.ndarray, peak: float) -> int:
    """What no score of these queries exceeds."""
    return max((sum(abs(int(x)) for x in v) for v in vectors.tolist()), default=0) * int(peak) + 1


def thresholds(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, bound: int) -> np.ndarray:
    """Each query's k-th score; where there are fewer candidates, a bound below all scores."""
    kind = object if vectors.dtype == object else np.int64
    low = np.full(len(ids), -bound, kind)
    width = np.full(len(ids), -(-(2 * bound + 1) // BINS), kind)
    need = np.full(len(ids), k, np.int64)
    while True:
        found = histogram_pass(rows, ids, vectors, low, width, k).toPandas()
        counts = np.zeros((len(ids), BINS), np.int64)
        counts[found.q, found.cell] = found.n
        reach = counts[:, ::-1].cumsum(1)[:, ::-1]
        enough = reach >= need[:, None]
        cell = np.where(enough.any(1), BINS - 1 - enough[:, ::-1].argmax(1), 0)
        low = low + cell * width
        if (width == 1).all():
            return low
        # what lies above the cell counts in full from now on, in the top cell
        need = np.where(enough.any(1), need, k)
        width = np.maximum(1, -(-width // (BINS - 1)))


def last_pass(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, exact): exact orders scores outside a long. A task's first k of those not below the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pd.DataFrame | None = None
        for own, s in scored(batches, vectors):
            r, q = np.nonzero((s >= least) & (own[:, None] != ids))
            new = pd.DataFrame({"q": q, "vec_id": own[r], "score": s[r, q]})
            best = new if best is None else pd.concat([best, new])
            best = best.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
        if best is not None:
            # digits of one width, of which the larger number has the larger text
            exact = pa.array([str(10**DIGITS + x) if least.dtype == object else None for x in best.score.tolist()], pa.string())
            yield pa.record_batch([pa.array(ids[best.q.to_numpy()]), pa.array(best.vec_id.to_numpy()), pa.array([max(-LONG - 1, min(LONG, x)) for x in best.score.tolist()], pa.int64()), exact], names=["query_id", "vec_id", "score", "exact"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long, exact string")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).distinct()
    found = None
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.max(F.array_max(F.transform("v", F.abs))).alias("peak")).orderBy("d").collect()
    for dim, peak in sizes:
        same = written(asked.where(F.size("v") == dim), "queries")
        block, last = max(1, BLOCK_BYTES // (8 * dim)), None
        while True:
            after = F.lit(True) if last is None else (F.col("id") > last[0]) | ((F.col("id") == last[0]) & (F.col("v") > F.array(*map(F.lit, last[1]))))
            taken = same.where(after).orderBy("id", "v").limit(block).collect()
            if not taken:
                break
            last = taken[-1]
            ids, block_vectors = np.array([r.id for r in taken], np.int64), np.array([r.v for r in taken], np.float64)
            bound = score_bound(block_vectors, peak)
            if bound >= 1 << 53:
                block_vectors = whole(block_vectors, np.int64 if bound < 1 << 62 else object)
            least = thresholds(rows, ids, block_vectors, k, bound)
            found = written(last_pass(rows, ids, block_vectors, least, k), "best", found)
            if len(taken) < block:
                break
        discard(same)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_exact_top_k": op7_exact_top_k}
SQL = {
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
}
