"""Document quality by hierarchical empirical Bayes.

A logistic classifier on surface features gives each text's evidence. Grouped aggregation sums the classifier's
probabilities over hosts and over the paths in them. A host's rate of good documents has a Beta prior around the rate
of all documents, a path's rate one around its host's posterior mean; the priors' strengths come from the between-site
variance (method of moments), so sparse sites shrink toward the level above and large ones speak for themselves. A
document's log odds are its classifier evidence plus the log odds of its path, relative to the corpus' rate.

Training takes a bounded sample of labelled rows: SAMPLE_ROWS of each label, by the smallest hash of the id. Features are
made where the texts lie; of the sample only they go to the driver. Counts and rates are of all rows, all texts are read
whole, once: evidence is written beside the columns that are asked for, and the rates are taken from it. A site's rate
counts the document itself like its others.

Defined results: a null text has the features of an empty one; null hosts or paths are a site of their own; without
labels of both kinds the classifier says 1/2 and nothing is rejected; repeated rows count and score each for
themselves; an empty table gives an empty result. Columns of docs with the names of added ones are not touched.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.sampling import bounded_sample, held_out
from palimpsest.session import fresh, table, written

SAMPLE_ROWS = 3000
#: A document of this probability of being good, or more, is kept.
KEEP = 0.3
#: What a site's rate can add to the log odds at most, and the least and largest prior strengths in documents.
SITE_LIMIT = 2.0
STRENGTH = (20.0, 10_000.0)
SEED = 17

SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
BANGS = re.compile(r"!!")


@lru_cache(1)
def alphabet() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters_of(text: str) -> int:
    return int(np.count_nonzero(alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]))


def features(text: str | None) -> list[float]:
    """Surface features, all bounded, none of them the length of the text in itself."""
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    lines = [x for x in text.split("\n") if x]
    raw = text.encode("utf-8", "surrogatepass")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = len(set(words))
    return [
        1.0,
        len(SYMBOLS.findall(text)) / chars * 10,
        upper / n * 3,
        repeats / n * 3,
        text.count("|") / n * 3,
        len(BANGS.findall(text)) / n * 3,
        distinct / n ** 0.9,
        min(len(zlib.compress(raw, 1)) / max(len(raw), 1), 1.2),
        letters_of(text) / chars,
        min(sum(map(len, words)) / n / 10, 3.0),
        1 - len(set(lines)) / max(len(lines), 1),
        min(n, 50) / 50,
    ]


class Classifier:
    """Logistic regression with a ridge, fitted by Newton steps."""

    def __init__(self, rows: list[tuple[tuple[float, ...], int]], ridge: float = 1.0):
        """rows: features and label; equal rows count once."""
        rows = sorted(set(rows))
        self.w: np.ndarray | None = None
        y = np.array([y for _, y in rows], float)
        if not len(y) or y.min() == y.max():
            return
        x = np.array([f for f, _ in rows])
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        self.mean[0], self.std[0] = 0, 1
        x = (x - self.mean) / self.std
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        w = np.zeros(x.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - y)) + penalty * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            w -= np.linalg.solve(h, g)
        self.w = w

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        """Evidence in favour of good, at even prior odds."""
        if self.w is None or not texts:
            return np.zeros(len(texts))
        return np.clip(((np.array([features(t) for t in texts]) - self.mean) / self.std) @ self.w, -12, 12)


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    if rows is not None:
        labels = labels.where(rows)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("stratum"))
    sample = bounded_sample(known, "stratum", SAMPLE_ROWS, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["stratum", "features"])

    some = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    found = some.join(sample, F.col("id_") == F.col("id")).select("stratum", "text").mapInArrow(run, "stratum int, features array<double>")
    return Classifier([(tuple(r.features), r.stratum) for r in found.collect()])


def with_evidence(docs: DataFrame, model: Classifier, text_col: str, name: str) -> DataFrame:
    """``docs`` with the classifier's log odds as last column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                yield pa.record_batch([*b.columns, pa.array(shared.value.log_odds(b.column(at).to_pylist()))], names=[*b.schema.names, name])

    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{columns}, `{name}` double")


def shrunk(sites: DataFrame, prior: Column) -> DataFrame:
    """sites (good, n, ...) with the posterior mean ``rate`` under a Beta prior around ``prior``; the strength is fitted.

    Weighted by n, a site's rate varies by the binomial variance of its n and the between-site variance tau2; the
    prior's strength is mean * (1 - mean) / tau2 - 1.
    """
    rate = F.col("good") / F.col("n")
    sums = sites.agg(F.sum("n"), F.sum(F.col("n") * F.pow(rate - prior, 2)), F.sum(F.col("n") * prior * (1 - prior)), F.count("*")).first()
    n, spread, within, sites_n = (float(x or 0) for x in sums)
    tau2 = max((spread - within * sites_n / max(n, 1.0)) / max(n, 1.0), 1e-9)
    strength = min(max(within / max(n, 1.0) / tau2 - 1, STRENGTH[0]), STRENGTH[1])
    return sites.withColumn("rate", (F.col("good") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength)))


def site_rates(evidence: DataFrame) -> tuple[DataFrame, float]:
    """evidence (host, path, e) to (host, path, host_rate, path_rate, path_n), and the rate of all rows."""
    p = 1 / (1 + F.exp(-F.col("e")))
    paths = written(evidence.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count("*").alias("n")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    base = float(total[0] / total[1]) if total[1] else 0.5
    base = min(max(base, 0.01), 0.99)
    hosts = shrunk(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), F.lit(base)).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    under = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    rates = shrunk(under, F.col("host_rate"))
    return written(rates.select("host", "path", "host_rate", F.col("rate").alias("path_rate"), F.col("n").alias("path_n")), "rates"), base


def logit(c: Column) -> Column:
    return F.log(c / (1 - c))


def judged(docs: DataFrame, model: Classifier, host: Column, path: Column, text_col: str, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` of docs with added columns, and the added columns' names."""
    names = dict(zip(("host", "path", "e"), fresh(docs, "q_host", "q_path", "q_evidence"), strict=True))
    sited = docs.withColumns({names["host"]: host.cast("string"), names["path"]: path.cast("string")})
    taken = with_evidence(sited, model, text_col, names["e"]).select(*[F.col(f"`{c}`") for c in [*columns, *names.values()]])
    evident = written(taken, "evidence")
    rates, base = site_rates(evident.select(*[F.col(names[k]).alias(k) for k in ("host", "path", "e")]))
    added = dict(zip(("host_rate", "path_rate", "path_n"), fresh(evident, "q_host_rate", "q_path_rate", "q_path_n"), strict=True))
    r_host, r_path = fresh(evident, "r_host", "r_path")
    rates = rates.withColumnsRenamed({"host": r_host, "path": r_path, **added})
    joined = evident.join(rates, F.col(names["host"]).eqNullSafe(F.col(r_host)) & F.col(names["path"]).eqNullSafe(F.col(r_path)), "left").drop(r_host, r_path)
    (score,) = fresh(joined, "q_score")
    site = F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), logit(F.col(added["path_rate"])) - F.lit(float(np.log(base / (1 - base))))))
    odds = F.col(names["e"]) + site
    out = joined.withColumn(score, 1 / (1 + F.exp(-odds)))
    return out, names | added | {"score": score}


def host_of(docs: DataFrame) -> Column:
    """The documents table names no URL: its source is the host, source and language the path."""
    return F.col("source")


def path_of(docs: DataFrame) -> Column:
    return F.concat_ws("/", F.lit(""), F.coalesce(F.col("lang"), F.lit("-")))


def drop_bad(docs: DataFrame, model: Classifier, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """``docs`` without those below ``keep``, its columns unchanged."""
    out, names = judged(docs, model, host_of(docs), path_of(docs), text_col, docs.columns)
    return out.where(F.col(names["score"]) >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score (probability of being good), kept, evidence, host_rate, path_rate, path_n."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    out, n = judged(docs.select("doc_id", "text", "source", "lang"), model, host_of(docs), path_of(docs), "text", ["doc_id"])
    score = F.col(n["score"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= KEEP).alias("kept"), F.col(n["e"]).alias("evidence"), F.col(n["host_rate"]).alias("host_rate"), F.col(n["path_rate"]).alias("path_rate"), F.col(n["path_n"]).alias("path_n"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
