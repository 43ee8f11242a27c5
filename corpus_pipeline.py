"""A training corpus from raw documents: quality, toxicity, near-duplicates, mixture, packing.

Each stage takes what the one before it kept, all of it. All but the last return the columns of documents.

Defined results: a null text has the features of an empty one and is never toxic; null and empty texts are no copies of
each other, hold no tokens and so end before the mixture. Rows that repeat an id or a text count and score each for
themselves until near-duplicates go; one row of each group stays, whatever its id. Texts of any length are read whole.
Null sources and languages are a site, a leaf and a queue of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import mixing, near_dedup, packing, quality, toxicity
from palimpsest.llm.sampling import held_out
from palimpsest.session import discard, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier takes for junk go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return quality.drop_bad(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score 0.7 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word similarity 0.8 or more stays."""
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, divided by the target weights; a document of several epochs is as many rows.

    Documents go on whole: the last one of a leaf's prefix may exceed the leaf's budget by all but one of its tokens.
    """
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens, with their ids' checksums."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned and iterative stages are not expressible in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
