"""Reachability over relationships and what follows from it: dead parts, shared dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, written


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) that the seeds reach, themselves included. edges: src, dst; seeds: node.

    A frontier join per step; each step's nodes are added to those seen, in the shared folder: for shallow graphs of any
    size.
    """
    seen = written(seeds.select("node").distinct(), "seen")
    first = frontier = seen
    while True:
        step = edges.join(frontier, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).where("node is not null").distinct()
        before, frontier = frontier, written(step.join(seen, "node", "left_anti"), "frontier")
        if before is not first:
            discard(before)
        if frontier.isEmpty():
            discard(frontier)
            return seen
        seen = written(frontier, "seen", onto=seen)


def reachable_by_source(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, node) for many small graphs at once: each source's graph in one task, 25,000 parts at most.

    edges: source, src, dst; seeds: source, node.
    """
    both = edges.select("source", F.col("src"), F.col("dst")).unionByName(seeds.select("source", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst")))

    def walk(pdf):
        import pandas as pd

        starts = pdf.loc[pdf.src.isna(), "dst"].tolist()
        out = pdf.loc[pdf.src.notna()].groupby("src")["dst"].agg(list).to_dict()
        seen, todo = set(), list(starts)
        while todo:
            node = todo.pop()
            if node is not None and node not in seen:
                seen.add(node)
                todo += out.get(node, ())
        return pd.DataFrame({"source": pdf["source"].iloc[0], "node": sorted(seen)})

    return both.groupBy("source").applyInPandas(walk, "source string, node string")


def dead_parts(parts: DataFrame, live: DataFrame, part: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Parts that nothing live reaches, under the prunable prefixes if any are given."""
    rest = parts.join(live.select(F.col("node").alias("node_")), F.col(part) == F.col("node_"), "left_anti")
    if prefixes:
        rest = rest.where(F.greatest(F.lit(False), *[F.col(part).startswith(p) for p in prefixes]))
    return rest
