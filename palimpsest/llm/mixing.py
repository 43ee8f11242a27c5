"""Mixing sources to target weights by hierarchical budgeting over a domain > language > source tree.

Native DataFrame operations only. A token budget enters at the root. At each node it is divided among the children in
proportion to their weights; a child whose leaves cannot hold its share (leaf capacity: tokens * MAX_EPOCHS) is filled,
and what it cannot take goes to its siblings by their weights. Only what no child of a node can hold goes to the
siblings of that node. Budgets are whole tokens and add up exactly.

A leaf with budget b and T tokens takes b // T whole epochs and, of the next, the prefix of b % T tokens in the order
md5(seed:epoch:id), id, length. The prefix's end is found by histograms over hash digits, so no leaf is ever sorted:
only the rows of one hash cell (a 4096th of the leaf) meet in one window.

Defined results: a null or empty domain, language or source is the child named ''. A null or white text has no tokens
and is not selected. Rows that repeat the id and length of the prefix's last document are taken with it. Without rows
or with budget 0 nothing is selected. Columns that clash with those added are kept; the added ones get a leading "_".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import fresh, table, written

MAX_EPOCHS = 4
SEED = 7
DIGITS = 3
LEVELS = ("m_domain", "m_lang", "m_source")
#: What is no white space for the token count.
TOKEN = r"[^ \t\n\x0B\f\r]+"
#: Target weights of the languages; others count 1.
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def domain_of(source: Column) -> Column:
    """The documents table names no domain; sources fall into four by the first digit of their md5."""
    return F.concat(F.lit("d"), (F.ascii(F.substring(F.md5(source), 1, 1)) % 4).cast("string"))


def keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None) -> DataFrame:
    """``docs`` with the leaf's names, m_id and m_tokens, rows without tokens left out."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "m_domain": F.coalesce(domain, F.lit("")) if domain is not None else domain_of(source),
            "m_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
            "m_source": source,
            "m_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            "m_tokens": F.coalesce(F.regexp_count(text_col, F.lit(TOKEN)), F.lit(0)).cast("long"),
        }
    ).where("m_tokens > 0")


def divide(joined: DataFrame, on: list[str], name: str) -> DataFrame:
    """children (on..., name, w, cap, their parent's budget) to children (on..., name) with budgets of their own.

    With children in the order of cap / w, the filled ones come first; the first that is not filled sets the level.
    """
    order = Window.partitionBy(*on).orderBy(F.col("cap") / F.col("w"), name)
    all_ = Window.partitionBy(*on)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = joined.withColumns({"rn": F.row_number().over(order), "level": (F.col("budget") - before) / weight})
    open_ = F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("rn", "level"))
    shared = levelled.withColumn("at", F.min(open_).over(all_)).withColumn("whole", F.coalesce(F.least("cap", F.floor(F.col("at.level") * F.col("w"))), F.col("cap")))
    spare = F.row_number().over(Window.partitionBy(*on).orderBy((F.col("cap") <= F.col("whole")).cast("int"), name))
    left = shared.withColumns({"left": F.col("budget") - F.sum("whole").over(all_), "turn": spare})
    one = ((F.col("turn") <= F.col("left")) & (F.col("cap") > F.col("whole"))).cast("long")
    return left.select(*on, name, (F.col("whole") + one).cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: dict[str, Column]) -> DataFrame:
    """leaves (LEVELS, total) to (LEVELS, total, budget)."""
    caps = leaves.select(*LEVELS, "total", (F.col("total") * max_epochs).alias("cap"))
    at_root = min(budget, caps.agg(F.sum("cap")).first()[0] or 0)
    parents = None
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        children = caps.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weights[name].cast("double")).where("w > 0")
        under = children.withColumn("budget", F.lit(at_root).cast("long")) if parents is None else children.join(parents, keys[:-1])
        parents = divide(under, keys[:-1], name)
    return caps.join(parents, list(LEVELS)).select(*LEVELS, "total", "budget")


def rank_of(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("m_id")))


def with_cuts(narrow: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """budgets with whole epochs, the prefix's tokens and the rank, id, length and taken tokens of its last row."""
    split = budgets.select(*LEVELS, "budget", F.expr("budget div total").cast("int").alias("epochs"), (F.col("budget") % F.col("total")).alias("rest"))
    partial = written(split.where("rest > 0"), "partial")
    ranked = narrow.join(partial, list(LEVELS)).withColumn("m_rank", rank_of(seed, F.col("epochs")))
    cells = written(ranked.groupBy(*LEVELS, F.substring("m_rank", 1, DIGITS).alias("cell")).agg(F.sum("m_tokens").alias("n")), "cells")
    at = partial.select(*LEVELS, "rest", F.lit("").alias("at"), F.lit(0).cast("long").alias("base"))
    for digits in range(1, DIGITS + 1):
        inside = cells.join(at, list(LEVELS)).where(F.col("cell").startswith(F.col("at")))
        sums = inside.groupBy(*LEVELS, "rest", "base", F.substring("cell", 1, digits).alias("at")).agg(F.sum("n").alias("n"))
        run = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("at")) + F.col("base")
        at = sums.withColumn("run", run).where("run >= rest and run - n < rest").select(*LEVELS, "rest", "at", (F.col("run") - F.col("n")).alias("base"))
    last = ranked.drop("rest").join(written(at, "crossing"), list(LEVELS)).where(F.substring("m_rank", 1, DIGITS) == F.col("at"))
    order = Window.partitionBy(*LEVELS).orderBy("m_rank", "m_id", "m_tokens").rowsBetween(Window.unboundedPreceding, 0)
    run = last.withColumn("end", F.sum("m_tokens").over(order) + F.col("base"))
    cut = run.where("end >= rest and end - m_tokens < rest").select(*LEVELS, F.struct("m_rank", "m_id", "m_tokens").alias("cut"), (F.col("rest") - F.col("end") + F.col("m_tokens")).alias("last_take"))
    return split.join(cut, list(LEVELS), "left")


def select_by(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` once for each epoch that selects them, with m_epoch and m_take (tokens of the text that count)."""
    joined = rows.join(plan, list(LEVELS))
    key = F.struct(rank_of(seed, F.col("epochs")).alias("m_rank"), "m_id", "m_tokens")
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    chosen = F.when(key <= F.col("cut"), F.concat(whole, F.array("epochs"))).otherwise(whole)
    ends = (key == F.col("cut")) & (F.col("m_epoch") == F.col("epochs"))
    return joined.withColumn("m_epoch", F.explode(chosen)).withColumn("m_take", F.when(ends, F.col("last_take")).otherwise(F.col("m_tokens")))


def language_weight() -> Column:
    return reduce(lambda c, kv: c.when(F.col("m_lang") == kv[0], kv[1]), list(LANG_WEIGHTS.items())[1:], F.when(F.col("m_lang") == "en", LANG_WEIGHTS["en"])).otherwise(1)


def mix(
    docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: dict[str, Column] | None = None, domain: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``docs`` as selected, a row for each document and epoch, with epoch, tokens, take_tokens, domain and
    leaf_budget after its own columns. budget: tokens in all; null takes as many as there are."""
    (epoch, tokens, take, dom, leaf) = fresh(docs, "epoch", "tokens", "take_tokens", "domain", "leaf_budget")
    rows = keyed(docs, id_col, text_col, lang_col, source_col, domain)
    narrow = written(rows.select(*LEVELS, "m_id", "m_tokens"), "narrow")
    leaves = written(narrow.groupBy(*LEVELS).agg(F.sum("m_tokens").alias("total")), "leaves")
    if budget is None:
        budget = leaves.agg(F.sum("total")).first()[0] or 0
    weights = {"m_domain": F.lit(1), "m_lang": language_weight(), "m_source": F.lit(1)} | (weights or {})
    plan = written(with_cuts(narrow, leaf_budgets(leaves, budget, max_epochs, weights), seed), "plan")
    named = [F.col("m_epoch").alias(epoch), F.col("m_tokens").alias(tokens), F.col("m_take").alias(take), F.col("m_domain").alias(dom), F.col("budget").alias(leaf)]
    return select_by(rows, plan, seed).select(*[F.col(f"`{c}`") for c in docs.columns], *named)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and epoch: doc_id, lang, source, epoch, tokens, take_tokens, domain, leaf_budget."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")


QUERIES = {"op10_mixing": op10_mixing}


def _level(n: int, keys: list[str], weight: str) -> str:
    """SQL of one level: c{n} the children, b{n} their budgets."""
    on, name = keys[:-1], keys[-1]
    part = f"PARTITION BY {', '.join(on)}" if on else ""
    join = f"JOIN b{n - 1} USING ({', '.join(on)})" if on else "CROSS JOIN b0"
    k = ", ".join(keys)
    return f"""
c{n} AS (SELECT {k}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weight} AS DOUBLE) AS w FROM caps GROUP BY {k}),
l{n} AS (
  SELECT {k}, cap, w, budget, row_number() OVER ({part} ORDER BY cap / w, {name}) AS rn,
    (budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c{n} {join}
),
f{n} AS (SELECT *, CASE WHEN cap > level * w THEN rn END AS open_rn FROM l{n}),
g{n} AS (SELECT *, min(open_rn) OVER ({part}) AS first_rn FROM f{n}),
h{n} AS (SELECT *, max(CASE WHEN rn = first_rn THEN level END) OVER ({part}) AS share_level FROM g{n}),
w{n} AS (SELECT *, CASE WHEN share_level IS NULL THEN cap ELSE least(cap, CAST(floor(share_level * w) AS BIGINT)) END AS whole FROM h{n}),
t{n} AS (
  SELECT *, budget - sum(whole) OVER ({part}) AS spare, row_number() OVER ({part} ORDER BY CAST(cap <= whole AS INTEGER), {name}) AS turn
  FROM w{n}
),
b{n} AS (SELECT {k}, CAST(whole + CASE WHEN turn <= spare AND cap > whole THEN 1 ELSE 0 END AS BIGINT) AS budget FROM t{n})"""


SQL = {
    "op10_mixing": f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS m_lang, coalesce(source, '') AS m_source,
    'd' || CAST(ascii(substr(md5(coalesce(source, '')), 1, 1)) % 4 AS VARCHAR) AS m_domain, coalesce(CAST(doc_id AS VARCHAR), '') AS m_id,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens
  FROM documents
), docs AS (SELECT * FROM d WHERE tokens > 0),
caps AS (SELECT m_domain, m_lang, m_source, CAST(sum(tokens) AS BIGINT) AS total, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap FROM docs GROUP BY ALL),
b0 AS (SELECT CAST(least(sum(total), sum(cap)) AS BIGINT) AS budget FROM caps),
{_level(1, ["m_domain"], "1")},
{_level(2, ["m_domain", "m_lang"], "CASE m_lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
{_level(3, ["m_domain", "m_lang", "m_source"], "1")},
plan AS (SELECT m_domain, m_lang, m_source, total, budget, budget // total AS epochs, budget % total AS rest FROM caps JOIN b3 USING (m_domain, m_lang, m_source)),
ranked AS (
  SELECT *, sum(tokens) OVER (PARTITION BY m_domain, m_lang, m_source ORDER BY md5('{SEED}:' || CAST(epochs AS VARCHAR) || ':' || m_id), m_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS begins
  FROM docs JOIN plan USING (m_domain, m_lang, m_source)
),
taken AS (
  SELECT *, unnest(range(CAST(epochs AS BIGINT))) AS epoch, tokens AS take_tokens FROM ranked
  UNION ALL BY NAME
  SELECT *, epochs AS epoch, least(tokens, rest - begins) AS take_tokens FROM ranked WHERE begins < rest
)
SELECT doc_id, lang, source, CAST(epoch AS INTEGER) AS epoch, tokens, CAST(take_tokens AS BIGINT) AS take_tokens, m_domain AS domain, budget AS leaf_budget FROM taken
"""
}
