"""The queries of the training-data operators and the SQL of those that it can express."""

from __future__ import annotations

from palimpsest.llm import extraction, language_id, media, mixing, near_dedup, packing, quality, topk, toxicity, warc

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (toxicity, warc, extraction, language_id, quality, packing, topk, media, near_dedup, mixing):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
