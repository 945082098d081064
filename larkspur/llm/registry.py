"""Queries and SQL of the training-data operators."""

from larkspur.llm import jaccard_join, langid, line_dedup, mixing, packing, quality_model, quality_rules, substring_dedup, topk, warc_audit

MODULES = (line_dedup, jaccard_join, packing, substring_dedup, mixing, topk, quality_model, langid, quality_rules, warc_audit)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
