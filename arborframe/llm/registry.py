"""Queries and SQL of this subpackage, gathered from its modules."""

from __future__ import annotations

from . import audit, bpe, codes, decontaminate, embeddings, lines, mtree, pii, quality, simhash, spans, toxicity, warc

MODULES = (quality, embeddings, pii, warc, lines, spans, simhash, toxicity, bpe, decontaminate, mtree, audit, codes)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
