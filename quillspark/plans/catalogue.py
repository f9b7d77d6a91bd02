"""Every query of the library by name, with the SQL that must give the same rows."""
from __future__ import annotations

from . import analysis_queries, corpus_queries, evidence_queries, serving_queries, text_queries, trend_queries

MODULES = (trend_queries, text_queries, analysis_queries, evidence_queries, serving_queries, corpus_queries)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
