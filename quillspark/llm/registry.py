"""The queries of this package by name, with their SQL where SQL can express them."""
from __future__ import annotations

from . import bpe, conversations, decontam, negatives, neardup, ngramjoin, packing, pii, quality, secrets, topk, toxicity, urls

MODULES = (bpe, packing, pii, ngramjoin, toxicity, quality, urls, topk, neardup, secrets, decontam, negatives, conversations)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
