"""Queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from . import bpe, chat, jaccard, langid, mixing, quality, secrets, suffixes, topk, warc

_MODULES = (quality, chat, secrets, bpe, topk, warc, langid, jaccard, suffixes, mixing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
