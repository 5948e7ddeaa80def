"""All queries of the core, and the SQL they are compared with."""

from __future__ import annotations

from . import evaluation_queries, heavy_groups, model_queries, url_queries

_MODULES = [url_queries, evaluation_queries, model_queries, heavy_groups]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
