"""All queries of this subpackage, and the SQL they are compared with."""

from __future__ import annotations

from . import (
    p1_formatting,
    p2_lookalikes,
    p3_terms,
    p5_near_duplicates,
    p6_split_leaks,
    p7_grouped_split,
    p8_packing,
    p9_eval_leaks,
    p10_shared_spans,
)

_MODULES = [p1_formatting, p2_lookalikes, p3_terms, p5_near_duplicates, p6_split_leaks, p7_grouped_split, p8_packing, p9_eval_leaks, p10_shared_spans]

QUERIES = {k: f for m in _MODULES for k, f in vars(m).items() if k[0] == "p" and k[1].isdigit() and f.__module__ == m.__name__}
ORACLE = {k: v for m in _MODULES for k, v in getattr(m, "ORACLE", {}).items()}
