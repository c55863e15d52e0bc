"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: query name -> module; each module has a function of the query's name, and ``SQL`` where there is an oracle.
MODULES = {
    "op1_line_frequency": "line_frequency",
    "op2_collinear_chains": "chaining",
    "op3_feistel_pseudonyms": "pseudonyms",
    "op4_simhash": "simhash",
    "op5_quartile_digest": "digest",
    "op6_bit_planes": "bitplanes",
    "op7_language_id": "language_id",
    "op8_chunked_bpe": "chunked_bpe",
    "op9_site_style_tree": "style_tree",
    "op10_entropy_balancing": "balancing",
}


def _load(name: str):
    return importlib.import_module(f"tidemark.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_load(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_load(name), "SQL", None))}
