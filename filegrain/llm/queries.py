"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from importlib import import_module

#: Module and query name of each operator.
OPERATORS = {
    "op1_substring_dedup": "op1_substring_dedup",
    "op2_exact_dedup": "op2_exact_dedup",
    "op3_secrets": "op3_secrets",
    "op4_line_dedup": "op4_line_dedup",
    "op5_byte_bpe": "op5_byte_bpe",
    "op6_chat": "op6_chat",
    "op7_quality": "op7_quality",
    "op8_token_files": "op8_token_files",
    "op9_mixing": "op9_mixing",
    "op10_simhash": "op10_simhash",
    "op11_hard_negatives": "op11_hard_negatives",
    "op12_periodic_runs": "op12_periodic_runs",
    "op13_jaccard_join": "op13_jaccard_join",
}


#: Further queries: module, and the names of the function and of its SQL.
MORE = {
    "lines_by_host": ("op4_line_dedup", "query_pages", "ORACLE_PAGES"),
    "planted_secrets": ("op3_secrets", "query_planted", None),
}


def _found() -> dict[str, tuple]:
    all_ = {name: (module, "query", "ORACLE") for name, module in OPERATORS.items()} | MORE
    return {name: (getattr(import_module(f".{module}", __package__), run), getattr(import_module(f".{module}", __package__), sql, None) if sql else None) for name, (module, run, sql) in all_.items()}


def queries() -> dict:
    return {name: run for name, (run, _) in _found().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found().items() if sql}
