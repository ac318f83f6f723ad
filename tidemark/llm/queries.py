"""The queries and SQL of the training-data operators, and of the pipeline."""

from __future__ import annotations

from importlib import import_module

#: query name: module, name of its SQL in the module or None
QUERIES = {
    "op1_bpe": ("bpe", None),
    "op2_embedding_dedup": ("embed_dedup", None),
    "op3_url_filters": ("url_filter", "OP3_SQL"),
    "op4_language_id": ("langid", None),
    "op5_html_text": ("html_text", None),
    "op6_minhash_dedup": ("near_dedup", None),
    "op7_chat_format": ("chat_format", "OP7_SQL"),
    "op8_exact_dedup": ("exact_dedup", "OP8_SQL"),
    "op9_secret_scan": ("secrets", "OP9_SQL"),
    "op10_mixing": ("mixing", None),
    "op11_resampling": ("resampling", "OP11_SQL"),
    "op12_token_files": ("token_files", None),
    "op13_branch_merge": ("branch_merge", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"tidemark.llm.{module}"), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"tidemark.llm.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}
