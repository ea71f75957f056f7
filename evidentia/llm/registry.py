"""The queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module that has a function of that name, and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_token_store": "token_store",
    "op10_language": "langid",
    "op11_conversation_repair": "chat_repair",
    "op12_secret_parts": "secrets_scan",
    "op13_centroids": "centroids",
    "op2_decontamination": "decontaminate",
    "op3_quotation_links": "chat_quotes",
    "op4_simhash": "simhash",
    "op5_chroma_prints": "chroma",
    "op6_knn_quality": "knn_quality",
    "op7_warc": "warc",
    "op8_best_fit_packing": "packing",
    "op9_toxic_segments": "toxicity",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"evidentia.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"evidentia.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
