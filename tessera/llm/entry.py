"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame

#: Query name -> module that holds the function of that name; SQL, where there is any, is the module's SQL.
MODULES = {
    "op1_ngram_join": "ngram_join",
    "op6_quality_rules": "quality_rules",
    "op9_mixing": "mixing",
    "op8_pii": "pii",
    "op7_toxicity": "toxicity",
    "op3_licenses": "licenses",
    "op2_html_extract": "html_extract",
    "op4_packing": "packing",
    "op10_topk": "topk",
    "op5_chat": "chat",
    "op11_importance_resampling": "resampling",
    "op12_ranked_search": "ranked_search",
    "op13_secrets": "secret_scan",
}


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {name: getattr(import_module(f"tessera.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tessera.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
