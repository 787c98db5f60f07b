"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from importlib import import_module

#: Module of each query; its ``SQL`` dictionary, where it has one, holds the equivalent text.
_QUERIES = {
    "op1_sentencepiece": "pieces",
    "op2_language_id": "langid",
    "op3_token_counts": "token_counts",
    "op4_license_scan": "licenses",
    "op5_quality_rules": "quality_rules",
    "op6_quality_model": "quality_model",
    "op7_toxicity": "toxicity",
    "op8_mixing": "mixing",
    "op9_minhash": "minhash",
    "op10_embedding_dedup": "embeddings",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(_QUERIES.values()):
        out |= getattr(import_module(f"{__package__}.{module}"), "SQL", {})
    return out
