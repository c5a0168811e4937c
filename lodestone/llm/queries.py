"""The queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import exact_dedup, filter_audit, language_id, lattice, minhash_dedup, packing, quality, token_counts, topk, toxicity, url_filter, weak_rules

_MODULES = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_packing": packing,
    "op3_url_filter": url_filter,
    "op4_sentencepiece": lattice,
    "op5_token_counts": token_counts,
    "op6_language_id": language_id,
    "op7_topk": topk,
    "op8_quality": quality,
    "op9_toxicity": toxicity,
    "op10_exact_dedup": exact_dedup,
    "op11_filter_audit": filter_audit,
    "op12_weak_rules": weak_rules,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
