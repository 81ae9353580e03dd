"""The queries of the training-data operators, by name; SQL where it can express one."""

from __future__ import annotations

from importlib import import_module

_HOME = {
    "op1_license_scan": "licenses",
    "op10_language_id": "language",
    "op5_html_extraction": "html",
    "op4_document_fingerprints": "sketches",
    "op3_embedding_near_dedup": "embeddings",
    "op2_bpe": "bpe",
    "op7_packing": "packing",
    "op8_pii": "pii",
    "op9_secret_scan": "secrets",
    "op6_simhash_near_dedup": "simhash",
    "op11_vector_codes": "codes",
    "op12_benchmark_decontamination": "winnowing",
    "op13_tolerant_asof_join": "asof",
}


def queries():
    """Name to callable(spark, sf_dir)."""
    return {name: getattr(import_module(f"terralith.llm.{module}"), name) for name, module in _HOME.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for the queries that SQL can express."""
    found = {}
    for name, module in _HOME.items():
        sql = getattr(import_module(f"terralith.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
