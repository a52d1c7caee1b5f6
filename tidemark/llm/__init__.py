"""Operators for preparing training corpora. Nothing else in the package imports this subpackage."""

from importlib import import_module

MODULES = ("warc", "chat", "packing", "line_dedup", "minhash", "quality", "html_text", "toxicity", "topk", "mixing", "divergence", "spelling", "url_filter")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLES.items()}
