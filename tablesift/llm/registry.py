"""Queries of the training-data operators, and the pipeline."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality", "license", "linededup", "suffix", "langid", "mixing", "fingerprint", "warc", "decontaminate", "simhash", "divergence", "pieces", "infill"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f".{m}", __package__).ORACLE.items()}
