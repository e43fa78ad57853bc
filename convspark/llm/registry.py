"""Queries of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = [
    "url_filter",
    "secret_scan",
    "decontaminate",
    "simhash",
    "substring_dedup",
    "mixing",
    "warc",
    "html_text",
    "quality_rules",
    "language_id",
    "centroids",
    "mixture_packing",
    "turn_repair",
]


def _modules():
    return [importlib.import_module(f"convspark.llm.{name}") for name in MODULES]


def queries():
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
