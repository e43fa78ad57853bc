"""All registered queries, by section."""

from __future__ import annotations

import importlib

from convspark.session import configure

SECTIONS = [
    "text_queries",
    "retrieval_queries",
    "ingest_queries",
    "policy_queries",
    "identity_queries",
    "cache_queries",
    "evaluate_queries",
    "streaming_queries",
]


def _sections():
    return [importlib.import_module(f"convspark.queries.{name}") for name in SECTIONS]


def _configured(fn):
    return lambda spark, sf_dir: fn(configure(spark), sf_dir)


def queries():
    return {name: _configured(fn) for s in _sections() for name, fn in s.QUERIES.items()}


def oracle_sql():
    return {name: sql for s in _sections() for name, sql in s.ORACLE.items()}
