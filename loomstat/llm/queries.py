"""The queries of this subpackage: each operator applied, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import prepared

#: Query name -> module that defines ``query(spark, sf_dir)`` and, where SQL can express it, ``ORACLE_SQL``.
MODULES = {
    "op1_packing": "packing",
    "op2_sharding": "sharding",
    "op3_topk_search": "topk",
    "op4_pii": "pii",
    "op5_quality_rules": "rules",
    "op6_quality_classifier": "discriminant",
    "op7_language_id": "language",
    "op8_token_counts": "tokens",
    "op9_mixing": "mixing",
    "op10_simhash": "simhash",
    "op11_sentencepiece": "backtracking",
    "op12_merkle": "merkle",
    "op13_hard_negatives": "covertree",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _module(name).query(prepared(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
