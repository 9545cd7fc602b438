"""The queries of this subpackage and their SQL, by name. Modules are imported when a query runs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_OPS = {
    "op1_pii": "pii",
    "op2_token_ids": "id_files",
    "op3_toxicity": "toxicity",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_chat": "chat",
    "op6_quality": "quality",
    "op7_byte_bpe": "bpe_transducer",
    "op8_packing": "packing",
    "op9_embedding_dedup": "embedding_dedup",
    "op10_simhash": "simhash",
    "op11_license_scan": "license_scan",
    "op12_structure_repair": "structure_repair",
    "op13_collocations": "collocations",
}


def _lazy(module: str, name: str) -> Callable:
    def query(spark, sf_dir):
        return getattr(import_module(f"tributary.llm.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable]:
    return {name: _lazy(module, name) for name, module in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    from .chat import OP5_SQL
    from .collocations import OP13_SQL

    return {"op5_chat": OP5_SQL, "op13_collocations": OP13_SQL}
