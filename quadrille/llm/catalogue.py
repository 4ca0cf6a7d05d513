"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import importlib

#: Modules with functions opN_<name>(spark, sf_dir), further QUERIES, and ORACLES where SQL can express them.
MODULES = ("secrets", "packing", "licenses", "minhash", "topk", "warc", "decontaminate", "quality", "langid", "substrings")


def _modules() -> list:
    return [importlib.import_module(f"quadrille.llm.{m}") for m in MODULES]


def queries() -> dict:
    found = {name: f for m in _modules() for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {name: f for m in _modules() for name, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
