"""Loads the modules that register the text queries."""

from importlib import import_module

from tidemark.llm.registry import QUERIES, STATEMENTS

_MODULES = ["quality", "simhash", "secrets", "packing", "suffixes", "vectors", "preferences", "lines", "lattice", "scoring", "winnowing", "trie", "variants"]


def all_queries():
    for name in _MODULES:
        import_module(f"tidemark.llm.{name}")
    return dict(QUERIES)


def all_statements():
    all_queries()
    return dict(STATEMENTS)
