"""The registered queries, one per inventory ID."""

from importlib import import_module

from tidemark.workload.base import QUERIES, STATEMENTS

_MODULES = [
    "drift",
    "batch",
    "evaluation",
    "records",
    "expressions",
    "streams",
    "models",
]


def _load() -> None:
    for name in _MODULES:
        import_module(f"tidemark.workload.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_statements():
    _load()
    return dict(STATEMENTS)
