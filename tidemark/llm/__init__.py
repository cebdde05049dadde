"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

The registry is read on first use, so that a worker that needs one operator does not import all of them.
"""

from importlib import import_module


def __getattr__(name: str):
    if name in ("QUERIES", "ORACLE_SQL"):
        return getattr(import_module("tidemark.llm.registry"), name)
    raise AttributeError(name)
