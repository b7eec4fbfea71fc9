"""Code search on Spark: parse, resolve, index, search, read and evaluate."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PLACES = {
    "parse_java": ("siltstone.java.chunker", "parse"),
    "index_workspace": ("siltstone.plans.indexing", "index_workspace"),
    "index_file": ("siltstone.plans.indexing", "index_file"),
    "index_retrieval": ("siltstone.plans.indexing", "index_retrieval"),
    "search_code": ("siltstone.plans.retrieval", "search_code"),
    "read_code": ("siltstone.plans.retrieval", "read_code"),
    "run_suite": ("siltstone.plans.retrieval", "run_suite"),
    "Store": ("siltstone.sources.store", "Store"),
    "Workspace": ("siltstone.sources.workspace", "Workspace"),
}
__all__ = list(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, attribute = _PLACES[name]
    return getattr(importlib.import_module(module), attribute)
