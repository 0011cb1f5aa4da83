"""Spark-native analytics over binary isolate-by-feature matrices.

The names below are imported when they are first used, so that workers load only what a task needs.
"""

import importlib

_HOMES = {
    "Settings": "config", "prepare_environment": "config",
    "BinaryMatrix": "sources.matrix", "from_wide": "sources.matrix", "read_delimited": "sources.matrix",
    "analyse": "plans.analysis", "results": "plans.analysis",
    "measured": "plans.measure", "session_status": "plans.measure",
}
_MODULES = {name: f"operators.{name}" for name in ("advanced", "bootstrap", "charts", "communities", "graph", "mining", "pairs", "patterns", "resistance", "scores", "strata", "synth", "validation")}
__all__ = sorted([*_HOMES, *_MODULES])


def __getattr__(name: str):
    if name in _MODULES:
        return importlib.import_module(f".{_MODULES[name]}", __name__)
    if name in _HOMES:
        return getattr(importlib.import_module(f".{_HOMES[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
