"""tracequarry: reliability analytics of multi-agent text traces on Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"
MODULES = {**dict.fromkeys("detect evals graph policy report rollup runtime signals".split(), "operators"), **dict.fromkeys("otlp payloads samples".split(), "sources"), "gate": "streaming"}
NAMES = {"Chain": "payloads", "Graph": "payloads", "Rule": "detect", "analyse": "detect", "chain_report": "report", "graph_report": "graph"}
__all__ = sorted([*MODULES, *NAMES])


def __getattr__(name: str):
    """Imported when first asked for: Python workers, which import this package too, load nothing that they don't need."""
    if name in MODULES:
        return import_module(f".{MODULES[name]}.{name}", __name__)
    if name in NAMES:
        return getattr(__getattr__(NAMES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
