"""Curation, trajectory, packing and evaluation analytics for model training data, on PySpark.

Parts are loaded when they are first asked for: ``from sparkloom import CorpusPolicy, Transforms, corpus``.
"""

from importlib import import_module

_PLACES = {
    "CorpusPolicy": "operators.policy:CorpusPolicy",
    "Transforms": "transforms:Transforms",
    **{n: f"operators.{n}" for n in ("corpus", "packing", "scoring", "trajectories", "workspace")},
    **{n: f"sources.{n}" for n in ("catalog", "config", "decisions", "jsonl", "manifests", "payloads", "shards", "sinks", "synthetic")},
}
__all__ = sorted(_PLACES)
__version__ = "0.2.0"


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    module, _, part = _PLACES[name].partition(":")
    found = import_module(f"sparkloom.{module}")
    return getattr(found, part) if part else found


def __dir__() -> list[str]:
    return __all__
