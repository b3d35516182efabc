"""Scorers by name: functions that add columns to variant rows, applied in order."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

_SCORERS: dict[str, Callable[..., DataFrame]] = {}


def scorer(name: str):
    """Register a function of (pairs[, **context]) under a name."""
    if not name:
        raise ValueError("a scorer needs a name")

    def add(f):
        if name in _SCORERS:
            raise ValueError(f"scorer {name!r} is already registered")
        _SCORERS[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_SCORERS)


def apply(pairs: DataFrame, wanted: list[str], **context) -> DataFrame:
    """Apply scorers in the order given; each gets the parts of the context its parameters name, or all with ``**``.

    A scorer must keep every column and row. KeyError for names that are unknown.
    """
    unknown = [n for n in wanted if n not in _SCORERS]
    if unknown:
        raise KeyError(f"unknown scorers: {', '.join(unknown)}")
    for n in wanted:
        takes = inspect.signature(_SCORERS[n]).parameters
        every = any(p.kind is p.VAR_KEYWORD for p in takes.values())
        before = pairs.columns
        pairs = _SCORERS[n](pairs, **{k: v for k, v in context.items() if every or k in takes})
        lost = set(before) - set(pairs.columns)
        if lost:
            raise ValueError(f"scorer {n!r} dropped {sorted(lost)}")
    return pairs
