"""Caches of the Python workers: a worker keeps only those of the operator that it works for now."""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called when a task starts: what other operators left in this worker is dropped."""
    for other in [n for n in _held if n != name]:
        _held.pop(other)()
    _held[name] = clear
