"""Registries: transforms that ``Signals`` offers as methods, reports, sources and clustering methods by name."""

from __future__ import annotations

from collections.abc import Callable

TRANSFORMS: dict[str, Callable] = {}
REPORTS: dict[str, Callable] = {}
SOURCES: dict[str, Callable] = {}
CLUSTERERS: dict[str, Callable] = {}


def into(registry: dict[str, Callable]) -> Callable[[Callable], Callable]:
    def register(f: Callable) -> Callable:
        registry[f.__name__] = f
        return f

    return register


transform = into(TRANSFORMS)
report = into(REPORTS)
source = into(SOURCES)
clusterer = into(CLUSTERERS)
