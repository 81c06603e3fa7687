"""Plug-ins by name: providers of labels, scrapers and models, imported only when they are asked for."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_KNOWN: dict[str, str] = {"sample-model": "brindle.sources.samples:model", "sample-scraper": "brindle.sources.samples:scraper"}


def register(name: str, target: str) -> None:
    """`target` is module:function; the module is not imported yet."""
    if name in _KNOWN and _KNOWN[name] != target:
        raise ValueError(f"{name} is taken")
    _KNOWN[name] = target


def provider(name: str) -> Callable:
    """The plug-in's function, for `paged.fetch` or `paged.predict`."""
    if name not in _KNOWN:
        raise ValueError(f"unknown provider {name}; known are {', '.join(sorted(_KNOWN))}")
    module, _, function = _KNOWN[name].partition(":")
    return getattr(importlib.import_module(module), function)
