"""Plug-ins that need no network and no model, for queries and tests; workers import them by name."""

from __future__ import annotations

from collections.abc import Callable


def scraper() -> Callable[[str], dict]:
    """Pages by the number in their address: some are gone, some fail."""

    def one(url: str) -> dict:
        n = int(url.rsplit("/", 1)[1])
        if n % 10 == 3:
            raise TimeoutError("slow")
        return {"outcome": "unavailable"} if n % 10 == 7 else {"title": f"t{n}"}

    return one


def model() -> Callable[[str], list[dict]]:
    """The first word of a text is a park; for some texts the span ends a letter too late."""

    def one(text: str) -> list[dict]:
        return [{"name": w, "category": "park", "start": text.index(w), "end": text.index(w) + len(w) + (len(text) % 7 == 0), "confidence": 0.9} for w in text.split()[:1]]

    return one
