"""Token-window measures."""

from __future__ import annotations


def narrowest_span(text: str, wanted: set[str]) -> int | None:
    """Length in words of the shortest stretch that holds every wanted word."""
    last_seen: dict[str, int] = {}
    best: int | None = None
    for position, word in enumerate(text.split()):
        if word not in wanted:
            continue
        last_seen[word] = position
        if len(last_seen) == len(wanted):
            span = position - min(last_seen.values()) + 1
            best = span if best is None else min(best, span)
    return best
