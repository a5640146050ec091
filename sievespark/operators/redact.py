"""Snippets that show where a secret stands without showing it, or any other secret near it."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

CONTEXT, LEAST_REVEALED, LONGEST = 48, 16, 300
_BLANKS = re.compile(r"\s+")
_MORE = "…"


class Mask(NamedTuple):
    start: int
    end: int
    label: str


class LeakError(RuntimeError):
    """A snippet would show a secret; the finding is dropped."""


def label(secret: str, strategy: str = "full", keep: int = 4) -> str:
    """What stands in a secret's place; a few characters are shown of long ones where the strategy allows."""
    shown = 0 if strategy == "full" or len(secret) < LEAST_REVEALED else max(0, min(keep, len(secret) // 3))
    mark = f"[{len(secret) - shown} chars redacted]"
    if not shown:
        return mark
    return f"{mark}{_MORE}{secret[-shown:]}" if strategy == "keep_suffix" else f"{secret[:shown]}{_MORE}{mark}"


def _across(text: str, edge: int, value: str) -> int:
    """Start of the first copy of ``value`` that begins before the edge and ends after it, or -1."""
    return text.find(value, max(0, edge - len(value) + 1), edge + len(value) - 1)


def _pull(text: str, edge: int, stop: int, values: list[str], forward: bool) -> int:
    """Move a window's edge towards the target at ``stop`` until it cuts no copy of a secret."""
    while edge != stop:
        cut = next(((at, v) for v in values for at in [_across(text, edge, v)] if at >= 0), None)
        if cut is None:
            return edge
        edge = min(cut[0] + len(cut[1]), stop) if forward else max(cut[0], stop)
    return edge


def _union(masks: list[Mask]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(masks):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _bare(low: int, high: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [low, high) that no range covers."""
    out = []
    for start, end in covered:
        if end > low and start < high:
            if start > low:
                out.append((low, start))
            low = max(low, end)
    return [*out, (low, high)] if low < high else out


def _halves(text: str, values: list[str], masks: list[Mask], low: int, high: int) -> list[Mask]:
    """Masks for what sticks out of the given ones of copies that reach into them."""
    covered = _union(masks)
    starts = [a for a, _ in covered]
    found: dict[tuple[int, int], None] = {}
    for value in values:
        at = text.find(value, max(0, low - len(value) + 1), high + len(value) - 1)
        while at >= 0:
            end = at + len(value)
            i = bisect_left(starts, end)
            if i and covered[i - 1][1] > at:
                found |= dict.fromkeys(_bare(max(at, low), min(end, high), covered))
            at = text.find(value, at + 1, high + len(value) - 1)
    return [Mask(a, b, label(text[a:b])) for a, b in found]


def snippet(text: str, start: int, end: int, others: list[tuple[int, int]], strategy: str = "full", keep: int = 4, context: int = CONTEXT) -> str:
    """One line around [start, end), the secret masked, and every other match or copy of one masked as well.

    ``others`` are the matches that reach into the window. Window edges never cut a copy of a secret.
    """
    if not 0 <= start < end <= len(text):
        raise ValueError("the span is outside the text")
    values = sorted({v for a, b in [(start, end), *others] if len(v := text[a:b]) > 1}, key=lambda v: (-len(v), v))
    low = _pull(text, max(0, start - context), start, values, forward=True)
    high = _pull(text, min(len(text), end + context), end, values, forward=False)

    masks = [Mask(start, end, label(text[start:end], strategy, keep))]
    for a, b in others:
        if a < high and low < b:
            parts = [(a, b)] if b <= start or end <= a else [(x, y) for x, y in ((a, start), (end, b)) if x < y]
            masks += [Mask(x, y, label(text[x:y])) for x, y in parts]
    while more := _halves(text, values, masks, low, high):
        masks += more
    masks.sort(key=lambda m: m.start)

    names: dict[str, str] = {}
    for m in masks:
        names.setdefault(text[m.start : m.end], m.label)
    for a, b in others:
        names.setdefault(text[a:b], label(text[a:b]))
    swaps = sorted(((v, n) for v, n in names.items() if len(v) > 1), key=lambda x: -len(x[0]))

    parts: list[str] = []
    shown: list[tuple[int, int]] = []
    at = low
    for m in [*masks, Mask(high, high, "")]:
        if m.start > at:
            shown.append((at, m.start))
            plain = text[at : m.start]
            for value, name in swaps:
                plain = plain.replace(value, name)
            parts.append(_BLANKS.sub(" ", plain))
        parts.append(m.label)
        at = max(at, m.end)
    line = f"{_MORE * (low > 0)}{''.join(parts)}{_MORE * (high < len(text))}"
    if any(v in line for v in values) or any(_across(text, edge, v) >= 0 for pair in shown for edge in pair for v in values):
        raise LeakError("a secret or a part of one would be shown")
    return line[:LONGEST]
