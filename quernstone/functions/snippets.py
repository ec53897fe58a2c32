"""Snippets and safe prefixes of at most 20 result rows, under token and byte limits. Driver-side text work."""

from __future__ import annotations

import re
import unicodedata

from quernstone.functions.markdown import blocks, tokens

MAX_TOKENS, MAX_BYTES = 160, 480
UNIT = re.compile(r".*?(?:[.!?。！？]+\s*|\n+|\Z)", re.S)


def fits(text: str, most_tokens: int = MAX_TOKENS, most_bytes: int = MAX_BYTES) -> bool:
    return tokens(text) <= most_tokens and len(text.encode()) <= most_bytes


def occurrences(text: str, anchor: str) -> list[tuple[int, int]]:
    """Places of an anchor, whatever its case; of its letter and digit runs where it doesn't occur as it is."""
    found = [m.span() for m in re.finditer(re.escape(anchor), text, re.I)]
    if not found:
        parts = re.findall(r"[^\W_]+", anchor)
        found = [m.span() for p in parts for m in re.finditer(re.escape(p), text, re.I)]
    return sorted(found)


def focus(text: str, anchors: tuple[str, ...]) -> tuple[int, tuple[int, int] | None]:
    """(anchors found, shortest span that covers one place of each of them)."""
    marks = sorted((s, e, i) for i, a in enumerate(anchors) for s, e in occurrences(text, a))
    wanted = len({i for _, _, i in marks})
    best, left, held = None, 0, {}
    for right, (_, _, i) in enumerate(marks):
        held[i] = held.get(i, 0) + 1
        while len(held) == wanted:
            span = (marks[left][0], max(m[1] for m in marks[left : right + 1]))
            if best is None or span[1] - span[0] < best[1] - best[0]:
                best = span
            j = marks[left][2]
            held[j] -= 1
            if not held[j]:
                del held[j]
            left += 1
    return wanted, best


def window(text: str, start: int, end: int) -> tuple[int, int]:
    """The longest stretch from start on that fits; it ends at end at most."""
    low, high = start, end
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(text[start:mid]) else (low, mid - 1)
    while low > start and low < len(text) and unicodedata.combining(text[low]):
        low -= 1
    return start, low


def snippet(body: str, anchors: tuple[str, ...]) -> tuple[str, bool, bool]:
    """(text, cut before, cut after): units around the best focus, growing after, after, before while the limits hold."""
    best = None
    at = 0
    for _, block in blocks(body):
        place = body.find(block, at)
        place = at if place < 0 else place
        n, span = focus(block, anchors)
        rank = (-n, span[1] - span[0] if span else 0, place)
        if best is None or rank < best[0]:
            best = (rank, place, block, span)
        at = place + len(block)
    if best is None:
        return "", False, False
    _, place, block, span = best
    units = [m.span() for m in UNIT.finditer(block) if m.end() > m.start()] or [(0, len(block))]
    span = span or (0, 0)
    first = next(i for i, (_, e) in enumerate(units) if e > span[0] or i == len(units) - 1)
    last = next((i for i, (_, e) in enumerate(units) if e >= span[1]), len(units) - 1)
    last = max(first, last)
    if not fits(block[units[first][0] : units[last][1]]):
        start, end = window(block, span[0] if not fits(block[units[first][0] : units[first][1]]) else units[first][0], len(block))
    else:
        turn, stuck = 0, 0
        while stuck < 3:
            forward = turn % 3 < 2
            turn += 1
            new = (first, last + 1) if forward else (first - 1, last)
            if 0 <= new[0] and new[1] < len(units) and fits(block[units[new[0]][0] : units[new[1]][1]]):
                first, last, stuck = *new, 0
            else:
                stuck += 1
        start, end = units[first][0], units[last][1]
    text = block[start:end].strip()
    return text, bool(body[: place + start].strip()), bool(body[place + end :].strip())


def safe_prefix(body: str, most: int = 800) -> tuple[str, bool]:
    """The longest prefix of whole blocks, else units, else characters, of at most `most` tokens; whether it was cut."""
    if tokens(body) <= most:
        return body, False
    ends, at = [], 0
    for _, block in blocks(body):
        at = max(at, body.find(block, at)) + len(block)
        ends.append(at)
    for cuts in (ends, [m.end() for m in UNIT.finditer(body)]):
        inside = [c for c in cuts if c and tokens(body[:c].rstrip()) <= most]
        if inside:
            return body[: max(inside)].rstrip(), True
    low, high = 0, len(body)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tokens(body[:mid]) <= most else (low, mid - 1)
    return body[:low], True
