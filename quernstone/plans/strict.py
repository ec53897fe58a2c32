"""Strict JSON for configurations and requests: bounded in size, depth and width; no repeated keys, odd numbers or null characters."""

from __future__ import annotations

import json
import math
import re
from itertools import accumulate
from pathlib import Path

DEPTH, KEYS, ITEMS, BYTES = 8, 4096, 1024, 65_536
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_STEP = {"[": 1, "{": 1, "]": -1, "}": -1}


class StrictError(ValueError):
    """What isn't accepted; over_limit tells too much from wrong."""

    def __init__(self, message: str, over_limit: bool = False):
        super().__init__(message)
        self.over_limit = over_limit


def parse(raw: bytes, keys: int = KEYS, items: int = ITEMS) -> object:
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        raise StrictError("not UTF-8") from e
    # depth is that of brackets outside strings, known before anything is built
    if max(accumulate((_STEP.get(c, 0) for c in _STRING.sub("", text)), initial=0)) > DEPTH:
        raise StrictError("too deep", True)
    seen = 0

    def members(pairs: list[tuple[str, object]]) -> dict:
        nonlocal seen
        seen += len(pairs)
        if seen > keys:
            raise StrictError("too many keys", True)
        out = dict(pairs)
        if len(out) < len(pairs):
            raise StrictError("a repeated key")
        return out

    def refused(name: str) -> object:
        raise StrictError(f"{name} is no JSON")

    try:
        value = json.loads(text, object_pairs_hook=members, parse_constant=refused)
    except json.JSONDecodeError as e:
        raise StrictError(str(e)) from e
    left = [value]
    while left:
        node = left.pop()
        if isinstance(node, dict):
            left += [*node, *node.values()]
        elif isinstance(node, list):
            if len(node) > items:
                raise StrictError("too many items", True)
            left += node
        elif isinstance(node, str) and re.search("[\\x00\\ud800-\\udfff]", node):
            raise StrictError("a character that isn't allowed")
        elif isinstance(node, float) and not math.isfinite(node):
            raise StrictError("a number that isn't finite")
    return value


def config(path: str | Path) -> dict:
    """The object of a configuration file."""
    with open(path, "rb") as file:
        raw = file.read(BYTES + 1)
    if len(raw) > BYTES:
        raise StrictError("too large", True)
    value = parse(raw)
    if not isinstance(value, dict):
        raise StrictError("not an object")
    return value
