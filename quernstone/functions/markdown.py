"""Markdown structure: sections, blocks and chunks under a token budget. Sequential text algorithms, run on Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from quernstone.functions.text import CJK_RANGES

TARGET, HARD = 600, 800
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+")
#: The end of a sentence, with the white space behind it.
SENTENCE = re.compile(r"[.!?。！？]+(?:\s+|\Z)")
BLANK_QUOTE = re.compile(r"\s*>\s*\Z")

SYMBOL = re.compile(r"[$+<=>^`|~]")


@lru_cache(maxsize=20_000)
def wide(ch: str) -> bool:
    point = ord(ch)
    return any(a <= point <= b for a, b in CJK_RANGES) or unicodedata.category(ch)[0] == "S"


def sizes(text: str) -> tuple[int, int, int]:
    """(UTF-8 bytes, code points, wide ones): they add up over parts of a text."""
    w = 0 if text.isascii() and not SYMBOL.search(text) else sum(map(wide, set(text))) and sum(map(wide, text))
    return len(text.encode()), len(text), w


def estimate(size: tuple[int, int, int]) -> int:
    return max(-(-size[0] // 3), 2 * size[2] - (-(size[1] - size[2]) // 3))


def tokens(text: str) -> int:
    """The token estimate of functions.text.token_estimate, for one text."""
    return estimate(sizes(text))


def plus(*parts: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(map(sum, zip(*parts, strict=True)))


def fence_mask(lines: list[str]) -> list[bool]:
    """Whether each line is part of a fenced block. A fence closes only with its own character, at least as long, alone on a line."""
    out, open_ = [], ""
    for line in lines:
        m = FENCE.match(line)
        if open_:
            out.append(True)
            if m and m.group(1)[0] == open_[0] and len(m.group(1)) >= len(open_) and not m.group(2).strip():
                open_ = ""
        else:
            if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
                open_ = m.group(1)
            out.append(bool(open_))
    return out


@dataclass
class Section:
    heading_path: tuple[str, ...]
    occurrence: int
    first: int
    last: int
    body: str
    heading: str
    heading_line: int | None


def sections(body: str) -> list[Section]:
    """Sections with text of their own: heading path, how often that path came before, lines (from 1) and the text."""
    lines = body.split("\n")
    fenced = fence_mask(lines)
    marks = [(i, len(m.group(1)), (m.group(2) or "").strip()) for i, line in enumerate(lines) if not fenced[i] and (m := HEADING.match(line))]
    starts = [(-1, 0, ""), *marks]
    out, stack, seen = [], [], {}
    for k, (at, level, title) in enumerate(starts):
        if level:
            stack = [x for x in stack if x[0] < level] + [(level, title)]
        path = tuple(t for _, t in stack)
        key = tuple(unicodedata.normalize("NFC", t).casefold() for t in path)
        seen[key] = seen.get(key, 0) + 1
        end = starts[k + 1][0] if k + 1 < len(starts) else len(lines)
        own = list(range(at + 1, end))
        while own and not lines[own[0]].strip():
            own.pop(0)
        while own and not lines[own[-1]].strip():
            own.pop()
        if own:
            out.append(Section(path, seen[key], own[0] + 1, own[-1] + 1, "\n".join(lines[own[0] : own[-1] + 1]), lines[at] if level else "", at + 1 if level else None))
    return out


def kind_of(line: str) -> str:
    if ITEM.match(line):
        return "list"
    if line.lstrip().startswith(">"):
        return "quote"
    return "table" if line.lstrip().startswith("|") else "paragraph"


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of code, list, quote, table and paragraph blocks, in order."""
    lines, out, held, kind = text.split("\n"), [], [], ""
    fenced = fence_mask(lines)

    def close() -> None:
        nonlocal held, kind
        if held:
            out.append((kind, "\n".join(held)))
        held, kind = [], ""

    for i, line in enumerate(lines):
        if fenced[i]:
            if kind != "code" or held and FENCE.match(line) and not fenced[i - 1]:
                close()
            kind = "code"
            held.append(line)
        elif not line.strip():
            close()
        else:
            own = kind_of(line)
            if kind == "list" and (line.startswith((" ", "\t")) or own == "list") or kind == own or kind == "quote" and own == "paragraph":
                held.append(line)
            else:
                close()
                kind = own
                held.append(line)
    close()
    return out


def cut_scalars(text: str, most: int) -> Iterator[str]:
    """Pieces of a text without structure: the longest prefix that fits, by bisection, again and again."""
    while text:
        low, high = 1, min(len(text), 3 * most)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if tokens(text[:mid]) <= most else (low, mid - 1)
        yield text[:low]
        text = text[low:]


def packed(parts: Iterable[str], joint: str, over: Callable[[str], list[str]]) -> list[str]:
    """Parts joined while they fit TARGET; a part over TARGET stands for itself, as over() divides it."""
    out: list[str] = []
    held: list[str] = []
    total, between = (0, 0, 0), sizes(joint)

    def close() -> None:
        if held:
            out.append(joint.join(held))
            held.clear()

    for part in parts:
        size = sizes(part)
        if estimate(size) > TARGET:
            close()
            out += over(part)
            continue
        if held and estimate(both := plus(total, between, size)) <= TARGET:
            total = both
        else:
            close()
            total = size
        held.append(part)
    close()
    return out


def scalars(text: str) -> list[str]:
    return list(cut_scalars(text, TARGET))


def by_lines(text: str, whole: int = TARGET) -> list[str]:
    """Lines packed; those of up to `whole` tokens stay whole."""
    cut = lambda line: [line] if tokens(line) <= whole else scalars(line.rstrip("\n"))
    return [y for x in packed(text.splitlines(keepends=True), "", cut) if (y := x.rstrip("\n"))]


def by_sentences(text: str) -> list[str]:
    ends = [0, *(m.end() for m in SENTENCE.finditer(text)), len(text)]
    parts = [text[a:b] for a, b in zip(ends, ends[1:], strict=False) if a < b]
    return [y for x in packed(parts, "", lambda x: by_lines(x) if "\n" in x else scalars(x)) if (y := x.rstrip())]


def by_units(units: Iterable[str]) -> list[str]:
    """Structural units packed by lines; those over HARD are divided by lines, others stay whole."""
    parts = [y for x in units for y in ([x] if tokens(x) <= HARD else by_lines(x))]
    return packed(parts, "\n", lambda x: [x])


def grouped(lines: list[str], begins: Callable[[int], bool]) -> list[str]:
    """Lines joined to units, each from a line that begins one on."""
    at = [i for i in range(len(lines)) if i == 0 or begins(i)]
    return ["\n".join(lines[i:j]) for i, j in zip(at, [*at[1:], len(lines)], strict=True)]


def indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


def split_block(kind: str, text: str) -> list[str]:
    """A block over the limit, divided as its kind allows. A code block's fences stay with its first and last piece."""
    lines = text.split("\n")
    if kind == "code":
        closed = len(lines) > 2 and not fence_mask([*lines, ""])[-1]
        inner = by_lines("\n".join(lines[1 : -1 if closed else None]), HARD)
        if inner:
            inner[0] = f"{lines[0]}\n{inner[0]}"
            inner[-1] += f"\n{lines[-1]}" if closed else ""
            if all(tokens(x) <= HARD for x in inner):
                return inner
        return by_lines(text)
    if kind == "table":
        if len(lines) < 3 or not set(lines[1]) <= set("|:- \t"):
            return by_lines(text)
        head = "\n".join(lines[:3])
        return by_units([head, *lines[3:]] if tokens(head) <= HARD else ["\n".join(lines[:2]), *lines[2:]])
    if kind == "list":
        base = indent(lines[0])
        return by_units(grouped(lines, lambda i: bool(ITEM.match(lines[i].lstrip())) and indent(lines[i]) == base))
    if kind == "quote":
        return by_units(grouped(lines, lambda i: bool(BLANK_QUOTE.match(lines[i - 1]))))
    return by_sentences(text)


def dashed(text: str) -> str:
    """Letters and digits of a text, its blanks and dashes as one dash; other characters are left out."""
    return "-".join("".join(c if c.isalnum() else " " if c in " -" else "" for c in text).split())


def chunks(text: str) -> list[str]:
    """Parts of about TARGET tokens, none over HARD: blocks are packed; code, tables, lists and quotes stay whole up to HARD."""
    pieces: list[str] = []
    for kind, block in blocks(text):
        n = tokens(block)
        pieces += [block] if n <= (TARGET if kind == "paragraph" else HARD) else split_block(kind, block)
    out: list[list[str]] = []
    total, between = (0, 0, 0), sizes("\n\n")
    for piece in pieces:
        size = sizes(piece)
        if out and estimate(plus(total, between, size)) <= TARGET:
            out[-1].append(piece)
            total = plus(total, between, size)
        else:
            out.append([piece])
            total = size
    return ["\n\n".join(x) for x in out]
