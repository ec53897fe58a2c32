"""Compiling and checking search requests. Control plane: plain Python on the driver, bounded by the request's own limits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from quernstone.functions.text import CJK_RANGES

MAX_SCALARS, MAX_BYTES, MAX_ANCHORS, MAX_QUERIES, MAX_RESULTS, DEFAULT_RESULTS = 256, 1024, 6, 6, 20, 8
SCOPES = ("article", "conversation", "note")
#: Characters and words that a search syntax reserves.
SYNTAX = frozenset('"*()^{}')
BIDI = frozenset("\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069")
RESERVED = frozenset(("and", "near", "not", "or"))


class QueryError(ValueError):
    """A request that isn't accepted; reason is a stable code."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


@dataclass(frozen=True)
class Clause:
    """A word (matched as a prefix) or a CJK phrase (matched as adjacent characters)."""

    kind: str
    value: str


@dataclass(frozen=True)
class CompiledQuery:
    text: str
    key: str
    anchors: tuple[str, ...]
    clauses: tuple[Clause, ...]


def is_cjk(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in CJK_RANGES)


#: Why a query as it was given isn't accepted, in the order in which that is tested.
REFUSALS = (
    ("wrong_type", lambda q: not isinstance(q, str)),
    ("unicode_scalar_limit", lambda q: len(q) > MAX_SCALARS),
    ("invalid_unicode_scalar", lambda q: re.search("[\ud800-\udfff]", q)),
    ("utf8_byte_limit", lambda q: len(q.encode()) > MAX_BYTES),
    ("control_character", lambda q: re.search("[\x00-\x1f\x7f-\x9f]", q)),
    ("bidi_control", lambda q: BIDI & set(q)),
    ("raw_fts_syntax", lambda q: SYNTAX & set(q)),
    ("column_filter_separator", lambda q: ":" in q.replace("::", "")),
    ("empty_query", lambda q: not q.strip()),
)


def checked(query: object) -> str:
    """The query in composed form, if it may be compiled."""
    for reason, holds in REFUSALS:
        if holds(query):
            raise QueryError(reason, f"the query isn't accepted: {reason.replace('_', ' ')}")
    return unicodedata.normalize("NFC", query).strip()


def dedupe_key(query: str) -> str:
    return " ".join(checked(query).split()).casefold()


def clauses_of(anchor: str) -> list[Clause]:
    out: list[tuple[str, str]] = []
    last = None
    for ch in anchor:
        kind = "phrase" if is_cjk(ch) else "prefix" if unicodedata.category(ch)[0] in "LNM" else None
        if kind and kind == last:
            out[-1] = (kind, out[-1][1] + ch)
        elif kind:
            out.append((kind, ch))
        last = kind
    return [Clause(k, v if k == "phrase" else v.casefold()) for k, v in out]


def compiled(query: object) -> CompiledQuery:
    """A query of 1 to 6 anchors; each anchor's parts must all occur."""
    text = checked(query)
    anchors = tuple(text.split())
    if len(anchors) > MAX_ANCHORS:
        raise QueryError("anchor_count", f"at most {MAX_ANCHORS} words")
    clauses: list[Clause] = []
    for anchor in anchors:
        own = clauses_of(anchor)
        if not own:
            raise QueryError("anchor_not_searchable", f"nothing to search for in {anchor!r}")
        if any(c.kind == "prefix" and c.value in RESERVED for c in own):
            raise QueryError("reserved_word", f"{anchor!r} is reserved")
        clauses += own
    return CompiledQuery(text, " ".join(anchors).casefold(), anchors, tuple(clauses))


def request(queries: Sequence[object], scopes: Sequence[str] = SCOPES, limit: object = DEFAULT_RESULTS) -> tuple[tuple[CompiledQuery, ...], tuple[str, ...], int]:
    """A checked search request: 1 to 6 different queries, 1 to 3 different scopes, 1 to 20 results."""
    if isinstance(queries, str) or not 1 <= len(queries) <= MAX_QUERIES:
        raise QueryError("query_count", f"1 to {MAX_QUERIES} queries")
    out = tuple(compiled(q) for q in queries)
    if len({q.key for q in out}) < len(out):
        raise QueryError("duplicate_query", "queries must differ")
    if not scopes or len(set(scopes)) < len(scopes) or set(scopes) - set(SCOPES):
        raise QueryError("scopes", f"different scopes of {', '.join(SCOPES)}")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_RESULTS:
        raise QueryError("limit", f"1 to {MAX_RESULTS} results")
    return out, tuple(scopes), limit
