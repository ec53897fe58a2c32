"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

Encoding: a text is split at the added tokens' strings, then by the byte-level pattern; each piece is mapped to byte
symbols held in a doubly linked list. A heap holds (rank, left position, left id, right id) of adjacent pairs; an entry
whose symbols have changed meanwhile is stale and skipped. Pieces repeat, so each worker keeps a bounded table of
pieces already encoded.

Decoding: the vocabulary strings are concatenated, mapped back to bytes and read as UTF-8 (bad bytes become U+FFFD).

Edge cases: a null or empty text has no ids and decodes to the empty text; texts are never cut; rows repeat as given;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quernstone.session import lean, ship

#: Fixed value: the pattern of byte-level BPE vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters and numbers that are younger than the character tables which such vocabularies are used with;
#: they count as neither. A regex module with older tables doesn't know them anyway.
YOUNGER = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"

#: Texts whose code points all lie below this are split by an equal pattern of the standard library, which is faster.
LOW = 0x250

#: Entries of a worker's table of encoded pieces; it is emptied when full, so memory is bounded.
PIECE_TABLE = 600_000
#: Longer pieces are encoded but not kept.
PIECE_BYTES = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def full_pattern() -> regex.Pattern:
    """PIECES without the younger characters in its classes."""
    points = [[chr(int(x, 16)) for x in r.split("-")] for r in YOUNGER.split()]
    younger = "[" + "".join(regex.escape(r[0]) + (f"-{regex.escape(r[-1])}" if len(r) > 1 else "") for r in points) + "]"
    pattern = PIECES.replace(r"[^\s\p{L}\p{N}]", "OTHER").replace(r"\p{L}", rf"[\p{{L}}--{younger}]").replace(r"\p{N}", rf"[\p{{N}}--{younger}]")
    return regex.compile(pattern.replace("OTHER", rf"[[^\s\p{{L}}\p{{N}}]||{younger}]"), regex.V1)


@lru_cache(maxsize=1)
def low_pattern() -> re.Pattern:
    """PIECES with its classes written out for code points below LOW."""
    listed = {kind: "".join(re.escape(c) for c in map(chr, range(LOW)) if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    letters, numbers, spaces = listed.values()
    pattern = PIECES.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
    return re.compile(pattern)


class ByteBPE:
    """A vocabulary file in the JSON format of the tokenizers library (byte-level BPE, no normalizer)."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [vocab[c] for c in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.strings: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.find, self.find_low, self.high = full_pattern().findall, low_pattern().findall, re.compile(f"[^\\x00-{chr(LOW - 1)}]").search
        self.table: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges, shift = self.merges, n.bit_length()
        mask = (1 << shift) - 1
        #: found[i]: rank and merged id of the pair that begins at i, None where no merge applies or i is gone
        found = [*map(merges.get, zip(ids, ids[1:], strict=False)), None]
        queue = [(m[0] << shift) | i for i, m in enumerate(found) if m]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & mask
            m = found[i]
            if m is None or m[0] != entry >> shift:
                continue  # stale: one of the two symbols has been merged meanwhile
            whole = ids[i] = m[1]
            j = after[i]
            ids[j], found[j] = -1, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                m = found[i] = merges.get((whole, ids[k]))
                if m:
                    push(queue, (m[0] << shift) | i)
            else:
                found[i] = None
            h = before[i]
            if h >= 0:
                m = found[h] = merges.get((ids[h], whole))
                if m:
                    push(queue, (m[0] << shift) | h)
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        out = np.array(self.merge(raw), "<u4").tobytes()
        if len(raw) <= PIECE_BYTES:
            if len(self.table) >= PIECE_TABLE:
                self.table.clear()
            self.table[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        known, packed = self.table.get, self.packed
        return b"".join([known(p) or packed(p) for p in (self.find if self.high(text) else self.find_low)(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.split_added or not any(s in text for s in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(file: str) -> ByteBPE:
    return ByteBPE(file)


def encode(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens): the ids of each whole text; file must be readable on every executor."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(file)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(at, 500)
                packed = [model.encode(x.as_py()) for x in part.column(1)]
                offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(offsets).astype(np.int64))], [id_col, "ids", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>, n_tokens long")


def decode(df: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids; a null list gives the empty text."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(file)
        for batch in batches:
            texts = [model.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode each whole text in one pass, keeping digests only."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(file)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for x in batch.column(1):
                ids = model.encode(x.as_py())
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(model.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
