"""Removal of repeated 200-byte strings by suffix sorting, one bucket of suffixes at a time.

Every byte that a `length`-byte string covers which also starts anywhere else is removed; strings are judged on the
input. Suffixes that agree in `length` bytes must meet in one bucket, and buckets must be small:

1. Fingerprints. The bucket of a suffix is the least fingerprint of the GRAM-byte strings inside its first `length` bytes.
   Neighbouring suffixes mostly share it, and the place of its first occurrence, so a text gives one row for each run of them
   (about one in 80 bytes). A run whose bucket occurs nowhere else can have no repeated string.
2. Equal runs. Runs of one bucket with equal bytes (their digest and the bucket, 128 bits) are one kind, and are collapsed before
   anything is sorted, first inside each text, so that a text of one repeated line gives few rows, then by partial sums.
   A kind that occurs twice repeats as a whole.
3. Division. Buckets with more than BUCKET_KINDS kinds are divided: the suffixes of a run are dealt to PARTS ranges of places before
   the fingerprint, and each range's new bucket is a digest of all bytes that its suffixes share. Equal suffixes stay together, since
   the fingerprint stands at the same place in both. This repeats until the buckets are small; at the latest, a range is one
   suffix and its bucket one kind.
4. Suffix sorting. One run of each kind, of the buckets that hold different kinds, is fetched with its bytes. Buckets
   are sorted one after another, a bounded number of bytes at a time. Suffixes are ordered by the place of the
   bucket's fingerprint in them and by their first bytes up to a sample position; longer ties are resolved by the ranks of
   a difference-cover sample, made by doubling before. The cover is laid out from the fingerprint's place, so that
   suffixes that can tie meet a sample position at the same offset, under PERIOD. Neighbours in that order that agree in
   `length` bytes are repeated.
5. The repeated strings come back to their texts as intervals, which are merged and cut out.

Hot buckets and kinds: counts are partial sums, and the joins that bring them back broadcast the few hot keys (see skew.py).
Texts are fingerprinted BLOCK bytes at a time, so a very long one needs no more memory than its bytes and its rows.

Matches never cross documents. Rows are told apart by id and a digest of the text: rows that repeat both share their
result, and their strings count as repeated. Edge cases: null and empty texts have n_bytes 0; texts shorter than `length` stay whole; an
empty table gives an empty result; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.skew import split_join
from quernstone.session import cut, drop_cut, ship

LENGTH, GRAM, PERIOD = 200, 48, 64
BUCKET_KINDS, PARTS = 256, 4
BLOCK = 1 << 20
BASE = 0xA0761D6478BD642F
WORD = 1 << 64


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as a text is long."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(BASE, -1, WORD)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, WORD))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, WORD))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTES = np.random.default_rng(5).integers(0, WORD, 256, np.uint64, endpoint=False)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prints:
    """Fingerprints of the strings of one text."""

    def __init__(self, raw: bytes):
        x = np.frombuffer(raw, np.uint8)
        self.up, down = _POWERS.to(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTES[x] * down[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def all(self, n: int) -> np.ndarray:
        k = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:k]) * self.up[:k])


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` successive ones, by doubling."""
    n, done = len(h) - width + 1, 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return h[:n] if done == width else np.minimum(h[:n], h[width - done : width - done + n])


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(bucket, digest of the run's bytes, first suffix, last suffix, place of the fingerprint) of the runs of a text."""
    out = [_block_runs(raw[at : at + BLOCK + length - 1], at, length, gram) for at in range(0, len(raw) - length + 1, BLOCK)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)


def _block_runs(raw: bytes, base: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    width, prints = length - gram + 1, Prints(raw)
    h = prints.all(gram)
    least = window_min(h, width)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    end = np.concatenate([start[1:] - 1, [len(least) - 1]])
    view, place, twice = np.lib.stride_tricks.sliding_window_view(h, width), np.empty(len(start), np.int64), np.empty(len(start), bool)
    for at in range(0, len(start), 4096):
        s, e = start[at : at + 4096], end[at : at + 4096]
        place[at : at + 4096] = s + view[s].argmin(1)
        twice[at : at + 4096] = place[at : at + 4096] != e + width - 1 - view[e][:, ::-1].argmin(1)
    if twice.any():  # the fingerprint occurs again: a run for each occurrence
        parts = [(start[~twice], end[~twice], place[~twice])]
        for s, e in zip(start[twice].tolist(), end[twice].tolist(), strict=True):
            at = s + np.flatnonzero(h[s : e + width] == least[s])
            at = at[: 1 + np.searchsorted(at, e)]
            first = np.concatenate([[s], at[:-1] + 1])
            parts.append((first, np.minimum(at, e), at))
        start, end, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(start)
        start, end, place = start[order], end[order], place[order]
    return h[place], prints.of(start, end + length), start + base, end + base, place + base


def kinds_of(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """(runs() of a text, one of each kind, and how often each occurs; the intervals of the kinds that occur twice)."""
    found = runs(raw, length, gram)
    if not len(found[0]):
        return (*found, np.zeros(0, np.int64)), []
    order = np.lexsort((found[2], found[1], found[0]))
    bucket, digest = found[0][order], found[1][order]
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (digest[1:] != digest[:-1])]))
    copies = np.diff(np.append(first, len(order)))
    again = np.sort(order[np.repeat(copies > 1, copies)])
    s, e = found[2][again], found[3][again] + length
    gap = np.flatnonzero(s[1:] > e[:-1]) if len(s) else s
    spans = zip(s[np.append(0, gap + 1)].tolist(), e[np.append(gap, len(e) - 1)].tolist(), strict=True) if len(s) else ()
    return (*(x[order[first]] for x in found), copies), list(spans)


@functools.lru_cache(maxsize=4)
def difference_cover(v: int) -> tuple[int, ...]:
    """A small set of residues whose differences are all residues modulo v (greedy)."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max((x for x in range(v) if x not in cover), key=lambda x: (len({(x - c) % v for c in cover} & missing | {(c - x) % v for c in cover} & missing), -x))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return tuple(sorted(cover))


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys, the first key first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_k = k[order]
        new[1:] |= sorted_k[1:] != sorted_k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def big_endian(x: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes (a multiple of 8) from each position, as integers that sort as the bytes do."""
    words = np.lib.stride_tricks.sliding_window_view(x, 8)
    return [np.ascontiguousarray(words[at + 8 * j]).view(">u8")[:, 0].astype(np.uint64) for j in range(n // 8)]


def repeated(bucket: np.ndarray, pieces: list[bytes], anchor: np.ndarray, length: int = LENGTH, period: int = PERIOD) -> list[np.ndarray]:
    """For each piece, which of its suffixes of at least `length` bytes agree in `length` bytes with one of another piece of its bucket.

    anchor is the place of the bucket's fingerprint in each piece; it lies within the first `length` bytes of every suffix.
    """
    gap, sizes = 2 * length + 4 * period, np.array([len(x) for x in pieces])
    x = np.frombuffer(b"".join(y for p in pieces for y in (p, bytes(gap))), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    cover = difference_cover(period)
    step = np.array([min((c - r) % period for c in cover) for r in range(period)])

    # ranks of the sample, by doubling from `period` bytes on
    spans = sizes + length
    piece = np.repeat(np.arange(len(pieces)), spans)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(spans) - spans, spans)
    sample = np.flatnonzero(step[(offset - anchor[piece]) % period] == 0)
    where = first[piece[sample]] + offset[sample]
    index = np.full(len(x), -1, np.int32)
    index[where] = np.arange(len(where))
    rank, depth = dense(*big_endian(x, where, period)) + 1, period
    while depth < length:
        follow = np.where(where + depth < len(x), index[np.minimum(where + depth, len(x) - 1)], -1)
        rank = dense(rank, np.where(follow >= 0, rank[follow], 0)) + 1
        depth *= 2

    # one suffix after another: bucket, place of the fingerprint, bytes up to the sample position, its rank
    counts = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, ahead = first[piece] + offset, anchor[piece] - offset
    to = step[-ahead % period]
    near = index[start + to]
    head = big_endian(x, start, -(-int(step.max()) // 8) * 8 or 8)
    for j, h in enumerate(head):  # bytes behind the sample position take no part
        head[j] = np.where(to >= 8 * j + 8, h, np.where(to <= 8 * j, np.uint64(0), h >> (8 * (8 * j + 8 - np.clip(to, 8 * j + 1, 8 * j + 8))).astype(np.uint64)))
    order = np.lexsort((rank[near], *head[::-1], ahead, bucket[piece]))
    hit = np.zeros(len(order), bool)
    rows = np.lib.stride_tricks.sliding_window_view(x, length)
    for at in range(0, len(order) - 1, 1 << 15):
        left, right = order[at : at + (1 << 15)][: len(order) - 1 - at], order[at + 1 : at + 1 + (1 << 15)]
        same = (bucket[piece[left]] == bucket[piece[right]]) & (ahead[left] == ahead[right])
        left, right = left[same], right[same]
        equal = (rows[start[left]] == rows[start[right]]).all(1)
        hit[left[equal]] = hit[right[equal]] = True
    return np.split(hit, np.cumsum(counts)[:-1])


def flags(hit: np.ndarray) -> list[tuple[int, int]]:
    """[a, b) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals: overlapping and touching ones become one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


RUN = "bucket long, digest long, first int, last int, place int, copies long"


def run_table(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, t, bucket, digest, first, last, place, copies): a row for each kind of run of each text. Rows without a bucket are intervals
    [first, last) of kinds that occur twice in their text."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [kinds_of((x.as_py() or "").encode(), length, gram) for x in part.column(2)]
                sizes = [len(f[0][0]) for f in found]
                bucket, digest, first, last, place, copies = (np.concatenate(x) for x in zip(*(f[0] for f in found), strict=True))
                rows = pa.array(np.repeat(np.arange(len(found)), sizes))
                names = ["id", "t", "bucket", "digest", "first", "last", "place", "copies"]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *(pa.array(x.view(np.int64)) for x in (bucket, digest)), *(pa.array(x.astype(np.int32)) for x in (first, last, place)), pa.array(copies.astype(np.int64))], names)
                spans = [(i, s, e) for i, f in enumerate(found) for s, e in f[1]]
                if spans:
                    rows = pa.array([x[0] for x in spans])
                    none, zero = pa.nulls(len(spans), pa.int64()), pa.array(np.zeros(len(spans), np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), none, none, pa.array([x[1] for x in spans], pa.int32()), pa.array([x[2] for x in spans], pa.int32()), zero, none], names)

    return texts.select("id", "t", "text").mapInArrow(run, f"id {kind}, t long, {RUN}")


def fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs (id, t, bucket, digest, first, last, place, copies, kinds) with their bytes, `piece`."""
    kind = texts.schema["id"].dataType.simpleString()
    lists = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("bucket", "digest", "first", "last", "place", "copies", "kinds")).alias("runs"))
    joined = texts.join(lists.withColumnRenamed("id", "rid").withColumnRenamed("t", "rt"), texts["id"].eqNullSafe(F.col("rid")) & (texts["t"] == F.col("rt")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (text, wants) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                raw = text.as_py().encode()
                for w in wants.as_py():
                    at.append(i)
                    out.append((*w.values(), raw[w["first"] : w["last"] + length]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], ["id", "t", "bucket", "digest", "first", "last", "place", "copies", "kinds", "piece"])

    return joined.select("id", "t", "text", "runs").mapInArrow(run, f"id {kind}, t long, {RUN}, kinds long, piece binary").dropDuplicates(["id", "t", "first", "last"])


def sorted_buckets(pieces: DataFrame, length: int, most: int = 2 << 20) -> DataFrame:
    """(id, t, s, e): intervals of repeated strings of the pieces that occur once; whole buckets at a time, about `most` bytes."""
    kind = pieces.schema["id"].dataType.simpleString()
    placed = pieces.repartition("bucket").sortWithinPartitions("bucket")

    def one(rows: list[tuple]) -> list[tuple]:
        buckets, raws = np.array([r[3] for r in rows], np.int64), [r[6] for r in rows]
        anchor, out = np.array([r[4] - r[2] for r in rows]), []
        for r, hit in zip(rows, repeated(buckets, raws, anchor, length), strict=True):
            if r[5] == 1:
                out += [(r[0], r[1], r[2] + a, r[2] + b - 1 + length) for a, b in flags(hit)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most and row[3] != held[-1][3]:
                    out += one(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
            yield table_of(out, batch.schema.field(0).type)
        if held:
            yield table_of(one(held), batch.schema.field(0).type)

    def table_of(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((id_type, pa.int64(), pa.int64(), pa.int64()))], ["id", "t", "s", "e"])

    return placed.select("id", "t", "first", "bucket", "place", "copies", "piece").mapInArrow(run, f"id {kind}, t long, s long, e long")


def divided(pieces: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """The pieces in ranges of `width` places before their fingerprint, with the bytes that all of a range's suffixes share as bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "digest", "first", "last", "piece"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, out = [], []
                for i, (bucket, first, last, place, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in ("bucket", "first", "last", "place", "piece")), strict=True)):
                    prints = Prints(raw)
                    # suffixes s with the same (place - s) // width
                    s = np.arange(first, last + 1)
                    cell = (place - s) // width
                    lo = s[np.flatnonzero(np.diff(cell, prepend=-1))]
                    hi = np.append(lo[1:] - 1, last)
                    cell = (place - lo) // width
                    # what the whole range shares, also where this run has a part of it only
                    far = np.minimum(cell * width + width - 1, length - gram)
                    key = prints.of(place - cell * width - first, place - far + length - first) ^ mixed(np.uint64(bucket & (WORD - 1)) + cell.astype(np.uint64))
                    digest = prints.of(lo - first, hi - first + length)
                    rows += [i] * len(lo)
                    out += zip(key.view(np.int64).tolist(), digest.view(np.int64).tolist(), lo.tolist(), hi.tolist(), [raw[a:b] for a, b in zip((lo - first).tolist(), (hi - first + length).tolist(), strict=True)], strict=True)
                taken = part.take(pa.array(rows, pa.int64()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                fresh = {n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate(zip(names, kinds, strict=True))}
                yield pa.RecordBatch.from_arrays([fresh.get(n, taken.column(k)) for k, n in enumerate(part.schema.names)], part.schema.names)

    return pieces.mapInArrow(run, pieces.schema)


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stored runs: (the once-occurring runs, (id, t, s, e), of kinds that occur twice in all; one run of each kind of the buckets
    that hold different kinds, some of them single, with copies and the bucket's `kinds`, stored)."""
    rest = [c for c in rows.columns if c not in ("bucket", "digest", "copies")]
    kinds = cut(rows.groupBy("bucket", "digest").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"), F.min(F.struct(*rest)).alias("one")), "kinds")
    again = split_join(rows.where("copies = 1").select("id", "t", "first", "last", "bucket", "digest"), kinds.where("all > 1").select("bucket", "digest", "rows"), ["bucket", "digest"], "rows", ["id", "t", "first"])
    buckets = cut(kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.min("all").alias("least")).where("kinds > 1 AND least = 1").drop("least"), "open")
    opened = split_join(kinds.select("bucket", "digest", F.col("all").alias("copies"), "one"), buckets, ["bucket"], "kinds", ["digest"])
    again = cut(again.select("id", "t", F.col("first").cast("long").alias("s"), F.col("last").cast("long").alias("e")), "again")
    opened = cut(opened.select(*(F.col(f"one.{c}").alias(c) for c in rest), "bucket", "digest", "copies", "kinds"), "open")
    drop_cut(kinds)
    drop_cut(buckets)
    return again, opened


def intervals(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, t, s, e): intervals that cover the repeated bytes of the texts (id, t, text). Stored."""
    found = run_table(texts, length, gram)
    shared = cut(found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("runs"), F.sum("copies").alias("c")).where("c > 1").drop("c"), "shared")
    rows = cut(split_join(found, shared, ["bucket"], "runs", ["id", "t", "first"], keep_null=True).drop("runs"), "runs")
    drop_cut(shared)
    out = [rows.where("bucket IS NULL").select("id", "t", F.col("first").cast("long").alias("s"), F.col("last").cast("long").alias("e"))]
    held, (again, opened) = [rows], settled(rows.where("bucket IS NOT NULL"))
    pieces, width = cut(fetched(texts, opened, length), "pieces"), length - gram + 1
    drop_cut(opened)
    while True:
        held += [again, pieces]
        out += [again.select("id", "t", "s", (F.col("e") + length).alias("e")), sorted_buckets(pieces.where(F.col("kinds") <= BUCKET_KINDS), length)]
        large = pieces.where(F.col("kinds") > BUCKET_KINDS)
        if large.isEmpty():
            break
        width = -(-width // PARTS)
        parts = cut(divided(large.drop("kinds"), width, length, gram), "parts")
        again, pieces = settled(parts)
        held.append(parts)
    spans = cut(functools.reduce(DataFrame.unionByName, out), "spans")
    for x in held:
        drop_cut(x)
    return spans


def deduplicated(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) for each row; kept is what is left of the text's bytes."""
    ship(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("t"), "text")
    lists = intervals(texts, length).groupBy("id", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnRenamed("id", "rid").withColumnRenamed("t", "rt")
    joined = texts.join(lists, texts["id"].eqNullSafe(F.col("rid")) & (texts["t"] == F.col("rt")), "left").select("id", "text", "spans")
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                cuts = merged([(x["s"], x["e"]) for x in spans.as_py() or []])
                kept, at = [], 0
                for s, e in cuts:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                out.append((kept, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], [id_col, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
