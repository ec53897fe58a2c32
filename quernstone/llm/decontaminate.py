"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

A document leaks an item if some window lies within floor(EDIT * words) word edits of it. With free ends, as the queries and
the pipeline take it, the window may have any length, so that a word put in or left out counts once; without, it has as
many words as the item, and a document with fewer words leaks nothing. Words are runs of letters and digits, lower-cased, so case, punctuation and added marks don't count.

1. Prune, without loss. A window within t edits of an item of n words shares n - 1 - 2 t of its word pairs, and one more for
   each word that it is longer than the item. So the n - 1 pairs from its start on, and those before its end, hold n - 1 - 2 t of
   the benchmark's whatever its length; only places with so many go on, pairs beyond the text's ends counting as none. The pairs are a
   Bloom filter of 32 to 64 bits a pair, at most 64 MB: it can err only by letting windows through.
2. Embed. WALKS CGK walks run over the words from a window's start, and as many backwards from its end: at step j the
   symbol is read, and the pointer moves on or stays as a random function of (walk, j, symbol) says. Words that are inserted,
   deleted or changed put two walks out of step for a while only, so edit distance becomes Hamming distance. A walk
   reads about three quarters of the octave's shortest length, so edits crowded at one end spare the walks from the other.
3. Sample. Each walk gives DRAWS keys of SAMPLED random steps. Items of one octave of lengths share walks and steps;
   the steps stay within the shortest of them. A second Bloom filter drops keys that no item has. Windows with
   further keys that begin near each other form a region with room on both sides; its distinct keys are
   equi-joined with the items' keys.
4. Verify. Each (region, item) that shares a key is compared by exact edit distance; the best window of each pair stays.

Recall of LSH is measured in the tests: over 0.99 at the full number of edits.

Edge cases: null and empty texts leak nothing; items without words are leaked by nothing, items of one word by equal words;
rows that repeat a document's id count as one document of the result; null ids are kept; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut, lean, ship

EDIT = 0.2
#: Bounds of a filter's bits (as powers of two; the larger is 64 MB), and bits that an entry sets.
LEAST_BITS, MOST_BITS, HASHES = 16, 29, 6
WALKS, DRAWS, SAMPLED, SEED = 16, 4, 4, 11
WORDS = re.compile(r"[^\W_]+")
#: Windows embedded, and characters divided into words, at a time; one text is never divided.
BLOCK, CHUNK = 4096, 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def characters() -> np.ndarray:
    """By code point: a digest of each character that words have, 0 for all others."""
    out = np.zeros(0x110000, np.uint64)
    for m in WORDS.finditer("".join(map(chr, range(len(out))))):
        out[slice(*m.span())] = mixed(mixed(np.arange(m.start() + 1, m.end() + 1, dtype=np.uint64)))
    return out


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit digests of all words of the texts one after another, words of each text): characters times an odd number of their place, summed."""
    low = [t.lower() if t else "" for t in texts]
    points = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    value = characters()[points]
    inside = value != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, sizes = edges[::2], edges[1::2] - edges[::2]
    counts = np.diff(np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in low)])))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    first = np.cumsum(sizes) - sizes
    odd = mixed(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    value = value[inside]
    value *= odd[np.arange(len(value)) - np.repeat(first, sizes)]
    return mixed(np.add.reduceat(value, first)), counts


def symbols(text: str | None) -> np.ndarray:
    return symbols_of([text])[0]


def pair_hashes(s: np.ndarray) -> np.ndarray:
    return s[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[1:]


def word_hashes(s: np.ndarray) -> np.ndarray:
    return s ^ np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=1)
def masks() -> np.ndarray:
    """Words with HASHES random bits set."""
    rng = np.random.default_rng(SEED)
    bits = np.argsort(rng.random((4096, 64)), axis=1)[:, :HASHES].astype(np.uint64)
    return np.bitwise_or.reduce(np.uint64(1) << bits, axis=1)


class Filter:
    """A blocked Bloom filter of 2**size bits: an entry sets HASHES bits of one 64-bit word, so that one look finds it."""

    def __init__(self, size: int, data: np.ndarray | None = None):
        self.size, self.data = size, np.zeros(1 << size >> 6, np.uint64) if data is None else data

    @staticmethod
    def bits(entries: int) -> int:
        """Size for so many entries: 32 to 64 bits each, within LEAST_BITS and MOST_BITS."""
        return min(MOST_BITS, max(LEAST_BITS, (32 * entries - 1).bit_length()))

    def add(self, h: np.ndarray) -> None:
        h = mixed(h)
        np.bitwise_or.at(self.data, (h >> np.uint64(70 - self.size)).astype(np.int64), masks()[(h & np.uint64(4095)).astype(np.int64)])

    def has(self, h: np.ndarray) -> np.ndarray:
        h = mixed(h)
        mask = masks()[(h & np.uint64(4095)).view(np.int64)]
        return self.data[(h >> np.uint64(70 - self.size)).view(np.int64)] & mask == mask


def allowed(n: int, edit: float = EDIT) -> int:
    return int(edit * n + 1e-9)


def octave(n: int) -> int:
    """Lengths from 2**octave to 2**(octave + 1) - 1 share their walks."""
    return n.bit_length() - 1


@lru_cache
def plan(group: int) -> tuple[int, np.ndarray]:
    """(steps of a walk, sampled steps as WALKS x DRAWS x SAMPLED) of an octave."""
    steps = max(1, int(1.5 * (1 << group)))
    rng = np.random.default_rng([SEED, group])
    return steps, np.sort(rng.integers(0, steps, (WALKS, DRAWS, SAMPLED)), axis=2)


@lru_cache
def drawn(group: int) -> list[list[tuple[int, int]]]:
    """The (walk, draw) that sample each step."""
    steps, sampled = plan(group)
    return [[(int(w), int(d)) for w, d in zip(*np.nonzero((sampled == j).any(2)), strict=True)] for j in range(steps)]


def walk_keys(tokens: np.ndarray, start: np.ndarray, group: int, back: bool = False) -> np.ndarray:
    """Keys (WALKS * DRAWS columns) of the windows that begin at start or, with back, have their last word there; tokens
    must have room behind the last one or, with back, before the first."""
    steps, _ = plan(group)
    at = np.repeat(start[None, :], WALKS, 0)
    salt = np.random.default_rng([SEED, group, 1 + back]).integers(0, 1 << 64, (steps, WALKS), np.uint64, endpoint=False)
    seed = np.uint64(group + 64 * back)
    keys = np.repeat(np.arange(1, WALKS * DRAWS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + seed, len(start), 1).reshape(WALKS, DRAWS, -1)
    # mixed() folds before it multiplies; folding is linear, so it is done once for tokens and salts, and the last fold leaves the top bit
    tokens, salt = tokens ^ (tokens >> np.uint64(32)), salt ^ (salt >> np.uint64(32))
    for j, takes in enumerate(drawn(group)):
        here = tokens[at]
        for w, d in takes:
            keys[w, d] = mixed(keys[w, d] ^ here[w])
        here ^= salt[j][:, None]
        here *= np.uint64(0xD6E8FEB86659FD93)
        here >>= np.uint64(63)
        if back:
            at -= here.view(np.int64)
        else:
            at += here.view(np.int64)
    return keys.reshape(WALKS * DRAWS, -1).T


def windows(sums: np.ndarray, word_hit: np.ndarray | None, first: np.ndarray, last: np.ndarray, lengths: list[int], edit: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By octave: places of the words that begin a window that shares enough pairs with the benchmark, and of those that end one.
    sums: its pairs among those before each word; word_hit: its words; first, last: places of the first and last words of each word's text."""
    at = np.arange(len(sums))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in lengths:
        begins, ends = out.setdefault(octave(n), (np.zeros(len(sums), bool), np.zeros(len(sums), bool)))
        if n == 1:
            begins |= word_hit
            ends |= word_hit
        else:
            least = n - 1 - 2 * allowed(n, edit)
            begins |= sums[np.minimum(at + (n - 1), last)] - sums >= least
            ends |= sums - sums[np.maximum(at - (n - 1), first)] >= least
    return {g: (np.flatnonzero(begins), np.flatnonzero(ends)) for g, (begins, ends) in out.items()}


def sparse_bound(lengths: list[int], edit: float) -> tuple[int, int]:
    """(width, least): a window that windows() finds has a stretch of `width` pairs, or all if the text has fewer, with at least `least` hits."""
    shortest = min(lengths)
    if shortest < 3:
        return 1, 0
    width = shortest - 1
    return width, min(-(-max(0, n - 1 - 2 * allowed(n, edit)) // -(-(n - 1) // width)) for n in lengths)


def scores(a: list[int], b: Iterable[int], free: bool) -> Iterator[int]:
    """Edit distances of a to the beginnings of b, empty one left out, by bit-parallel columns; with free, the least over their ends."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full, top, first = (1 << len(a)) - 1, 1 << len(a) - 1, int(not free)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = place.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & full | first, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        yield score


def distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance; most + 1 if it is over most."""
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    score = 0
    for score in scores(a, b, False):  # noqa: B007
        pass
    return min(score, most + 1)


def best_window(item: list[int], text: list[int], most: int, free: bool) -> tuple[int, int, int] | None:
    """(distance, start, words) of the text's first window that is nearest to the item, if it is within most edits."""
    n, last = len(item), len(text) - 1
    near = [(d, last - k) for k, d in enumerate(scores(item[::-1], reversed(text), True)) if d <= most]  # least distance by start
    if not free:
        near = [(distance(item, text[s : s + n], most), s) for _, s in near if s + n <= len(text)]
    d, s = min(near, default=(most + 1, 0))
    if d > most:
        return None
    return d, s, next(k for k, x in enumerate(scores(item, text[s:], False), 1) if x == d) if free else n


def item_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, tokens, n, keys): the items that have words. Stored."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tokens, keys = [], [], []
            for i, x in enumerate(batch.column(1)):
                s = symbols(x.as_py())
                if len(s):
                    at.append(i)
                    tokens.append(s.view(np.int64))
                    group = octave(len(s))
                    room = np.zeros(plan(group)[0] + 1, np.uint64)
                    padded, ends = np.concatenate([room, s, room]), len(room) + np.array([[0], [len(s) - 1]])
                    keys.append(np.concatenate([walk_keys(padded, ends[back], group, bool(back))[0] for back in (0, 1)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(tokens, pa.list_(pa.int64())), pa.array([len(t) for t in tokens], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["item_id", "tokens", "n", "keys"])

    return cut(benchmark.select(id_col, text_col).mapInArrow(lean(run), f"item_id {kind}, tokens array<long>, n int, keys array<long>"), "items")


def filters(items: DataFrame) -> tuple[Filter, Filter]:
    """Filters of the items' pairs and words, and of their keys, as large as their numbers ask for; each partition gives one of either."""
    sizes = items.agg(F.sum(F.col("n").cast("long")), F.sum(F.size("keys").cast("long"))).first()
    sizes = [Filter.bits(x or 1) for x in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, keys = (Filter(x) for x in sizes)
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                s = np.array(x.as_py(), np.int64).view(np.uint64)
                pairs.add(pair_hashes(s) if len(s) > 1 else word_hashes(s))
                keys.add(np.array(y.as_py(), np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([pairs.data.tobytes()], pa.binary()), pa.array([keys.data.tobytes()], pa.binary())], ["pairs", "keys"])

    out = tuple(Filter(x) for x in sizes)
    for row in items.select("tokens", "keys").coalesce(8).mapInArrow(lean(run), "pairs binary, keys binary").toLocalIterator():
        for own, data in zip(out, row, strict=True):
            own.data |= np.frombuffer(data, np.uint64)
    return out


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of groups of about CHUNK characters; no text is divided."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "") + 1
        if size >= CHUNK or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def openings(texts: list[str | None], pairs: Filter, lengths: list[int], edit: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(octave, place of the text, its words, places of those that begin and of those that end a window that windows() finds)."""
    s, counts = symbols_of(texts)
    if not len(s) or not lengths:
        return
    own = np.flatnonzero(counts)
    counts = counts[own]
    hit = np.zeros(len(s), np.int64)
    hit[:-1] = pairs.has(pair_hashes(s))
    hit[np.cumsum(counts) - 1] = 0  # no pair goes across texts
    width, least = sparse_bound(lengths, edit)
    for sparse in (True, False):
        end = np.cumsum(counts)
        sums = np.cumsum(hit) - hit
        first, last = np.repeat(end - counts, counts), np.repeat(end - 1, counts)
        if sparse and least:
            stays = np.maximum.reduceat(sums[np.minimum(np.arange(len(s)) + width, last)] - sums, end - counts) >= least
            if not stays.any():
                return
            words = np.repeat(stays, counts)
            s, hit, own, counts = s[words], hit[words], own[stays], counts[stays]
    word_hit = pairs.has(word_hashes(s)) if lengths[0] == 1 else None
    for g, (begins, ends) in windows(sums, word_hit, first, last, lengths, edit).items():
        bounds = [np.searchsorted(x, [end - counts, end]) for x in (begins, ends)]
        for k in np.flatnonzero(bounds[0][0] < bounds[0][1]):  # a stretch that some beginning finds, its end finds too
            low = end[k] - counts[k]
            yield g, int(own[k]), s[low : end[k]], *(x[b[0, k] : b[1, k]] - low for x, b in zip((begins, ends), bounds, strict=True))


def candidate_regions(df: DataFrame, items: DataFrame, edit: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, region, start, tokens, keys): stretches around the windows that share a key with some item, with these keys."""
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # distinct item lengths in words: no more than the longest item has
    kind = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(filters(items))  # two filters of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known = sent.value
        for batch in batches:
            found: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
            for at, texts in grouped(batch.column(1).to_pylist()):
                for g, i, *part in openings(texts, pairs, lengths, edit):
                    found.setdefault(g, []).append((at + i, *part))
            for g, parts in found.items():
                room = np.zeros(plan(g)[0] + 1, np.uint64)
                tokens = np.concatenate([room, *(y for _, s, _, _ in parts for y in (s, room))])
                first = len(room) + np.cumsum([0, *(len(s) + len(room) for _, s, _, _ in parts)])[:-1]
                longest = (2 << g) - 1
                spare = 2 * allowed(longest, edit)
                begun: list[np.ndarray] = []  # (part, first word of the window with its room, key)
                for back in (False, True):
                    place = [p[2 + back] for p in parts]
                    part = np.repeat(np.arange(len(parts)), [len(p) for p in place])
                    local = np.concatenate(place)
                    starts = local + first[part]
                    for at in range(0, len(starts), BLOCK):
                        keys = walk_keys(tokens, starts[at : at + BLOCK], g, back)
                        row, column = np.nonzero(known.has(keys))
                        low = local[at + row] - spare - (longest - 1 if back else 0)
                        begun.append(np.stack([part[at + row], low, keys[row, column].view(np.int64)]))
                own, low, keys = np.concatenate(begun, 1)
                if not len(own):
                    continue
                cell = low // longest  # windows that begin in one cell share a region
                order = np.lexsort((low, cell, own))
                own, low, keys, cell = own[order], low[order], keys[order], cell[order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (cell[1:] != cell[:-1])]))
                rows, where, names, texts, kept = [], [], [], [], []
                for k, to in zip(new, [*new[1:], len(own)], strict=True):
                    i, s = parts[own[k]][:2]
                    begin = max(0, int(low[k]))
                    text = s[begin : int(low[to - 1]) + longest + 2 * spare].view(np.int64)
                    rows.append(i)
                    where.append(begin)
                    texts.append(text)
                    kept.append(np.unique(keys[k:to]))
                    names.append(blake2b(text.tobytes() + b"%d %d %r" % (begin, g, str(batch.column(0)[i].as_py()).encode()), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names, pa.binary()), pa.array(where, pa.int64()), pa.array(texts, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "region", "start", "tokens", "keys"])

    return df.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {kind}, region binary, start long, tokens array<long>, keys array<long>")


def verified(pairs: DataFrame, edit: float, free: bool) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance) of the pairs within the allowed edits."""
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = [], []
            for i, (start, text, item) in enumerate(zip(*batch.columns[2:], strict=True)):
                item = item.as_py()
                best = best_window(item, text.as_py(), allowed(len(item), edit), free)
                if best:
                    at.append(i)
                    far.append((start.as_py() + best[1], best[2], best[0]))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(2)), *(pa.array([x[c] for x in far], pa.int64()) for c in range(3))], ["doc_id", "item_id", "start", "n_words", "distance"])

    return pairs.select("doc_id", "item_id", "start", "tokens", "item_tokens").mapInArrow(lean(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, n_words long, distance long")


def leaks(df: DataFrame, benchmark: DataFrame, edit: float = EDIT, id_col: str = "doc_id", text_col: str = "text", free_ends: bool = False) -> DataFrame:
    """(id, item_id, start_word, n_words, distance): the best window of each document and item that it leaks, and its words."""
    ship(df.sparkSession)
    named = item_table(benchmark).withColumn("kind", F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")), 256))
    items = named.dropDuplicates(["kind"]).drop("item_id").withColumnRenamed("kind", "item_id")  # equal items are searched for once
    found = cut(candidate_regions(df, items, edit, id_col, text_col), "regions")
    index = items.select("item_id", F.explode("keys").alias("key"))
    near = found.select("region", F.explode("keys").alias("key")).join(index, "key").select("region", "item_id").distinct()
    pairs = near.join(found.dropDuplicates(["region"]).drop("keys"), "region").join(items.select("item_id", F.col("tokens").alias("item_tokens")), "item_id")
    best = verified(pairs, edit, free_ends).groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "n_words")).alias("b"))
    best = best.withColumnRenamed("item_id", "kind").join(named.select("kind", "item_id"), "kind")
    return best.select(F.col("doc_id").alias(id_col), "item_id", F.col("b.start").alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.distance").alias("distance"))
