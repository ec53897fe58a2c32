"""MinHash near-duplicates: universal hash minima, banding, signature check, exact check, connected components.

A document's set is its distinct k-word shingles (with fewer words, the whole sequence as one; without words, empty and
linked with nothing). Words are separated by ASCII white space and lower-cased A-Z. Documents whose word sequences are
equal form one class from the start, named by a 16-byte digest of the sequence; only classes are compared.

1. One pass over the texts gives each class a signature: ROWS * BANDS minima of multiply-add hashes of its shingles. A second one
   stores the full shingle sets of the classes that share a band with another.
2. Star rounds: in each band's bucket every class is a candidate of one member, the bucket's centre. The candidates are
   confirmed on their full shingle sets and joined to components. A second round takes other centres, for buckets
   that still hold several components.
3. Block round: members of buckets that still hold several components are compared in blocks of bounded size, block by
   block, by their signatures; of the pairs of different components whose signatures agree often enough, the block confirms on full
   sets those that its other links don't join already, so it gives fewer links than it has members. A link is lost only where
   banding or the signature check misses it: with 24 bands of 4, a pair at 0.8 shares no bucket with probability 3e-6, and agrees in
   fewer than 55 of 96 minima with probability 2e-7.
4. Alternating large-star and small-star give each class the least document id of its component; after each round over
   the components found before, not over all links again.

Hot buckets, classes and components: counts and least members come from partial minima and sums, and joins broadcast the few hot keys
(see skew.py); a centre's shingle set is repeated for every PAIRS candidates, and blocks divide a bucket's members over tasks.
Nothing is gathered on the driver but counts.

Edge cases: null, empty and white-space texts have n_shingles 0 and are their own component; rows that repeat an id are
rows of their own whose component is the least id of their class's component; null ids never name a component unless
all its ids are null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import components
from quernstone.llm.skew import split_join
from quernstone.session import cut, drop_cut, lean, ship

BANDS, ROWS, SEED = 24, 4, 20_240_601
#: A pair at the threshold agrees in fewer minima with probability 2e-7.
AGREE = 55
#: Members of a block in the block round; candidates of one centre that share a copy of its set.
BLOCK, PAIRS = 256, 256
WORD_TABLE = 100_000
CHUNK = 4096


class _Words(dict):
    """64-bit digests of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()


def forget() -> None:
    """Empty the table of words."""
    _WORDS.clear()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(min(k, len(w))):
        h = (h ^ w[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def multipliers(n: int = BANDS * ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64, endpoint=False) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64, endpoint=False)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper half of the least value of each hash, 32 bits each."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, CHUNK * 16 // len(a))
    for at in range(0, len(hashes), step):
        np.minimum(least, (hashes[at : at + step, None] * a + b).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the band takes part in it."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in sig.reshape(BANDS, ROWS).T:
        h = (h ^ row) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def signatures(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class binary or null, n_shingles, sig binary) of each row."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers()
        for batch in batches:
            classes, counts, sigs = [], [], []
            for x in batch.column(1):
                words = words_of(x.as_py())
                hashes = shingle_hashes(words, k)
                classes.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                counts.append(len(hashes))
                sigs.append(signature(hashes, a, b).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], ["id", "class", "n_shingles", "sig"])

    return df.select(id_col, text_col).mapInArrow(lean(run, forget), f"id {kind}, class binary, n_shingles long, sig binary")


def bucketed(classes: DataFrame) -> DataFrame:
    """(class, n, key): a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([band_keys(np.frombuffer(x.as_py(), np.uint32)) for x in batch.column(2)])
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys)], ["class", "n", "key"])

    return classes.select("class", "n", "sig").mapInArrow(lean(run, forget), "class binary, n long, key long")


def shingle_sets(df: DataFrame, k: int, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, hashes array<long>) of the wanted (class, id) pairs, from their texts. One row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sets = [], []
            for text, want in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if words and blake2b(b" ".join(words), digest_size=16).digest() == want.as_py():
                    classes.append(want.as_py())
                    sets.append(shingle_hashes(words, k).view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.ListArray.from_arrays(offsets, values)], ["class", "hashes"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = wanted.join(texts, wanted["id"].eqNullSafe(texts["id"])).select("text", "class")
    return found.mapInArrow(lean(run, forget), "class binary, hashes array<long>").dropDuplicates(["class"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(ca, cb): the components of the pairs (a, b, ca, cb) whose full sets reach the threshold. b may be hot."""
    pairs = cut(pairs.distinct(), "pairs")
    counts = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")), "counts")
    dealt = split_join(pairs, counts, ["b"], "m", ["a"]).withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / PAIRS)))
    centres = sets.join(counts.withColumnRenamed("b", "class"), "class").select(F.col("class").alias("b"), F.col("hashes").alias("hb"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / PAIRS) - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha")), "a").join(centres, ["b", "part"])
    common = both.select("ca", "cb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("common"), (F.size("ha") + F.size("hb")).cast("long").alias("total"))
    out = cut(common.where(f"100 * common >= {percent} * (total - common)").select("ca", "cb").distinct(), "links")
    drop_cut(pairs)
    drop_cut(counts)
    return out


def fits(n: str, m: str, percent: int):
    """Sizes that can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def star_pairs(members: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, ca, cb): each member of a bucket with the bucket's centre, which differs from turn to turn; the stored centres)."""
    order = F.xxhash64("class", F.lit(turn))
    least = F.min(F.struct(order.alias("o"), F.col("class").alias("centre"), F.col("n").alias("m"), F.col("comp").alias("cb")))
    centres = cut(members.groupBy("key").agg(least.alias("c"), F.count(F.lit(1)).alias("size")).select("key", "size", "c.centre", "c.m", "c.cb"), "centres")
    found = split_join(members, centres, ["key"], "size", ["class"]).where((F.col("comp") != F.col("cb")) & fits("n", "m", percent))
    return found.select(F.col("class").alias("a"), F.col("centre").alias("b"), F.col("comp").alias("ca"), "cb"), centres


def open_members(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components. Stored."""
    mixed = cut(members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size"), "mixed")
    out = cut(split_join(members, mixed, ["key"], "size", ["class"]).drop("size"), "members")
    drop_cut(mixed)
    return out


def candidates(key: int, same_block: bool, own: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, codes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(member, members behind it) of different components whose sizes and signatures can reach the threshold.

    A pair that shares several bands is given in its first common one only.
    """
    keys = np.stack([band_keys(s) for s in sigs])
    for x in np.flatnonzero(own):
        ys = np.flatnonzero(own)[np.flatnonzero(own) > x] if same_block else np.flatnonzero(~own)
        ys = ys[(codes[ys] != codes[x]) & (100 * np.minimum(sizes[ys], sizes[x]) >= percent * np.maximum(sizes[ys], sizes[x]))]
        ys = ys[(sigs[ys] == sigs[x]).sum(1) >= AGREE] if len(ys) else ys
        if len(ys):
            ys = ys[keys[x][(keys[ys] == keys[x]).argmax(1)] == key]
        if len(ys):
            yield int(x), ys


def opened(group: pa.Table) -> tuple:
    """The components of a group's members, and what candidates() takes of them."""
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    comp = group.column("comp").to_pylist()
    number = {c: x for x, c in enumerate(dict.fromkeys(comp))}
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(comp), -1)
    return comp, (key, i == j, np.array(group.column("own").to_pylist()) == i, sigs, np.array(group.column("n").to_pylist()), np.array([number[c] for c in comp]))


def blocks(members: DataFrame) -> DataFrame:
    """(key, i, j, own, class, n, comp): members of a bucket in blocks of about BLOCK; every pair of different components meets.

    The members of a bucket's largest component need no comparison with each other: their blocks, -1 and down, meet those of the
    others only. The others, few where star rounds have joined most, stand in blocks from 0 on, which meet all blocks.
    """
    counts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = cut(counts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("x"), F.sum("m").alias("all")).select("key", "all", F.col("x.comp").alias("main"), F.ceil(F.col("x.m") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("x.m")) / BLOCK).cast("int").alias("others")), "main")
    rows = split_join(members, main, ["key"], "all", ["class"]).withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.when(F.col("is_main"), -1 - F.pmod(F.xxhash64("class"), F.col("mains")).cast("int")).otherwise(F.pmod(F.xxhash64("class"), F.col("others")).cast("int"))
    rows = rows.withColumn("own", own)
    rest = F.sequence(F.lit(0), F.col("others") - 1)
    meets = F.when(F.col("is_main"), rest).otherwise(F.concat(F.sequence(-F.col("mains"), F.lit(-1)), rest))
    placed = rows.withColumn("other", F.explode(meets))
    return placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "comp")


def block_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(ca, cb): links of components, found in blocks by signatures and confirmed there on full sets. A pair whose members other links
    of the block join already isn't confirmed, so no component is lost."""
    kinds = "key long, i int, j int, own int, class binary, n long, comp binary"

    def compare(group: pa.Table) -> pa.Table:
        """The members that have a candidate."""
        _, what = opened(group)
        part = sorted({z for x, ys in candidates(*what, percent) for z in (x, *ys.tolist())})
        return group.select(["key", "i", "j", "own", "class", "n", "comp"]).take(pa.array(part, pa.int64()))

    def confirmed(group: pa.Table) -> pa.Table:
        comp, what = opened(group)
        sets = [np.array(x, np.int64) for x in group.column("hashes").to_pylist()]
        root = list(range(len(sets)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first: dict[int, int] = {}
        for x, code in enumerate(what[5].tolist()):  # members of one component are joined from the start
            root[x] = first.setdefault(code, x)
        out = []
        for x, ys in candidates(*what, percent):
            for y in ys.tolist():
                if top(x) != top(y):
                    common = len(np.intersect1d(sets[x], sets[y], True))
                    if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        root[top(x)] = top(y)
                        out.append((comp[x], comp[y]))
        return pa.table({"ca": pa.array([p[0] for p in out], pa.binary()), "cb": pa.array([p[1] for p in out], pa.binary())})

    sigs = classes.select("class", "sig")
    compared = cut(blocks(members).join(sigs, "class").groupBy("key", "i", "j").applyInArrow(compare, kinds), "candidates")
    rows = compared.join(sets, "class").join(sigs, "class")
    out = cut(rows.groupBy("key", "i", "j").applyInArrow(confirmed, "ca binary, cb binary").distinct(), "links")
    drop_cut(compared)
    return out


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(class, comp) after components that links (ca, cb) join became one. Stored; comps are deleted."""
    roots = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    sizes = comps.groupBy(F.col("comp").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    moved = cut(roots.where("node <> root").join(sizes, "node").select(F.col("node").alias("comp"), "root", "size"), "moved")
    hot = split_join(comps, moved, ["comp"], "size", ["class"]).select("class", "root")
    out = cut(comps.join(hot, "class", "left").select("class", F.coalesce("root", "comp").alias("comp")), "comps")
    drop_cut(moved)
    drop_cut(comps)
    return out


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df; id is named id_col."""
    rows = cut(signatures(df, k, id_col, text_col), "signatures")
    classes = cut(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    buckets = cut(bucketed(classes), "buckets")
    shared = cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = cut(split_join(buckets, shared, ["key"], "size", ["class"]).drop("size"), "members")
    drop_cut(buckets)
    drop_cut(shared)
    comps = cut(members.select("class", F.col("class").alias("comp")).distinct(), "comps")
    sets = cut(shingle_sets(df, k, comps.select("class").join(classes.select("class", F.col("min_id").alias("id")), "class"), id_col, text_col), "sets")

    for turn in range(3):
        now = members.join(comps, "class")
        if turn:
            now = open_members(now)
            drop_cut(members)
            members = now.drop("comp")
            if now.isEmpty():
                break
        if turn < 2:
            pairs, centres = star_pairs(now, turn, percent)
            links = confirm(pairs, sets, percent)
            drop_cut(centres)
        else:
            links = block_links(now, classes, sets, percent)
        comps = merged(comps, links)
        drop_cut(links)
    drop_cut(members)
    drop_cut(sets)
    named = classes.select("class", "min_id", "copies").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = cut(named.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    named = cut(split_join(named, least, ["comp"], "size", ["class"]).select("class", "component_id", "copies"), "named")
    drop_cut(least)
    drop_cut(comps)
    drop_cut(classes)
    out = split_join(rows.select("id", "n_shingles", "class"), named, ["class"], "copies", ["id"], keep_null=True)
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
