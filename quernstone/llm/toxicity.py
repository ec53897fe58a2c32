"""Toxicity: a gap-weighted subsequence-kernel support vector machine with Nystroem landmarks.

The kernel of two strings counts their common subsequences of three characters. An occurrence whose characters stand side by side
weighs 1; a gap costs OPEN and EXTEND for each further character in it, so that an insult with inserted characters stays near itself.
An occurrence spans at most WIDTH characters. A string is divided by a function of its length alone (which keeps the kernel positive
definite), so foreign characters dilute it slowly. Words carry a mark at each end, which takes part as a character.

A word is rated by its best window of up to WIDTH characters, so an insult inside a longer word, or inside text without spaces,
counts in full, and words of any length are treated alike. Landmarks are words of the training sentences; the Nystroem map
K(landmarks)^(-1/2) k(window) is the machine's input. As the machine is linear in it, it collapses to one weight for each character
triple of the landmarks: a sorted list of triples, not a table over the alphabet.

The machine is trained on labelled texts as bags of words, in turns: with the machine so far, each toxic text gives its worst word
if that looks toxic, each clean text its worst ones. Gapped and stretched forms of the toxic words are added to them as virtual
examples. A logistic function of a text's three worst words gives the score. Runs of tokens of one or two characters ("st u p id")
are also read as one word, and words with marks inside also without them.

Training reads a bounded sample: at most `train_rows` labelled rows, those with the least hash of their id, and never a held-out row.
The labels' ids are joined by broadcast, as that bound proves their size. Bags and counts stay in Spark; the driver gets landmarks, at
most three words a training row in each turn, and four numbers a training row. Scoring reads every whole text.

Edge cases: null and empty texts score as texts without words; labels that are null or neither 0 nor 1 are skipped; with
no toxic or no clean training row every score is the share of toxic ones (0 without labels); rows repeat as given;
an id with several labels is used once, with the largest, and with the least of its texts; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut, drop_cut, lean, ship

OPEN, EXTEND, WIDTH = 0.3, 0.9, 14
#: Power of the length norm: 1 would be the cosine, 0 none.
NORM = 0.5
TOXIC_LANDMARKS, CLEAN_LANDMARKS, TURNS = 96, 32, 4
#: Likelihood ratio statistic from which on a word counts as toxic (one in a million clean words has it); without any such word, the first few do.
SURE, UNSURE = 24.0, 8
#: Landmarks have 2 to this many characters.
LONGEST = 2 * WIDTH
#: Gapped and stretched forms of each toxic word; the machine's ridge penalty a row.
VIRTUAL, RIDGE = 12, 1e-3
TRAIN_ROWS = 6000
WORD_TABLE = 200_000
#: Characters rated at a time; one word is never divided.
CHUNK = 1 << 15
SHORT_RUN = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}(?!\S))+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = re.compile(r"[\W_]+")
FIRST, LAST = "\x02", "\x03"


def words_of(text: str | None) -> set[str]:
    """The words of a text, lower-cased, and its runs of short tokens as words."""
    if not text:
        return set()
    low = text.lower()
    out = set(low.split())
    for m in SHORT_RUN.finditer(low):
        parts = m.group().split()
        if len(parts) > 2:
            out.add("".join(parts))
    return out


def forms(word: str) -> list[str]:
    """A word without edge marks, and without any marks."""
    if word.isalnum():
        return [word]
    plain = EDGE.sub("", word)
    bare = MARKS.sub("", plain)
    return [x for x in ({plain: 0, bare: 0} if bare else {}) if x]


def gap(step: int) -> float:
    return 1.0 if step == 1 else OPEN * EXTEND ** (step - 2)


def lengths_norm() -> np.ndarray:
    """The divisor of a window of each length: the length's own kernel, were all its triples different, to the power of NORM / 2."""
    out = np.ones(WIDTH + 1)
    for m in range(3, WIDTH + 1):
        own = sum((m - b) * sum((gap(a) * gap(b - a)) ** 2 for a in range(1, b)) for b in range(2, m))
        out[m] = own ** (NORM / 2)
    return out


DIVISOR = lengths_norm()


@dataclass
class Stream:
    """Words one after another: code points, how many of its word stand from each place on, first places."""

    points: np.ndarray
    left: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: list[str], first: str = FIRST, last: str = LAST) -> Stream:
        marked = [first + w + last for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum(sizes)
        return cls(points, np.repeat(end, sizes) - np.arange(len(points)), end - sizes)


@dataclass
class Triples:
    """The character triples of the landmarks: their characters, and sorted codes of first, last and middle character."""

    chars: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, landmarks: list[str]) -> Triples:
        text = Stream.of(landmarks)
        out = cls(np.unique(text.points), np.zeros(0, np.int64))
        found = [c for _, c, _, _ in out.each(text)]
        return cls(out.chars, np.unique(np.concatenate(found)) if found else out.codes)

    def __post_init__(self):
        size = len(self.chars) + 1
        self.ends = np.full(size * size, not len(self.codes))
        self.ends[self.codes // size] = True
        self.code_of = np.zeros(int(self.chars.max(initial=0)) + 2, np.int64)
        self.code_of[self.chars] = np.arange(1, size)
        # the codes in an open-addressing table, an eighth full
        self.bits = max(4, (8 * len(self.codes)).bit_length())
        self.slots, self.at = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        for i, (code, h) in enumerate(zip(self.codes.tolist(), self.slot(self.codes).tolist(), strict=True)):
            while self.slots[h] >= 0:
                h = (h + 1) % (1 << self.bits)
            self.slots[h], self.at[h] = code, i

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def each(self, text: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, int, float]]:
        """(first places, codes, span, weight) of the triples of known characters, for each pair of steps; with codes, of
        those triples only whose first and last characters some landmark has."""
        if not len(self.chars):
            return
        code = self.code_of[np.minimum(text.points, len(self.code_of) - 1)]
        size = len(self.chars) + 1
        open_places = np.flatnonzero((text.left > 2) & (code > 0))
        for b in range(2, WIDTH):
            open_places = open_places[text.left[open_places] > b]
            first, last = code[open_places], code[open_places + b]
            ends = first * size + last
            hit = np.flatnonzero((last > 0) & self.ends[ends])
            if not len(hit):
                continue
            places, ends = open_places[hit], ends[hit] * size
            for a in range(1, b):
                mid = code[places + a]
                known = np.flatnonzero(mid)
                yield places[known], (ends + mid)[known], b, gap(a) * gap(b - a)

    def number(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code among the landmarks' triples, or -1."""
        out, left = np.full(len(codes), -1), np.arange(len(codes))
        h = self.slot(codes)
        while len(left):
            seen = self.slots[h]
            hit = seen == codes
            out[left[hit]] = self.at[h[hit]]
            more = np.flatnonzero((seen >= 0) & ~hit)
            left, codes, h = left[more], codes[more], (h[more] + 1) % len(self.slots)
        return out

    def map(self, strings: list[str]) -> np.ndarray:
        """Weight of each landmark triple in each string, which has its end marks as characters; rows are strings."""
        out = np.zeros((len(strings), len(self.codes)))
        text = Stream.of(strings, "", "")
        row = np.repeat(np.arange(len(strings)), [len(w) for w in strings])
        for places, codes, _, weight in self.each(text):
            n = self.number(codes)
            hit = n >= 0
            np.add.at(out, (row[places[hit]], n[hit]), weight)
        return out


@dataclass
class Model:
    """weights: of each landmark triple; bias; logit: of a text's features; constant: a score for all, if not None."""

    triples: Triples
    weights: np.ndarray
    bias: float
    logit: np.ndarray
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def sums(self, text: Stream) -> Iterator[tuple[int, np.ndarray]]:
        """(length, value of the window of that length from each place that has one, else -inf), bias left out."""
        n = len(text.points)
        ending = np.zeros((WIDTH, n), np.float32)  # by span: sum of the triples from a place to that far behind it
        for places, codes, b, weight in self.triples.each(text):
            at = self.triples.number(codes)
            hit = np.flatnonzero(at >= 0)
            ending[b, places[hit]] += (weight * self.weights[at[hit]]).astype(np.float32)
        # all triples inside a window: those of the windows one shorter, less what both hold, and those at both ends
        now, before = np.zeros(n + 1, np.float32), np.zeros(n + 1, np.float32)
        for b in range(2, WIDTH):
            follow = ending[b]
            follow += now[:-1]
            follow += now[1:]
            follow -= before[1:]
            before, now = now, np.append(follow, np.float32(0))
            yield b + 1, np.where(text.left > b, follow * np.float32(1 / DIVISOR[b + 1]), np.float32(-np.inf))

    def windows(self, words: list[str]) -> list[str]:
        """Each word's best window, with end marks as characters where it reaches an end."""
        if not words:
            return []
        text = Stream.of(words)
        best, length = np.full(len(text.points), -np.inf, np.float32), np.ones(len(text.points), np.int64)
        for m, value in self.sums(text):
            better = value > best
            best[better], length[better] = value[better], m
        top = np.maximum.reduceat(best, text.first)
        row = np.repeat(np.arange(len(words)), np.diff(np.append(text.first, len(best))))
        places = np.flatnonzero(best == top[row])
        start = np.zeros(len(words), np.int64)
        start[row[places][::-1]] = places[::-1]
        return [(FIRST + w + LAST)[s : s + n] for w, s, n in zip(words, (start - text.first).tolist(), length[start].tolist(), strict=True)]

    def rate(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word's best window."""
        out, at, size = [], 0, 0
        for i, w in enumerate(words):
            size += len(w) + 2
            if size >= CHUNK or i + 1 == len(words):
                text = Stream.of(words[at : i + 1])
                best = np.full(len(text.points), -np.inf, np.float32)
                for _, value in self.sums(text):
                    np.maximum(best, value, out=best)
                out.append(np.maximum.reduceat(best, text.first).astype(float) + self.bias)
                at, size = i + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def emptied(self) -> Model:
        """This model without the words that a task before it met; Python workers are used again, so tables would add up."""
        self.known.clear()
        return self

    def learn(self, bags: list[set[str]]) -> None:
        """Put the values of words not met before into the table, all at once."""
        new = list(set().union(*bags).difference(self.known))
        if len(self.known) + len(new) > WORD_TABLE:
            self.known.clear()
            new = list(set().union(*bags))
        parts = [forms(w) for w in new]
        values = self.rate([p for x in parts for p in x]).tolist()
        at = 0
        for w, x in zip(new, parts, strict=True):
            self.known[w] = max(values[at : at + len(x)], default=self.bias)
            at += len(x)

    def worst(self, bags: list[set[str]], count: int = 3) -> list[list[tuple[float, str]]]:
        """The worst words of each bag, the worst first; ties by the word."""
        self.learn(bags)
        out = []
        for bag in bags:
            words = list(bag)
            v = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            least = np.partition(v, -count)[-count] if len(v) > count else -np.inf
            top = sorted(((-v[i], words[i]) for i in np.flatnonzero(v >= least)))[:count]
            out.append([(-x, w) for x, w in top])
        return out

    def features(self, bags: list[set[str]]) -> np.ndarray:
        """The values of the three worst words, and 1."""
        self.learn(bags)
        out = np.full((len(bags), 4), self.bias)
        for i, bag in enumerate(bags):
            v = np.fromiter(map(self.known.__getitem__, bag), float, len(bag))
            top = np.sort(np.partition(v, -3)[-3:] if len(v) > 3 else v)[::-1]
            out[i, : len(top)] = top
        out[:, 3] = 1
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features([words_of(t) for t in texts]) @ self.logit, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Linear machine by Newton steps on the rows inside the margin; the last column is the bias."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] *= 0.01
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if not inside.any():
            break
        xi, wi = x[inside], weight[inside][:, None]
        new = np.linalg.solve(xi.T @ (wi * xi) + penalty, xi.T @ (wi[:, 0] * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def virtual(word: str, letters: str, rng: random.Random) -> str:
    """A gapped or stretched form of a word."""
    at, kind = rng.randrange(1, len(word)), rng.randrange(3)
    if kind == 0:  # a stretched character
        return word[:at] + word[at - 1] * rng.randint(1, 3) + word[at:]
    if kind == 1:  # one wide gap, in place of a character or between two
        return word[:at] + rng.choice(letters) * rng.randint(2, 5) + word[at + rng.randrange(2) :]
    out = list(word)
    for _ in range(rng.randint(1, 3)):
        out.insert(rng.randrange(1, len(out)), rng.choice(letters))
    return "".join(out)


class Machine:
    """The machine over the landmarks, and the windows of clean texts that it has met."""

    def __init__(self, toxic: list[str], clean: list[str]):
        landmarks = toxic + clean
        self.letters = "".join(sorted(set("".join(landmarks)))) + "\x01"
        self.triples = Triples.of(landmarks)
        self.landmarks = self.triples.map([FIRST + w + LAST for w in landmarks])
        self.landmarks /= np.maximum(np.linalg.norm(self.landmarks, axis=1), 1e-9)[:, None]
        values, vectors = np.linalg.eigh(self.landmarks @ self.landmarks.T + 1e-6 * np.eye(len(landmarks)))
        self.root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
        self.hard: dict[str, float] = {}
        self.model = Model(self.triples, np.zeros(len(self.triples.codes)), 0.0, np.zeros(4))

    def inputs(self, windows: list[str]) -> np.ndarray:
        """The Nystroem map of windows, and a column of ones."""
        out = [np.ones((0, len(self.root) + 1))]
        for at in range(0, len(windows), 256):
            part = windows[at : at + 256]
            x = self.triples.map(part) / DIVISOR[[len(w) for w in part]][:, None]
            out.append(np.column_stack([x @ self.landmarks.T @ self.root, np.ones(len(x))]))
        return np.concatenate(out)

    def train(self, positive: dict[str, float], negative: dict[str, float]) -> Model:
        """Fit on weighted words of toxic texts and windows of clean ones; the latter stay from turn to turn."""
        self.hard |= negative
        rng, words = random.Random(7), sorted(positive)
        extra = [(virtual(w, self.letters, rng), 3 * positive[w] / VIRTUAL) for w in words for _ in range(VIRTUAL) if len(w) > 2]
        good, bad = self.model.windows(words + [w for w, _ in extra]), sorted(self.hard)
        weight = np.array([positive[w] for w in words] + [x for _, x in extra] + [self.hard[w] for w in bad])
        sign = np.array([1.0] * len(good) + [-1.0] * len(bad))
        for side in (sign > 0, sign < 0):
            weight[side] *= len(sign) / 2 / max(1e-9, weight[side].sum())
        w = squared_hinge(self.inputs(good + bad), sign, weight, RIDGE * len(sign))
        self.model = Model(self.triples, self.landmarks.T @ (self.root @ w[:-1]), float(w[-1]), np.zeros(4))
        return self.model


def copy_key(text: str | None) -> int:
    """Least hash of a text's three-word shingles: near copies mostly share it, other texts don't."""
    words = (text or "").lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(df: DataFrame, labels: DataFrame, train_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label): the bounded sample."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0))
    chosen = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def bags(rows: DataFrame) -> DataFrame:
    """(label, words array<string>) of training rows (id, text, label), one of each group of near copies with one label. Stored."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([copy_key(t) for t in texts], pa.int64()), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))], ["id", "label", "copy", "words"])

    found = rows.select("id", "text", "label").mapInArrow(lean(run), f"id {kind}, label int, copy long, words array<string>")
    return cut(found.groupBy("label", "copy").agg(F.min_by("words", "id").alias("words")).select("label", "words"), "bags")


def word_counts(held: DataFrame) -> DataFrame:
    """(form, toxic, clean): how many bags of either label hold each form of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                found = [sorted({f for w in x for f in forms(w) if 1 < len(f) <= LONGEST}) for x in part.column(1).to_pylist()]
                place = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(place), pa.array([f for x in found for f in x], pa.string())], ["label", "form"])

    forms_of = held.select("label", "words").mapInArrow(lean(run), "label int, form string")
    return forms_of.groupBy("form").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def landmarks(held: DataFrame, n1: int, n0: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words that toxic bags have far more often, by the likelihood ratio, and the words that most clean bags have; with their counts."""
    n, a, b = float(n1 + n0), F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda seen, hoped: F.when(seen > 0, seen * F.ln(seen / hoped)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * n1 / n) + part(b, (a + b) * n0 / n) + part(n1 - a, (n - a - b) * n1 / n) + part(n0 - b, (n - a - b) * n0 / n))
    counts = cut(word_counts(held), "words")
    first = counts.where(a * n0 > b * n1).select("form", "toxic", F.round(ratio, 6).alias("ratio")).orderBy(F.desc("ratio"), "form").limit(TOXIC_LANDMARKS).collect()
    sure = [r for r in first if r["ratio"] >= SURE] or first[:UNSURE]
    toxic = {r["form"]: float(r["toxic"]) for r in sure}
    often = counts.where("clean > 0").orderBy(F.desc("clean"), "form").limit(TOXIC_LANDMARKS + CLEAN_LANDMARKS).collect()
    drop_cut(counts)
    return toxic, {r["form"]: float(r["clean"]) for r in [r for r in often if r["form"] not in toxic][:CLEAN_LANDMARKS]}


def turn(held: DataFrame, model: Model) -> tuple[dict[str, float], dict[str, float]]:
    """Windows of the worst words: of each toxic bag, if it looks toxic, and of each clean one; with the numbers of bags."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.emptied()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                labels = part.column(0).to_pylist()
                found = own.worst([set(x) for x in part.column(1).to_pylist()])
                words = [(y, f) for y, top in zip(labels, found, strict=True) for v, w in (top[:1] if y else top) if v > 0 or not y for f in forms(w)]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in words], pa.int32()), pa.array(own.windows([w for _, w in words]), pa.string())], ["label", "window"])
        own.emptied()

    found = held.mapInArrow(lean(run), "label int, window string").groupBy("label", "window").agg(F.count(F.lit(1)).alias("n")).collect()
    sent.unpersist()
    of = lambda y: {r["window"]: float(r["n"]) for r in found if r["label"] == y}
    return {w.strip(FIRST + LAST): n for w, n in of(1).items()}, of(0)


def bag_features(held: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of each bag."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.emptied()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                x = own.features([set(w) for w in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, i]) for i in range(3))], ["label", "x", "y", "z"])
        own.emptied()

    rows = np.array(sorted(tuple(r) for r in held.mapInArrow(lean(run), "label int, x double, y double, z double").collect()), float).reshape(-1, 4)
    sent.unpersist()
    return np.column_stack([rows[:, 1:], np.ones(len(rows))]), rows[:, 0]


def trained(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on labelled texts; see the module's text."""
    ship(df.sparkSession)
    rows = training_rows(df, labels, train_rows, id_col, text_col, label_col).where("text IS NOT NULL")
    held = bags(rows)
    sizes = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    toxic, clean = landmarks(held, n1, n0) if n1 and n0 else ({}, {})
    if not toxic:
        drop_cut(held)
        return Model(Triples.of([]), np.zeros(0), 0.0, np.zeros(4), n1 / (n1 + n0) if n1 + n0 else 0.0)
    machine = Machine(list(toxic), list(clean))
    model = machine.train(toxic, {(FIRST + w + LAST)[:WIDTH]: n for w, n in clean.items()})
    for _ in range(TURNS):
        witness, hard = turn(held, model)
        model = machine.train({w: max(witness.get(w, 0.0), toxic.get(w, 0.0)) for w in witness | toxic if w}, hard)
    x, y = bag_features(held, model)
    drop_cut(held)
    model.logit = logistic(x, y)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    ship(df.sparkSession)
    sent, kind = df.sparkSession.sparkContext.broadcast(model), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.emptied()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                p = own.scores(part.column(1).to_pylist())
                held = [held_out(x) if x is not None else False for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])
        own.emptied()

    return df.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def kept(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that score under 0.5, all columns."""
    ship(df.sparkSession)
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.emptied()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array(own.scores(part.column(at).to_pylist()) < 0.5))
        own.emptied()

    return df.mapInArrow(lean(run), df.schema)
