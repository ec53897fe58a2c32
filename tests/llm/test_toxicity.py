"""Kernel against all subsequences, held-out accuracy, edge cases."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np

from quernstone.llm import toxicity as t


def plain_map(string):
    """Triples of one string that spans at most WIDTH characters."""
    out = Counter()
    for i, j, k in itertools.combinations(range(len(string)), 3):
        if k - i < t.WIDTH:
            out[string[i] + string[j] + string[k]] += t.gap(j - i) * t.gap(k - j)
    return out


def test_kernel():
    words, marks = ["idiot", "idixot", "aaaa", "abcabc", "there", "zzz", "x" * 40 + "idiot"], ["idiot", "abc", "aaa", "three"]
    ends = lambda w: t.FIRST + w + t.LAST
    triples = t.Triples.of(marks)
    known = [plain_map(ends(m)) for m in marks]
    out = triples.map([ends(w) for w in words])
    assert out.shape[1] == len({k for m in known for k in m})
    gram = out @ triples.map([ends(m) for m in marks]).T
    assert np.allclose(gram, [[sum(v * m[k] for k, v in plain_map(ends(w)).items()) for m in known] for w in words])


def test_best_windows_against_all_windows():
    rng = random.Random(5)
    marks = ["stupid", "scum", "worthless"]
    machine = t.Machine(marks, [])
    model = machine.model
    model.weights = np.array([rng.uniform(-1, 1) for _ in model.weights])
    value = lambda w: float(machine.triples.map([w])[0] @ model.weights) / t.DIVISOR[len(w)]
    words = ["stupid", "a", "ab", "", "st" * 30, "scumworthstuless" * 3] + ["".join(rng.choice("stupidcmworhle") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    for word, rated, window in zip(words, model.rate(words), model.windows(words), strict=True):
        full = t.FIRST + word + t.LAST
        best = max((value(full[i:j]) for i in range(len(full)) for j in range(i + 3, min(len(full), i + t.WIDTH) + 1)), default=-np.inf)
        assert rated == best == -np.inf or abs(rated - best) < 1e-4 and abs(value(window) - best) < 1e-4


def sentences(n, rng):
    word = lambda: "".join(rng.choice(["an", "er", "th", "or", "lo", "mi", "ta"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(3, 40))]
        bad = rng.random() < 0.2
        if bad:
            insult = rng.choice(["stupid", "worthless", "pathetic"])
            w.insert(rng.randrange(len(w)), rng.choice([insult, insult.upper() + "!!", insult[:3] + "*" + insult[3:], " ".join(insult)]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = sentences(1500, random.Random(3))
    df = spark.createDataFrame([(i, x, "c") for i, x, _ in rows] + [(5000, None, "c"), (5001, "", "c"), (None, "stupid", "c"), (1, rows[1][1], "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, 1), (3, None), (4, 7), (None, 1), (2, rows[2][2])], "doc_id long, toxic int")
    out = t.score(df, t.trained(df, labels)).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert next(r for r in out if r.doc_id == 5000).predicted == 0


def test_held_out_labels_are_not_read(spark):
    rows = sentences(300, random.Random(4))
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - y if t.held_out(i) else y) for i, _, y in rows]
    scores = [sorted(tuple(r) for r in t.score(df, t.trained(df, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()) for x in ([(i, y) for i, _, y in rows], turned)]
    assert scores[0] == scores[1]


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in t.score(df, t.trained(df, none)).collect()} == {0.0}
    assert t.score(df.limit(0), t.trained(df.limit(0), none)).collect() == []


def test_gapped_and_padded_insults(spark):
    """Forms that no training text has; harmless words of the same syllables stay clean."""
    rows = sentences(1500, random.Random(3))
    model = t.trained(spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    score = lambda w: model.scores([f"anor thlo {w} mita loer"])[0]
    for word in ("stupid", "s.t.u.p.i.d", "stXupXid", "stuuuupid", "stXXXXpid", "astupidword", "st up id", "s  t\nu p id", "stuqpid", "wortxhless", "pathhhetic", "worthlessness", "x" * 300 + "stupid" + "y" * 300):
        assert score(word) > 0.5, word
    for word in ("anormi", "thorlomi", "talomithor", "an or ta lo", "", "x" * 5000, "mi" * 2000):
        assert score(word) < 0.5, word


def test_labels_without_spaces_and_with_many_characters(spark):
    rng = random.Random(6)
    sign = lambda: chr(0x4E00 + rng.randrange(2000))
    rows = []
    for i in range(400):
        text, bad = [sign() for _ in range(rng.randint(5, 60))], rng.random() < 0.3
        if bad:
            text.insert(rng.randrange(len(text)), " \u50bb\u74dc\u86cb ")
        rows.append((i, "".join(text), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in t.score(df, t.trained(df, df)).collect()}
    held = [r for r in out.values() if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) / len(held) > 0.95
