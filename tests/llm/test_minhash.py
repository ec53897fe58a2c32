"""Components and counts against all pairs."""

from __future__ import annotations

import random

import pytest

from quernstone.llm import minhash
from quernstone.llm.components import components


def brute(rows, k, percent):
    """(id, n_shingles, component) as by all pairs of distinct word sequences."""
    fold = lambda t: tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split())
    first = {}
    for i, t, *_ in rows:
        w = fold(t)
        if w:
            first[w] = min((x for x in (first.get(w), i) if x is not None), default=None)
    seqs = list(first)
    sets = [{w[i : i + k] for i in range(max(1, len(w) - k + 1))} for w in seqs]
    root = list(range(len(seqs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(seqs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, w in enumerate(seqs):
        least[top(i)] = min((x for x in (least.get(top(i)), first[w]) if x is not None), default=None)
    at = {w: i for i, w in enumerate(seqs)}
    return sorted(((i, len(sets[at[w]]) if (w := fold(t)) else 0, least[top(at[w])] if w else i) for i, t, *_ in rows), key=str)


def got(df, k=4, percent=80):
    rows = minhash.near_duplicates(df, k, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.fixture
def copies():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(250):
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 12])):
            x[rng.randrange(len(x))] = word()
        rows.append((i, " ".join(x), "clash"))
    rows += [(i, " ".join(word() for _ in range(40)), "clash") for i in range(250, 300)]
    rows += [(300, None, ""), (301, "", ""), (302, " \t\n", ""), (303, "One Two", ""), (304, "one  two", ""), (305, "one two three", ""), (303, "other text of the same id", ""), (None, "one two", ""), (None, "alone in here now", ""), (306, "É A b c d", ""), (307, "é A b c d", ""), (308, "a b c d e", "")]
    rng.shuffle(rows)
    return rows


def test_all_pairs(spark, copies, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)  # several blocks, some of them dense
    df = spark.createDataFrame(copies, "doc_id long, text string, component_id string")
    assert got(df) == brute(copies, 4, 80)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    out = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}}
