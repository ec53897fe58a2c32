"""Leaks against edit distances of all windows; recall of the hash at the full number of edits."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from quernstone.llm import decontaminate as d
from quernstone.llm.queries import QUERIES


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_distance():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 20))] for _ in "ab")
        assert d.distance(a, b, 5) == min(edit(a, b), 6)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        kind = rng.randrange(3)
        if kind == 0:
            out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(rng.randrange(len(out)), f"n{rng.randrange(10**6)}")
        else:
            out.pop(rng.randrange(len(out)))
    return out


def test_recall_of_the_hash():
    rng = random.Random(6)
    met = total = 0
    for _ in range(400):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(12, 60))]
        n, pad = len(words), np.zeros(300, np.uint64)
        own = d.walk_keys(np.concatenate([d.symbols(" ".join(words)), pad]), np.zeros(1, np.int64), d.octave(n))
        other = edited(words, d.allowed(n), rng)
        found = d.walk_keys(np.concatenate([d.symbols(" ".join(other)), pad]), np.zeros(1, np.int64), d.octave(n))
        total += 1
        met += bool((own == found).any())
    assert met / total > 0.98


def test_planted_leaks(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(2000)}"
    items = [(i, [word() for _ in range(rng.randint(8, 50))]) for i in range(40)]
    bench = [(i, " ".join(w).title() + ".", "x") for i, w in items] + [(100, None, "x"), (101, "", "x"), (102, "...", "x"), (103, "solitary", "x")]
    docs, planted = [], set()
    for k in range(120):
        text = [word() for _ in range(rng.randint(0, 200))]
        if k % 2:
            i, w = rng.choice(items)
            text += edited(w, d.allowed(len(w)) * (k % 3) // 2, rng)
            planted.add((k, i))
        docs.append((k, "  ".join(text + [word() for _ in range(rng.randint(0, 100))]), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (202, "a Solitary, word", "x"), (None, bench[0][1], "x"), (1, "same id again", "x")]
    out = d.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(bench, "item_id long, text string, doc_id string")).collect()
    found = {(r.doc_id, r.item_id): r for r in out}
    assert len(found) == len(out)
    texts, true = dict((a, b) for a, b, _ in docs[:120]), set()
    for k, text in texts.items():
        words = d.WORDS.findall(text.lower())
        for i, w in items:
            best = min((edit(words[s : s + len(w)], w) for s in range(max(0, len(words) - len(w) + 1)) if len(set(words[s : s + len(w)]) & set(w)) >= len(w) // 2), default=99)
            if best <= d.allowed(len(w)):
                true.add((k, i))
                if (k, i) in found:
                    assert found[k, i].distance == best
    keys = set(found)
    assert (None, 0) in keys and (202, 103) in keys
    keys -= {(None, 0), (202, 103)}
    assert keys <= true and len(keys) >= 0.97 * len(true) and len(true) >= 40


def test_edits_at_one_end(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    items = {i: [word() for _ in range((15, 31, 59)[i % 3])] for i in range(60)}
    docs = []
    for i, w in items.items():
        n, t = len(w), d.allowed(len(w))
        for places in (range(t), range(n - t, n), rng.sample(range(n // 3), t), rng.sample(range(n - n // 3, n), t)):
            changed = [f"new{len(docs)}x{j}" if j in places else x for j, x in enumerate(w)]
            docs.append((i, " ".join([word() for _ in range(30)] + changed + [word() for _ in range(30)])))
    rows = [(k, text) for k, (_, text) in enumerate(docs)]
    out = d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    met = {(r.doc_id, r.item_id) for r in out} & {(k, i) for k, (i, _) in enumerate(docs)}
    assert len(met) >= 0.99 * len(docs)


def nearest(item, words):
    """Least edit distance of the item to any window."""
    row = list(range(len(item) + 1))
    least = len(item)
    for y in words:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != y)))
        row, least = new, min(least, new[-1])
    return least


def test_free_ends(spark):
    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(3000)}"
    items = {i: [word() for _ in range((8, 15, 38, 59)[i % 4])] for i in range(16)}
    texts, planted = {}, set()
    for i, w in items.items():
        n, t = len(w), d.allowed(len(w))
        for kind in range(5):
            x = list(w)
            for j in sorted(rng.sample(range(1, n), t), reverse=True):
                if kind == 0:
                    x.insert(j, "new")
                elif kind == 1:
                    x.pop(j)
            x = [x, x, edited(w, t, rng), w[t:], w[: n - t]][kind]
            planted.add((len(texts), i))
            texts[len(texts)] = [word() for _ in range(20)] + x + [word() for _ in range(20)]
        planted.add((len(texts), i))
        texts[len(texts)] = w[1:]  # shorter than the item, nothing else
    rows = [(k, " ".join(x)) for k, x in texts.items()]
    out = d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"), free_ends=True).collect()
    found = {(r.doc_id, r.item_id): r for r in out}
    assert found.keys() <= planted and len(found) == len(out) and len(found) >= 0.98 * len(planted)
    for (k, i), r in found.items():
        assert r.distance == nearest(items[i], texts[k]) == edit(items[i], texts[k][r.start_word : r.start_word + r.n_words])


def test_query_and_pipeline_take_free_ends(spark, tmp_path):
    item = [f"w{k}" for k in range(15)]
    spark.createDataFrame([(1, " ".join(item[1:])), (2, "clean words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id, r.n_words, r.distance) for r in QUERIES["op3_decontaminate"](spark, str(tmp_path)).collect()] == [(1, 7, 14, 1)]
    assert [r.doc_id for r in corpus_pipeline.decontamination_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()] == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert d.leaks(docs, none).collect() == [] and d.leaks(docs.limit(0), none).collect() == []


def test_equal_items_are_all_named(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(2000)}" for _ in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words).upper()), (None, " ".join(words)), (4, "other things entirely, of another text")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "so " + " ".join(words) + " end"), (8, "nothing of it")], "doc_id long, text string")
    out = d.leaks(docs, bench, free_ends=True).collect()
    assert sorted(((r.doc_id, r.item_id) for r in out), key=str) == sorted([(7, 1), (7, 2), (7, None)], key=str)


def test_filters_grow_with_their_entries():
    rng = np.random.default_rng(3)
    for n in (1, 1000, 50_000):
        held, other = (rng.integers(0, 2**63, n, np.uint64) for _ in "ab")
        f = d.Filter(d.Filter.bits(n))
        f.add(held)
        assert f.has(held).all() and f.has(other).mean() < 1e-3


def test_words_are_read_all_at_once(monkeypatch):
    rng = random.Random(11)
    some = ["a", "b", "aa", "ab", "ba", "İx", "ΣΣ", "straße", "中文", "\U00010400", "é", "_", "x_y", " ", ".", "\n", "7", "١"]
    texts = [None, "", "...", *("".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(300)), "w" * 70_000, " ".join(f"n{k}" for k in range(5000))]
    monkeypatch.setattr(d, "blake2b", None)  # no digest a word
    s, counts = d.symbols_of(texts)
    words = [d.WORDS.findall((x or "").lower()) for x in texts]
    assert counts.tolist() == [len(x) for x in words]
    flat = [x for y in words for x in y]
    assert len(set(zip(flat, s.tolist(), strict=True))) == len(set(flat)) == len(set(s.tolist()))
    assert all((d.symbols(x) == s[end - n : end]).all() for x, n, end in zip(texts, counts, np.cumsum(counts), strict=True))


def test_openings_equal_a_look_at_every_window():
    rng = random.Random(12)
    for lengths in ([15, 18, 31, 40], [1, 2, 9], [3, 5, 64]):
        known = [f"k{x}" for x in range(70)]
        texts = [None, "", " ".join(known)] + [" ".join(rng.choice([f"o{rng.randrange(99)}"] * 2 + [" ".join(known[(k := rng.randrange(50)) : k + rng.randint(1, 20)])] * 2) for _ in range(rng.randint(0, 30))) for _ in range(60)]
        pairs, own = d.Filter(20), d.symbols(" ".join(known))
        pairs.add(d.pair_hashes(own))
        pairs.add(d.word_hashes(own[:9]))
        found = {(g, i): (begins.tolist(), ends.tolist()) for g, i, _, begins, ends in d.openings(texts, pairs, lengths, 0.2)}
        true = {}
        for i, x in enumerate(texts):
            s = d.symbols(x)
            hit, word_hit = pairs.has(d.pair_hashes(s)).tolist(), pairs.has(d.word_hashes(s)).tolist()
            for n in lengths:
                least = n - 1 - 2 * d.allowed(n)
                begins, ends = true.setdefault((d.octave(n), i), (set(), set()))
                begins |= {k for k in range(len(s)) if (word_hit[k] if n == 1 else sum(hit[k : k + n - 1]) >= least)}
                ends |= {k for k in range(len(s)) if (word_hit[k] if n == 1 else sum(hit[max(0, k - n + 1) : k]) >= least)}
        assert found == {at: (sorted(x), sorted(y)) for at, (x, y) in true.items() if x} and found
