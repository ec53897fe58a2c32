"""Removed bytes against counts of all strings; the sample's cover; sorting against plain comparison."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import skew, suffixes


def brute(rows, n):
    count = Counter(b[i : i + n] for _, t, *_ in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - n + 1):
            if count[raw[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_difference_cover():
    for v in (8, 32, 64, 100):
        cover = suffixes.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) < 3 * v**0.5


def test_sorting_finds_equal_strings():
    rng = random.Random(2)
    for _ in range(60):
        core = bytes(rng.choice(b"ab") for _ in range(60))
        pieces, anchor = [], []
        for _ in range(rng.randint(2, 6)):
            left, right = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in "lr")
            if rng.random() < 0.7:
                left = left[:2] + b"abbabaab"[: rng.randint(0, 8)]
            pieces.append(left + core + right + b"z" * rng.randint(0, 9))
            anchor.append(len(left))
        out = suffixes.repeated(np.zeros(len(pieces), np.int64), pieces, np.array(anchor), 64, 16)
        for i, p in enumerate(pieces):
            own = [any(p[s : s + 64] == q[s - anchor[i] + anchor[j] :][:64] for j, q in enumerate(pieces) if j != i and s - anchor[i] + anchor[j] >= 0) for s in range(len(p) - 63)]
            assert out[i].tolist() == own


@pytest.fixture
def rows():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    shared = [text(n) for n in (40, 60, 199, 200, 201, 450)]
    out = []
    for i in range(60):
        out.append((i, text(rng.randint(0, 300)) + rng.choice(shared) + text(rng.randint(0, 300)) + (rng.choice(shared) if i % 3 else ""), "x"))
    out += [(60, None, "x"), (61, "", "x"), (62, "q" * 500, "x"), (63, "xy" * 300, "x"), (64, out[3][1], "x"), (64, out[3][1], "x"), (64, "short", "x"), (None, shared[5] + "!", "x"), (None, None, "x"), (65, text(150) * 3, "x"), (66, "ab" * 90 + shared[5] + "q" * 300, "x")]
    line = text(60)  # one line in many contexts: a bucket of many kinds
    out += [(100 + i, text(rng.randint(80, 200)) + line + text(rng.randint(80, 200)), "x") for i in range(20)]
    return out


@pytest.mark.parametrize(("kinds", "block", "share"), [(2048, 1 << 20, 4096), (1, 1 << 20, 4096), (3, 150, 2), (1, 64, 1)])
def test_all_strings(spark, rows, kinds, block, share, monkeypatch):
    """Buckets divided at most sizes, texts read in blocks, all keys hot or none."""
    monkeypatch.setattr(suffixes, "BUCKET_KINDS", kinds)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    out = sorted((tuple(r) for r in suffixes.deduplicated(df).drop("kept").collect()), key=str)
    assert out == brute(rows, 200)


def test_empty(spark):
    assert suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_cover_all_suffixes():
    """Each suffix is in one run, and its run's place is the first least fingerprint of its first bytes."""
    rng = random.Random(4)
    for text in (bytes(rng.choice(b"ab") for _ in range(900)), b"q" * 500, b"xyz" * 200, bytes(rng.randrange(256) for _ in range(120)) * 6):
        h = suffixes.Prints(text).all(suffixes.GRAM)
        bucket, _, first, last, place = suffixes.runs(text)
        assert [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)] == list(range(len(text) - 199))
        for k, a, b, p in zip(bucket, first, last, place, strict=True):
            assert all(s + int(np.argmin(h[s : s + 153])) == p and h[p] == k for s in range(a, b + 1))


def test_a_long_periodic_text(spark):
    """5 MB of one short line: few rows, one interval."""
    line = "the same line over and over again\n"
    df = spark.createDataFrame([(1, line * 150_000), (2, "z" + line * 9), (3, "q" * 1_000_000)], "doc_id long, text string")
    found, spans = suffixes.kinds_of((line * 150_000).encode())
    assert len(found[0]) < 200 and len(spans) == 1 and spans[0][1] - spans[0][0] > len(line) * 149_990
    out = {r.doc_id: r for r in suffixes.deduplicated(df).collect()}
    assert (out[1].n_removed, out[1].n_spans) == (len(line) * 150_000, 1) and out[3].n_removed == 1_000_000
    assert bytes(out[2].kept) == b"z"
