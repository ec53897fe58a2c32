"""Encoding against the tokenizers library, decoding as an exact round trip."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from quernstone.llm import bpe
from quernstone.llm.queries import vocabulary

pytest.importorskip("public_tokenizers")
VOCABULARY = vocabulary()
TEXTS = ["", " ", "Hello world", "don't  stop\n\n\t now ", "naïve café 漢字 🙂", "x<|endoftext|>y <|endoftext|>", "a" * 5000, "\u0085\u00a0\u3000 \u2028z", "1234567 3.14", "\x00\x01"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)


def test_encodes_as_the_library_does(both):
    own, library = both
    rng = random.Random(1)
    drawn = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32, 10])) for _ in range(30)) for _ in range(2000)]
    for text in TEXTS + drawn:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == text


def test_decoding_incomplete_characters(both):
    own, library = both
    ids = library.encode("漢字", add_special_tokens=False).ids
    for n in range(len(ids)):
        assert own.decode(np.array(ids[:n], "<u4").tobytes()) == library.decode(ids[:n], skip_special_tokens=False)


def test_frames(spark, both):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])] + [(1, " ", "again"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.digests(df, VOCABULARY).collect()
    assert len(out) == len(rows)
    encoded = bpe.encode(df, VOCABULARY)
    assert sorted((r.doc_id, r.text) for r in bpe.decode(encoded, VOCABULARY).collect() if r.doc_id is not None) == sorted((i, t or "") for i, t, _ in rows if i is not None)
    assert bpe.digests(df.limit(0), VOCABULARY).collect() == []


def test_classes_of_all_characters(both):
    own, _ = both
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for i in [*range(0x3500), *range(0xA000, 0xAC00), *range(0xF900, 0x20000, 3), *range(0x2A000, 0x34000, 7), *range(0x3C000, 0x40000, 11), *range(0xE0000, 0xE0200)]:
        if not 0xD800 <= i < 0xE000:
            text = f"a{chr(i)} 1{chr(i)} !{chr(i)}"
            assert own._plain(text) is not None and len((own.find if own.high(text) else own.find_low)(text)) == len(split(text)), hex(i)
