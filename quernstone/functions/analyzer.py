"""The full analyzer: runs of letters, numbers and private-use characters, lower-cased, without Latin diacritics, stemmed.

The stemmer is Porter's algorithm, written from its published description as tables of (suffix, replacement, condition).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quernstone.session import give_back, parts

RUN = regex.compile(r"[\p{L}\p{N}\p{Co}\p{M}]+")

# The suffix tables of Porter's algorithm.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def form(word: str) -> str:
    """The word as v and c: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    return form(word).count("vc") if word else 0


def double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and form(word)[-1] == "c"


def short_end(word: str) -> bool:
    return form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, table):
    """The longest suffix of a table that the word has, as (stem, replacement)."""
    found = [(s, r) for s, r in table if word.endswith(s)]
    if not found:
        return None
    s, r = max(found, key=lambda x: len(x[0]))
    return word[: len(word) - len(s)], r


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if found := longest(word, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))):
        word = "".join(found)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif (cut := next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)) is not None and "v" in form(cut):
        word = cut
        if word.endswith(("at", "bl", "iz")) or measure(word) == 1 and short_end(word):
            word += "e"
        elif double(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in form(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        if (found := longest(word, table)) and measure(found[0]):
            word = "".join(found)
    if (found := longest(word, tuple((s, "") for s in STEP4))) and measure(found[0]) > 1 and not (word.endswith("ion") and found[0][-1:] not in ("s", "t")):
        word = found[0]
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def folded(word: str) -> str:
    """Lower case, Latin letters without their diacritics."""
    if word.isascii():
        return word.lower()
    out = []
    for ch in word.lower():
        plain = unicodedata.normalize("NFD", ch)
        out.append(plain[0] if len(plain) > 1 and plain[0].isascii() and all(unicodedata.combining(c) for c in plain[1:]) else "" if unicodedata.combining(ch) else ch)
    return "".join(out)


def analyze(text: str | None) -> list[str]:
    return [stem(folded(w)) for w in RUN.findall(text or "")]


def _analyzed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for texts in batches:
            for part in parts(texts, texts):
                yield pa.array([analyze(t) for t in part.to_pylist()], pa.list_(pa.string()))
    finally:
        give_back()


def analyzed(text: Column) -> Column:
    """Terms of a text; stemming has no builtin, so Arrow batches go to Python."""
    return F.arrow_udf(_analyzed, ArrayType(StringType()))(text)


POSTING = "array<struct<term: string, tf: long, positions: array<int>>>"


def _postings(texts: list[str | None]) -> pa.Array:
    """POSTING of each text, laid out in flat columns."""
    ends, terms, tf, starts, at = [0], [], [], [0], []
    for text in texts:
        places: dict[str, list[int]] = {}
        for i, term in enumerate(analyze(text)):
            places.setdefault(term, []).append(i)
        for term in sorted(places):
            terms.append(term)
            tf.append(len(places[term]))
            at += places[term]
            starts.append(len(at))
        ends.append(len(terms))
    positions = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at, pa.int32()))
    found = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64()), positions], names=["term", "tf", "positions"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for texts in batches:
            for part in parts(texts, texts):
                yield _postings(part.to_pylist())
    finally:
        give_back()


def counted_terms(text: Column) -> Column:
    """POSTING of a text: its terms with counts and places, made in the batch that stems them, so that postings need no shuffle."""
    return F.arrow_udf(_counted, POSTING)(text)
