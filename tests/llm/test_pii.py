"""Base spans against the plain patterns, the field on repeated forms, messages against exact sums."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np

from quernstone.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["1", "23", "4111111111111111", "255", ".", ".", "@", "@", "a.b", "-", " ", "+", "+1", "(", ")", "x", "\n", "é", "999", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert plain(text) == pii.base_spans(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " x@", "1" * 300_000 + "@", "1." * 200_000, "+1" * 200_000, "a.b" * 100_000 + " (at) x"):
        pii.find(text, pii.fitted())


def test_distant_repetitions_share_a_label():
    field = pii.fitted()
    text = "Call +1 (552) 555-3899 now. " + "word " * 500 + "Or dial (552) 555-3899; version 2.0, page 17, CC BY-NC 4.0, 1999-12-31, order 12345678."
    base, more = pii.find(text, field)
    assert [k for k, _, _ in base] == ["phone"] and [text[s:e] for _, s, e in more] == ["(552) 555-3899"]
    assert "[PHONE]" in pii.redact(text, base + more) and "3899" not in pii.redact(text, base + more)
    assert pii.find("Released 2.0.1 on 2020-01-02 with 1234567 users, see 10.5281/zenodo.123 and 555-3899.", field) == ([], [])


def test_messages_equal_exact_sums_on_a_tree():
    field, text = pii.fitted(), "a 12345 b 555-0000 c 10.0.0.1 d"
    nodes = pii.candidates(text, pii.base_spans(text))
    own, links = field.unary(text, nodes), pii.edges(text, nodes)
    assert all(t == 0 for _, _, t in links)
    total = np.zeros((len(nodes), 5))
    for labels in itertools.product(range(5), repeat=len(nodes)):
        p = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(field.pair[t][labels[i], labels[j]] for i, j, t in links))
        for i, y in enumerate(labels):
            total[i, y] += p
    assert np.allclose(total / total.sum(1, keepdims=True), field.marginals(text, nodes, 200), atol=1e-3)


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.de, 10.0.0.1 + 4111 1111 1111 1111", "x"), (3, "mail a.b@c.de", "x"), (None, "+49 30 1234567", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.spans(df).collect()
    assert len(out) == 5
    one = next(r for r in out if r.n_ip)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 0)
    assert one.base_sha256 == hashlib.sha256(pii.joined(plain(rows[2][1])).encode()).hexdigest()
    assert {r.text for r in pii.redacted(df).collect()} >= {None, "", "mail [EMAIL]", "[PHONE]"}
    assert pii.spans(df.limit(0)).collect() == []
