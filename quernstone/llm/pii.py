"""Personal data: base patterns, and a skip-chain conditional random field over all candidates of a document.

Base: leftmost, non-overlapping matches of each kind that also pass the kind's test; a match that fails is dropped.
Candidates of the field are the base spans and looser strings: digit groups with separators, spelt-out
addresses. Each candidate is a node with the labels none, email, ip, card and phone. Node potentials come from its
shape, its base kind and the words around it; chain edges join neighbours; skip edges join successive candidates
with equal digits, equal last seven digits or equal letters, however far apart. Loopy sum-product messages run to a
fixed point, so a candidate that is unclear by itself takes the label of its clear repetitions. Candidates that are not
base spans and whose probability of a kind is at least `threshold` are added; base spans always stay.

The weights are fitted on the driver by maximum pseudo-likelihood over generated sentences with known labels (fixed seed
and number); no row of a table takes part. Skip edges join a candidate to the previous one with its key, so a document
with n candidates has at most 4 n edges, and time and memory are linear in a document.

Edge cases: null and empty texts have no spans; whole texts are read; rows repeat as given; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.session import lean, ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[(\[] ?(?:at|AT|At) ?[)\]]")
DIGIT = re.compile(r"[0-9]")

#: Candidates of the field: digit groups, and addresses that are spelt out.
LOOSE = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])*+")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?(?:at|AT|At) ?[)\]] ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?(?:dot|DOT|Dot) ?[)\]] ?)[A-Za-z0-9-]+)+")
WORD = re.compile(r"[^\W\d_]+")

#: Words that tell what follows or precedes; a plain list, extend it by parameter where a corpus needs more.
CUES = {"email": {"mail", "email", "contact", "write", "correo", "courriel"}, "ip": {"ip", "host", "server", "address", "ping"}, "card": {"card", "visa", "credit", "payment", "karte", "carte", "tarjeta"}, "phone": {"phone", "tel", "call", "telephone", "mobile", "fax", "telefon", "whatsapp"}}
#: Words after which digits are no personal data.
PLAIN_CUES = {"version", "page", "no", "number", "nr", "id", "order", "item", "total", "section", "chapter", "license", "gpl", "by", "nc", "token", "password", "key", "year", "code"}

TRAIN_SENTENCES, TRAIN_SEED, TRAIN_STEPS = 2000, 7, 200
THRESHOLD = 0.9


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Equal to the leftmost matches of the pattern, in linear time: the local part is the run before each "@"."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, base kind or "none") in order; base spans first, looser strings where they don't overlap any."""
    taken = sorted((s, e, k) for k, s, e in base)
    found, at = list(taken), 0
    starts = [(m.span(), SPELT) for m in SPELT.finditer(text)] if re.search(r"[(\[] ?(?:at|AT|At) ?[)\]]", text) else []
    loose = sorted([x for x, _ in starts] + [m.span() for m in LOOSE.finditer(text)])
    end = -1
    for s, e in loose:
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= end and not (at < len(taken) and taken[at][0] < e):
            found.append((s, e, "none"))
            end = e
    return sorted(found)


def features(text: str, s: int, e: int, kind: str) -> list[str]:
    span = text[s:e]
    digits = re.sub("[^0-9]", "", span)
    n = len(digits)
    before, after = text[max(0, s - 1) : s], text[e : e + 1]
    out = ["bias", f"base={kind}", f"digits={'0' if n == 0 else '1-4' if n < 5 else '5-6' if n < 7 else '7-8' if n < 9 else '9-11' if n < 12 else '12' if n == 12 else '13-19' if n < 20 else '20+'}"]
    out.append(f"shape={'spelt' if re.search('[A-Za-z]', span) else re.sub('[0-9]+', '9', span)[:12]}")
    if before and (before.isalnum() or before in "\"'=_/#$€£"):
        out.append("glued-before")
    if after and (after.isalnum() or after in "\"'=_/%"):
        out.append("glued-after")
    if 13 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    if span.count(".") == 3:
        out.append("three-dots")
    words = [w.lower() for w in WORD.findall(text[max(0, s - 40) : s])[-3:]]
    out += [f"cue={k}" for k, cues in CUES.items() if cues & set(words)]
    if words and words[-1] in PLAIN_CUES:
        out.append("plain-cue")
    return out


def keys(span: str) -> list[str]:
    """What makes two candidates share a label: equal digits, their last seven, or equal letters and digits."""
    digits = re.sub("[^0-9]", "", span)
    if re.search("[A-Za-z@]", span):
        plain = re.sub(r"[(\[] ?(?:at) ?[)\]]", "@", span.lower())
        return ["a" + re.sub("[^a-z0-9]", "", re.sub(r"[(\[] ?dot ?[)\]]", ".", plain))]
    return ["d" + digits, "s" + digits[-7:]] if len(digits) >= 9 else ["d" + digits] if len(digits) >= 7 else []


def edges(text: str, nodes: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(i, j, 0 for chain or 1 for skip)."""
    out, last = [(i, i + 1, 0) for i in range(len(nodes) - 1)], {}
    for i, (s, e, _) in enumerate(nodes):
        for k in keys(text[s:e]):
            if k in last:
                out.append((last[k], i, 1))
            last[k] = i
    return out


class Field:
    """Weights: node[feature] -> 5 values; pair[0] for chain edges and pair[1] for skip edges, 5 x 5."""

    def __init__(self, node: dict[str, np.ndarray], pair: np.ndarray):
        self.node, self.pair = node, pair

    def unary(self, text: str, nodes: list[tuple[int, int, str]]) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        return np.array([sum((self.node.get(f, zero) for f in features(text, s, e, k)), zero) for s, e, k in nodes])

    def marginals(self, text: str, nodes: list[tuple[int, int, str]], rounds: int = 30) -> np.ndarray:
        """Loopy sum-product with damping, all messages at once."""
        own, links = self.unary(text, nodes), edges(text, nodes)
        if links:
            a, b, t = np.array(links).T
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.exp(np.concatenate([self.pair[t], self.pair[t].transpose(0, 2, 1)]))
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(src), len(LABELS)))
            for _ in range(rounds):
                belief = own.copy()
                np.add.at(belief, dst, sent)
                rest = belief[src] - sent[back]
                rest = np.exp(rest - rest.max(1, keepdims=True))
                new = np.log(np.einsum("el,elm->em", rest, table) + 1e-300)
                new -= new.max(1, keepdims=True)
                change, sent = float(np.abs(new - sent).max()), 0.5 * sent + 0.5 * new
                if change < 1e-4:
                    break
            own = own.copy()
            np.add.at(own, dst, sent)
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[str, int, int]], threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
        nodes = candidates(text, base)
        if not any(k == "none" for _, _, k in nodes):
            return []
        p = self.marginals(text, nodes)
        best = p[:, 1:].argmax(1)
        return [(KINDS[best[i]], s, e) for i, (s, e, k) in enumerate(nodes) if k == "none" and p[i, 1 + best[i]] >= threshold]


def generated(rng: random.Random) -> tuple[str, dict[tuple[int, int], str]]:
    """A sentence with known personal data, repeated in other forms, and with digits that are none."""
    word = lambda: "".join(rng.choice(["an", "er", "th", "or", "lo", "mi", "ta", "es", "un"]) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    text, spans = "", {}

    def put(s: str, kind: str = "") -> None:
        nonlocal text
        text += " " * bool(text)
        if kind:
            spans[len(text), len(text) + len(s)] = kind
        text += s

    def prose() -> None:
        for _ in range(rng.randint(2, 7)):
            put(word() + rng.choice(["", "", ",", "."]))

    for _ in range(rng.randint(1, 4)):
        prose()
        what = rng.randrange(12)
        if what == 0:
            name, host = f"{word()}.{num(2)}", f"{word()}.com"
            put(f"{name}@{host}", "email")
            prose()
            if rng.random() < 0.5:
                put(rng.choice([f"{name} (at) {host}", f"{name}[at]{host}", f"{name} (at) {word()} (dot) org"]), "email")
        elif what == 1:
            a, b, c = num(3), num(3), num(4)
            put(f"+1 ({a}) {b}-{c}", "phone")
            prose()
            if rng.random() < 0.7:
                put(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 {a} {b} {c}"]), "phone")
        elif what == 2:
            put(rng.choice(["phone", "tel", "call"]))
            put(rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]), "phone")
        elif what == 3:
            put(".".join(str(rng.randrange(256)) for _ in range(4)), "ip")
        elif what == 4:
            head = "4" + num(14)
            card = next(head + d for d in "0123456789" if luhn(head + d))
            put(card, "card")
            prose()
            if rng.random() < 0.3:
                put(" ".join(card[i : i + 4] for i in range(0, 16, 4)), "card")
        else:  # no personal data
            put(rng.choice(["version", "no", "order", word(), "id", "total", "page"]))
            put(rng.choice([f"{rng.randrange(9)}.{rng.randrange(9)}", f"{rng.randrange(1900, 2030)}-{num(2)}-{num(2)}", num(rng.randint(1, 6)), num(rng.randint(7, 12)), f"{num(3)}.{num(3)}", f"{num(2)}-{num(4)}", num(16), f'"{word()}{num(3)}{word()}{num(9)}{word()}"', f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)}.{num(2)}.{num(1)}.{rng.randint(256, 999)}", f"{word()}{num(5)}", f"{num(3)}-{num(3)}-{num(4)}" if rng.random() < 0.2 else num(5), num(22)]))
    return text, spans


@lru_cache(maxsize=1)
def fitted(sentences: int = TRAIN_SENTENCES, seed: int = TRAIN_SEED, steps: int = TRAIN_STEPS) -> Field:
    """Maximum pseudo-likelihood: each label given its features and its neighbours' labels; ridge penalty."""
    rng = random.Random(seed)
    names: dict[str, int] = {}
    rows, cols, gold, around = [], [], [], []
    for _ in range(sentences):
        text, spans = generated(rng)
        nodes = candidates(text, base_spans(text))
        labels = [next((LABELS.index(k) for (a, b), k in spans.items() if a < e and s < b), 0) for s, e, _ in nodes]
        first = len(gold)
        for (s, e, k), y in zip(nodes, labels, strict=True):
            for f in features(text, s, e, k):
                rows.append(len(gold))
                cols.append(names.setdefault(f, len(names)))
            gold.append(y)
        for i, j, t in edges(text, nodes):
            around += [(first + i, t, labels[j]), (first + j, t, labels[i])]
    n, m, size = len(gold), len(names), len(LABELS)
    rows += [x[0] for x in around]
    cols += [m + x[1] * size + x[2] for x in around]
    rows, cols, gold = np.array(rows), np.array(cols), np.array(gold)
    w, speed, target = np.zeros((m + 2 * size, size)), 0.0, np.eye(size)[gold]
    counts = np.maximum(np.bincount(cols, minlength=len(w)), 1)[:, None]
    for _ in range(steps):  # gradient steps scaled by how often a feature occurs, with momentum
        z = np.zeros((n, size))
        np.add.at(z, rows, w[cols])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.zeros_like(w)
        np.add.at(g, cols, (target - p)[rows])
        speed = 0.8 * speed + 0.4 * (g - 0.3 * w) / np.sqrt(counts * 40)
        w = w + speed / np.sqrt(np.maximum(counts / 40, 1))
    pair = np.stack([w[m + t * size : m + (t + 1) * size] for t in (0, 1)])
    return Field({f: w[i] for f, i in names.items()}, (pair + pair.transpose(0, 2, 1)) / 2)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(text: str | None, field: Field, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(base spans, added spans) of one whole text."""
    if not text or not ANY.search(text):
        return [], []
    base = base_spans(text)
    return base, field.added(text, base, threshold)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become the first one's."""
    out, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of base spans, base_sha256, spans: all spans) of each whole text."""
    ship(df.sparkSession)
    field, kind = fitted(), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                base, more = find(x.as_py(), field, threshold)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return df.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with personal data in text_col replaced by the kind in brackets; all columns stay, null texts too."""
    ship(df.sparkSession)
    field, at = fitted(), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column(at):
                text = x.as_py()
                base, more = find(text, field, threshold)
                texts.append(redact(text, base + more) if base or more else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(lean(run), df.schema)
