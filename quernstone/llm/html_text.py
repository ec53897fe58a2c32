"""HTML main text by minimum-cut labelling of a page's blocks.

A page is read into tags by HTML's rules for quotes, comments and raw text, in linear time. It is cut into blocks at block-level tags,
and around inline elements that say they are an advert, a notice or the like; scripts, styles and other parts without prose are skipped,
unless their end is missing: then only the tag is. Each block is a node. A logistic classifier gives it a cost of being content and one of being boilerplate, which become the capacities of its links with
source and sink; smoothness links join neighbouring blocks and successive blocks of the same container. The minimum
cut - found by maximum flow - divides content from boilerplate. Blocks whose own cost exceeds all their smoothness links
are settled first, which changes no minimum cut and leaves small graphs.

The classifier's weights are fitted on the driver over generated pages with known blocks (fixed seed and number); no row
of a table takes part. Pages are independent rows: there is no shuffle, and memory is one page's blocks.

White space inside a block becomes one space; blocks are trimmed and joined in page order by one space. Edge cases: null
and empty pages, and pages without content, have the empty text; a quoted value without its end ends at the next >; a nav, form or the like that its
parent's end tag closes says nothing of what it holds; whole pages
are read; rows repeat as given; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.session import ship

#: Elements whose inside is no text of the page, to their end tag or the page's end.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in "script style noscript textarea iframe title".split()}
#: Elements whose inside is no prose, if they have an end tag; those that can't hold one another.
SKIPPED = frozenset("template select svg math object button canvas audio video".split())
FLAT = frozenset("select button canvas audio video form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(["'])|([^\s>]*)))?)""")

CONTAINERS = frozenset("div article section nav aside footer header main form ul ol dl table tbody tr td th blockquote body html figure details fieldset center".split())
ITEMS = frozenset("li dt dd option".split())
BREAKS = CONTAINERS | ITEMS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr br figcaption caption address legend summary option thead tfoot col title head".split())

#: What a class, id or role says of a container; and what tags say. Plain lists.
SAYS = {
    "nav": re.compile(r"\b(?:nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc|tabs?|topbar|toolbar)\b"),
    "ad": re.compile(r"\b(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|dfp|adsense|teaser)\b"),
    "side": re.compile(r"\b(?:side\w*|aside|related|recommended|widgets?|rail|trending|popular|share|social)\b"),
    "foot": re.compile(r"\b(?:foot\w*|copyright|legal|colophon|contentinfo)\b"),
    "head": re.compile(r"\b(?:header|masthead|logo|branding|site-?title)\b"),
    "note": re.compile(r"\b(?:cookie\w*|notices?|alert|consent|gdpr|newsletter|subscribe|popup|modal|overlay|paywall|disclaimer|warning)\b"),
    "comment": re.compile(r"\b(?:comment\w*|repl(?:y|ies)|disqus|discussion|responses?|respond|reader-?\w*)\b"),
    "form": re.compile(r"\b(?:form|search\w*|login|signup|signin)\b"),
    "content": re.compile(r"\b(?:article\w*|content|main|post|entry|story|body|text|prose)\b"),
}
#: Words of the group "side" that say nothing where the same class speaks of text.
SOFT = re.compile(r"\b(?:related|recommended|trending|popular|share|social)\b")
TAG_SAYS = {"nav": "nav", "menu": "nav", "aside": "side", "footer": "foot", "header": "head", "form": "form", "fieldset": "form", "article": "content", "main": "content"}
GROUPS = tuple(SAYS)
HARD = frozenset(("nav", "ad", "side", "foot", "note", "comment", "form"))
FEATURES = ("bias", *GROUPS, "content-only", "no-hint", "words:1", "words:2-4", "words:5-14", "words:15+", "links:none", "links:some", "links:most", "stop", "heading", "item", "notice-mark")
PLACE = {f: i for i, f in enumerate(FEATURES)}

ADJACENT, SIBLING = 0.5, 0.5
TRAIN_PAGES, TRAIN_SEED = 300, 3


@lru_cache(maxsize=4096)
def says_of(value: str) -> frozenset[str]:
    """What a class, id or role says."""
    found = set()
    for name in value.split():
        plain = re.sub("[_-]+", " ", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)).lower()
        if SAYS["content"].search(plain):
            plain = SOFT.sub(" ", plain)
        found |= {g for g, p in SAYS.items() if p.search(plain)}
    return frozenset(found)


def hints(attributes: dict[str, str]) -> tuple[frozenset[str], bool]:
    """(what class, id and role say, whether the element is hidden)."""
    found = frozenset().union(*(says_of(attributes[k]) for k in ("class", "id", "role") if k in attributes))
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "style" in attributes and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"].lower()))
    return found, hidden


class Tag(NamedTuple):
    start: int
    end: int
    name: str  # "" for what is no element
    closing: bool
    empty: bool
    attributes: dict[str, str]


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page in order; a raw element is one tag with its inside, comments and declarations have no name."""
    at, last, size = 0, page.rfind(">"), len(page)
    while m := MARK.search(page, at):
        start, name = m.start(), m.group(2)
        if name is None:
            if m.group() == "<!--":
                short = 4 if page.startswith(">", start + 4) else 5 if page.startswith("->", start + 4) else 0
                end = start + short + 1 if short else page.find("-->", start + 4) + 3
                at = end if end > 2 else size
            else:
                at = page.find(">", start) + 1 or size
            yield Tag(start, at, "", False, False, {})
            continue
        name, at, attributes, empty = name.lower(), m.end(), {}, False
        while True:
            a = ATTRIBUTE.match(page, at) if at <= last else None
            if a is None:  # the page ends inside a tag
                at = size
                break
            at = a.end()
            if a.group(1):
                empty = page[at - 2] == "/"
                break
            value = a.group(4) or ""
            if quote := a.group(3):
                close = page.find(quote, at)
                if close < 0 or page[close + 1 : close + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">") and ">" in page[at:close]:
                    close = page.find(">", at)  # no end of the value: the tag ends here
                    value, at = page[at:close], close if close >= 0 else size
                else:
                    value, at = page[at:close], close + 1
            attributes.setdefault(a.group(2).lower(), value)
        if name in RAW and not m.group(1) and not empty:
            end = RAW[name].search(page, at)
            at = page.find(">", end.end()) + 1 or size if end else size
            yield Tag(start, at, "", False, False, {})
        else:
            yield Tag(start, at, name, bool(m.group(1)), empty, attributes)


def ends(found: list[Tag]) -> tuple[dict[int, int], set[int]]:
    """(place of the end tag of each closed element of SKIPPED, places of containers that an outer end tag closed)."""
    closed: dict[int, int] = {}
    broken: set[int] = set()
    stack: list[tuple[str, int]] = []
    depth: dict[str, list[int]] = {}
    for i, tag in enumerate(found):
        name = tag.name
        if name not in CONTAINERS and name not in SKIPPED:
            continue
        if not tag.closing:
            if not tag.empty:
                if name in FLAT and depth.get(name):
                    k = depth[name].pop()
                    broken.add(stack[k][1])
                    stack[k] = ("", stack[k][1])
                depth.setdefault(name, []).append(len(stack))
                stack.append((name, i))
        elif depth.get(name):
            k = depth[name][-1]
            for other, place in stack[k:]:
                if other:
                    depth[other].pop()
                if place != stack[k][1]:
                    broken.add(place)
            closed[stack[k][1]] = i
            del stack[k:]
    return closed, broken


class Block:
    __slots__ = ("hints", "item", "heading", "linked", "parent", "text")

    def __init__(self, text: str, says: frozenset[str], parent: int, linked: int, heading: bool, item: bool):
        self.text, self.hints, self.parent, self.linked, self.heading, self.item = text, says, parent, linked, heading, item


class Open(NamedTuple):
    name: str
    says: frozenset[str]
    serial: int
    hidden: bool
    kind: int


#: Kinds of open elements: inline ones, paragraphs and items end by themselves when something larger ends or begins.
INLINE, PARAGRAPH, ITEM, CONTAINER = range(4)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack = [Open("", frozenset(), 0, False, CONTAINER)]
    count: dict[str, int] = {}
    parts: list[str] = []
    at, serial, linked, anchor, heading, item = 0, 0, 0, False, False, False

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text and not stack[-1].hidden:
                out.append(Block(text, stack[-1].says, stack[-1].serial, linked, heading, item))
            parts.clear()
        linked = 0

    def pop() -> None:
        count[stack.pop().name] -= 1

    found = list(tags(page))
    closed, broken = ends(found)
    k = -1
    while (k := k + 1) < len(found):
        tag = found[k]
        if tag.start > at:
            parts.append(page[at : tag.start])
            if anchor:
                linked += tag.start - at
        at, name = tag.end, tag.name
        if not name:
            continue
        if name in SKIPPED:
            if k in closed:
                k = closed[k]
                at = found[k].end
            continue
        if name == "br":
            parts.append(" ")
            continue
        larger = name in BREAKS
        if larger:
            flush()
            heading, item = not tag.closing and name in ("h1", "h2", "h3", "h4", "h5", "h6"), not tag.closing and name in ("li", "dt", "dd")
            if name in CONTAINERS:
                anchor = False
        if name == "a":
            anchor = not tag.closing
        if tag.closing:
            if count.get(name):
                inside = len(stack) - 1
                while stack[inside].name != name and (stack[inside].kind != CONTAINER or name in CONTAINERS):
                    inside -= 1
                if stack[inside].name == name:
                    if not larger:
                        flush()
                    while len(stack) > inside:
                        pop()
            continue
        if larger:
            while stack[-1].kind in (INLINE, PARAGRAPH):
                pop()
            if name in ITEMS:
                while stack[-1].kind != CONTAINER:
                    pop()
        if name in VOID or tag.empty and larger:
            continue
        says, hidden = hints(tag.attributes) if tag.attributes else (frozenset(), False)
        above = stack[-1]
        if name in CONTAINERS:
            own = TAG_SAYS.get(name)
            if own == "head" and "content" in above.says or own in HARD and k in broken:
                own = None  # the heading part of an article; an element without an end
            serial += 1
            opened = Open(name, above.says | says | ({own} if own else set()), serial, above.hidden or hidden, CONTAINER)
        elif hidden or (says & HARD if not larger else says - {"head"}):
            if not larger:
                flush()
            kind = INLINE if not larger else ITEM if name in ITEMS else PARAGRAPH
            opened = Open(name, above.says | says - {"head"}, above.serial, above.hidden or hidden, kind)
        else:
            continue
        stack.append(opened)
        count[name] = count.get(name, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=4096)
def hint_columns(says: frozenset[str]) -> tuple[int, ...]:
    out = [0, *(PLACE[g] for g in says)]
    if "content" in says and not HARD & says:
        out.append(PLACE["content-only"])
    if not says:
        out.append(PLACE["no-hint"])
    return tuple(out)


def columns(b: Block) -> tuple[int, ...]:
    """The features that a block has."""
    n = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    out = [*hint_columns(b.hints), PLACE["words:1"] + (n > 1) + (n > 4) + (n > 14), PLACE["links:none"] + (share > 0.05) + (share > 0.6)]
    if b.text[-1] in ".!?:\"”»…。":
        out.append(PLACE["stop"])
    if b.heading:
        out.append(PLACE["heading"])
    if b.item:
        out.append(PLACE["item"])
    if "©" in b.text or "All rights reserved" in b.text:
        out.append(PLACE["notice-mark"])
    return tuple(out)


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Links of neighbours, and of successive blocks of a container."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, ADJACENT if found[i - 1].hints == b.hints else ADJACENT / 4))
        if b.parent in last:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side, where gain is a node's capacity from the source (or, if negative, to the sink)."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        if i != j:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    gain, side = list(gain), [None] * n
    queue = deque(range(n))
    while queue:  # nodes that no smoothness can turn
        i = queue.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if side[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            a, b = (source, i) if gain[i] > 0 else (i, sink)
            room[a][b] = abs(gain[i])
            room[b].setdefault(a, 0.0)
        while True:  # Dinic: levels, then augmenting paths along them
            level, queue = {source: 0}, deque([source])
            while queue:
                i = queue.popleft()
                for j, c in room[i].items():
                    if c > 1e-12 and j not in level:
                        level[j] = level[i] + 1
                        queue.append(j)
            if sink not in level:
                break
            onward, tried = {i: list(room[i]) for i in level}, dict.fromkeys(level, 0)
            path = [source]
            while path:  # a blocking flow: an arc that was tried in vain is not tried again
                i = path[-1]
                if i == sink:
                    steps = list(zip(path, path[1:], strict=False))
                    least = min(room[a][b] for a, b in steps)
                    for a, b in steps:
                        room[a][b] -= least
                        room[b][a] = room[b].get(a, 0.0) + least
                    del path[1 + next(j for j, (a, b) in enumerate(steps) if room[a][b] <= 1e-12) :]
                    continue
                while tried[i] < len(onward[i]):
                    j = onward[i][tried[i]]
                    if room[i][j] > 1e-12 and level.get(j, -1) == level[i] + 1:
                        path.append(j)
                        break
                    tried[i] += 1
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1
        for i in rest:
            side[i] = i in level
    return [bool(x) for x in side]


def labelled(found: list[Block], weights: list[float]) -> list[bool]:
    """Content or not, of each block. A classifier's log-odds are the difference of its two costs."""
    return minimum_cut([sum(weights[c] for c in columns(b)) for b in found], smoothness(found))


def main_text(page: str | None, weights: list[float]) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, keep in zip(found, labelled(found, weights), strict=True) if keep) if found else ""


def generated(rng: random.Random) -> tuple[str, str]:
    """(page, its main text) with the parts that pages have, in various spellings."""
    word = lambda: "".join(rng.choice(["an", "er", "th", "or", "lo", "mi", "ta", "es", "un"]) for _ in range(rng.randint(1, 3)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=3, b=40: line(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n))
    pick = lambda *x: rng.choice(x)

    def boiler() -> str:
        text, inner = sentence(), pick("<p>{}</p>", "{}", "<span>{}</span>")
        return pick(
            f"<nav>{'<ul>' + links(rng.randint(3, 8)) + '</ul>'}</nav>",
            f'<div class="{pick("menu", "navbar", "breadcrumb")}"><ul>{links(4)}</ul></div>',
            f"<nav>{inner.format(text)}</nav>",
            f'<div class="{pick("menu", "toolbar", "pagination")}">{inner.format(text)}</div>',
            f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot")}">{inner.format(text)}</div>',
            f'<aside>{inner.format(text)}<ul>{links(3)}</ul></aside>',
            f'<div id="{pick("sidebar", "related", "widget-1")}"><h3>{line(1, 3)}</h3>{inner.format(text)}</div>',
            f'<div class="{pick("cookie-notice", "notice", "newsletter", "alert", "consent")}">{inner.format(text)} <a href="#">{word()}</a></div>',
            f'<section class="{pick("comments", "comment-list", "replies")}">' + "".join(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            f'<div id="comments"><h3>{word()}</h3><p>{sentence(8, 40)}</p></div>',
            f"<form><label>{word()}</label> <p>{sentence(2, 8)}</p></form>",
            f'<header><div class="logo">{line(1, 3)}</div></header>',
            f"<p><a href='/'>{line(1, 4)}</a></p>",
            f'<p class="{pick("advert", "cookie-notice", "sponsored", "notice", "newsletter", "comment")}">{text}</p>',
        )

    text, body = [], ""
    for _ in range(rng.randint(1, 14)):
        kind = rng.randrange(8)
        if kind == 0:
            h = line(2, 8).capitalize()
            text.append(h)
            body += f"<h2>{h}</h2>"
        elif kind == 1:
            items = [line(1, 12) for _ in range(rng.randint(2, 4))]
            text += items
            body += "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        elif kind == 2 and rng.random() < 0.5:
            body += pick(f'<div class="ad">{sentence()}</div>', f'<aside class="related"><p>{sentence()}</p></aside>', f'<p class="{pick("advert", "ad", "notice", "comment")}">{sentence()}</p>', f'<span class="ad">{sentence(2, 8)}</span>')
        else:
            s = " ".join(sentence(1, 30) for _ in range(rng.randint(1, 4)))
            text.append(s)
            body += f"<p>{s}</p>" if rng.random() < 0.8 else f"<p>{s}<br></p>"
    title = line(3, 10).capitalize()
    wrap = pick("<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main">{}</div>', '<div class="post-body">{}</div>', "<div>{}</div>", "<main>{}</main>")
    before = "".join(boiler() for _ in range(rng.randint(1, 3)))
    after = "".join(boiler() for _ in range(rng.randint(0, 3)))
    foot = pick(f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", f'<div class="footer"><p>{sentence()}</p></div>', f"<footer><p>{sentence()} All rights reserved.</p></footer>")
    return f"<html><head><title>{title}</title></head><body>{before}{wrap.format(f'<h1>{title}</h1>' + body)}{after}{foot}</body></html>", "\n".join([title, *text])


@lru_cache(maxsize=1)
def fitted(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> list[float]:
    """Weights of FEATURES: logistic regression with a ridge penalty, by Newton steps."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        page, text = generated(rng)
        own = {" ".join(line.split()) for line in text.split("\n")}
        for b in blocks(page):
            row = np.zeros(len(FEATURES))
            row[list(columns(b))] = 1
            x.append(row)
            y.append(b.text in own)
    x, y, w = np.array(x), np.array(y, float), np.zeros(len(FEATURES))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    ship(df.sparkSession)
    weights = fitted()
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
