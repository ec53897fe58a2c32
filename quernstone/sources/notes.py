"""Notes and articles: what a Markdown body refers to, which files that is, and the body with links to stored assets."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.markdown import HEADING, dashed, fence_mask
from quernstone.session import ship

REFERENCES = "path string, line int, kind string, target string, label string, status string, resolved string"
SUPPORTED = (".gif", ".jpeg", ".jpg", ".png", ".svg", ".webp")

HTML = re.compile(r"<(img|a)\b([^>]*)>", re.I)
ATTRIBUTE = re.compile(r"\b(src|href|alt|title)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
URL = re.compile(r"https?://[^\s<>\]\[\"']+")


def slug(title: str) -> str:
    """A heading as links name it."""
    return dashed(title.lower())


def inline(line: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, target, label) of a line's images and links in Markdown, read from each "](" to both sides."""
    floor = at = 0
    while (middle := line.find("](", at)) >= 0:
        at = middle + 2
        begin = line.find("[", max(floor, line.rfind("]", 0, middle) + 1), middle)
        if begin < 0:
            continue
        image, label = line[begin - 1 : begin] == "!", line[begin + 1 : middle]
        place = at + len(line[at:]) - len(line[at:].lstrip())
        if line.startswith("<", place):
            end = line.find(">", place)
            target, place = line[place + 1 : end], end + 1
        else:
            end = next((i for i in range(place, len(line)) if line[i].isspace() or line[i] == ")"), len(line))
            target, place = line[place:end], end
        rest = line[place:].lstrip()
        if rest != line[place:] and rest[:1] in ('"', "'", "(") and rest:  # a title
            shut = rest.find(")" if rest[0] == "(" else rest[0], 1)
            rest = rest[shut + 1 :].lstrip() if shut > 0 else ""
        if end > 0 and target and rest.startswith(")") and (label or image):
            floor = at = len(line) - len(rest) + 1
            yield begin - image, at, "image" if image else "link", target, label


def references(path: str, body: str) -> Iterator[tuple]:
    """(path, line, kind, target, label, status, resolved) of images and links outside fences.

    status is remote, anchor, missing_anchor, escape or local; a local target is resolved against the file's folder.
    """
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    fenced = fence_mask(lines)
    slugs = {slug(m.group(2) or "") for i, line in enumerate(lines) if not fenced[i] and (m := HEADING.match(line))}
    for i, line in enumerate(lines):
        if fenced[i]:
            continue
        marks = list(inline(line))
        found, taken = [(start, kind, target, label) for start, _, kind, target, label in marks], [mark[:2] for mark in marks]
        for m in HTML.finditer(line):
            values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(2))}
            target = values.get("src" if m.group(1).lower() == "img" else "href")
            if target:
                found.append((m.start(), "image" if m.group(1).lower() == "img" else "link", target, values.get("alt") or values.get("title") or ""))
            taken.append(m.span())
        found += [(m.start(), "link", m.group().rstrip(".,;:!?)"), "") for m in URL.finditer(line) if not any(a <= m.start() < b for a, b in taken)]
        for _, kind, target, label in sorted(found):
            parsed, resolved = urlsplit(target), None
            if target.startswith("#"):
                status = "anchor" if unquote(target[1:]).lower() in slugs else "missing_anchor"
            elif parsed.scheme or target.startswith("//"):
                status = "remote"
            else:
                resolved = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(parsed.path)))
                status = "escape" if resolved.startswith(("..", "/")) else "local"
            yield path, i + 1, kind, target, label, status, resolved


def scan(sources: DataFrame) -> DataFrame:
    """REFERENCES of (path, body) rows."""
    ship(sources.sparkSession)
    names = [x.split(" ")[0] for x in REFERENCES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for x in batch.itertuples(index=False) for r in references(x.path, x.body or "")], columns=names)

    return sources.select("path", "body").mapInPandas(run, REFERENCES)


def assets(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, status, asset): each image with the content-addressed name of its file; files is (path, sha256).

    status is stored, remote, missing, unsupported or escape.
    """
    suffix = F.lower(F.regexp_extract("resolved", r"(\.[A-Za-z0-9]+)\z", 1))
    images = found.where("kind = 'image'").select("path", "target", "status", "resolved").distinct()
    met = images.join(files.select(F.col("path").alias("resolved"), "sha256"), "resolved", "left")
    status = F.when(F.col("status") != "local", F.col("status")).when(F.col("sha256").isNull(), "missing").when(~suffix.isin(*SUPPORTED), "unsupported").otherwise("stored")
    return met.select("path", "target", status.alias("status"), F.when(status == "stored", F.concat(F.col("sha256"), suffix)).alias("asset"))


def reference_counts(stored: DataFrame) -> DataFrame:
    """(asset, sources)."""
    return stored.where("asset IS NOT NULL").groupBy("asset").agg(F.count_distinct("path").alias("sources"))


def rewritten(sources: DataFrame, stored: DataFrame, prefix: str = "../assets/") -> DataFrame:
    """sources whose bodies name the stored assets; a body's own references are few, so they travel as one map."""
    maps = stored.where("asset IS NOT NULL").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "asset"))).alias("names"))
    entries = F.map_entries(F.col("names"))
    swap = lambda body, e: F.replace(F.replace(body, F.concat(F.lit("("), e["key"], F.lit(")")), F.concat(F.lit("(" + prefix), e["value"], F.lit(")"))), F.concat(F.lit('"'), e["key"], F.lit('"')), F.concat(F.lit('"' + prefix), e["value"], F.lit('"')))
    return sources.join(maps, "path", "left").withColumn("body", F.when(F.col("names").isNull(), F.col("body")).otherwise(F.aggregate(entries, F.col("body"), swap))).drop("names")
