"""Archives as exact round trips, revisits against a direct grouping."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pytest

from quernstone.llm import warc


def run(df, **options):
    found = warc.resolve(warc.heads(warc.write(warc.deduplicate(df, **options))))
    return sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def expected(rows, least=0):
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        same = [j for j, _, h, *_ in rows if (h or "") == (html or "") and j is not None]
        keep = max(same, default=None) if len(raw) >= least else i
        revisit = keep is not None and keep != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>", "z"), (2, "http://b/", "<p>x</p>", "z"), (3, None, None, "z"), (4, "http://c/\r\nX: y", "", "z"), (5, "http://d/", "é" * 70000, "z"), (6, "http://d/", "a\r\n\r\nb", "z"), (2, "http://b/", "<p>x</p>", "z"), (2, "u", "other", "z"), (None, "u", "<p>x</p>", "z"), (None, "u", "alone", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    assert run(df) == expected(rows)
    assert run(df, min_bytes=9) == expected(rows, 9)
    assert run(df.limit(0)) == []


def test_segments_are_gzip_members(spark):
    df = spark.createDataFrame([(i, "u", f"page {i % 3}") for i in range(20)], "page_id long, url string, html string")
    stored = warc.write(warc.deduplicate(df)).collect()
    assert sum(r.records for r in stored) == 20
    raw = zlib.decompressobj(31).decompress(bytes(stored[0].content))
    headers, block = warc.parse(raw)
    assert headers["warc-type"] in ("response", "revisit") and block.startswith(b"HTTP/1.1 200 OK")


def test_damage_is_found():
    body = b"x" * 100
    raw = warc.record(1, "u", body, warc.sha1_base32(body), None, False, "2000-01-01T00:00:00Z")
    zipped = zlib.compressobj(4, zlib.DEFLATED, 31)
    whole = zipped.compress(raw) + zipped.flush()
    assert list(warc.members(whole * 3)) == [raw] * 3
    with pytest.raises(ValueError):
        list(warc.members(whole + whole[:-9]))
    with pytest.raises(ValueError):
        warc.parse(raw[:-30])
