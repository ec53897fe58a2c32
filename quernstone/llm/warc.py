"""WARC archives and revisit resolution.

Archives are kept as a table of segments: each row's `content` is a run of gzip members, one WARC/1.1 record each, and
the segments written one after another are a .warc.gz file. Spark's committer writes the table in the shared folder, so
a lost executor leaves no half archive, and any file system that Spark can write will do. read_files() reads .warc.gz
files as they are.

deduplicate() works on headers: (digest, length) of each payload is grouped - partial sums before the shuffle - and only
the largest id of each payload that occurs more than once comes back to the records, hot payloads by broadcast (see skew.py). Payloads
pass through that one join, once, on their way into the archives. The kept response and its revisits get fresh headers. resolve() joins
the headers of revisit records to their responses again; give it stored headers, so that archives are read once.

Edge cases: a null payload is an empty one; payloads smaller than min_bytes are always responses; rows that repeat both
id and payload share one verdict; a null id never is the one that others refer to, unless all ids of a payload are null,
which makes them all responses; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.skew import split_join
from quernstone.session import cut, ship

#: Compressed bytes after which a segment ends; one record is never divided.
SEGMENT_BYTES = 8 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record with fresh headers; a revisit has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a segment, decompressed one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof and at < len(view):
            step = view[at : at + 65536]
            out.append(unzip.decompress(step))
            at += len(step) - len(unzip.unused_data)
        if not unzip.eof:
            raise ValueError("a gzip member is cut off")
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC block is cut off")
    return headers, rest[:n]


def page_of(urn: str) -> tuple[int | None, str]:
    """(id, digest) of a record id that record_id() made."""
    number, _, digest = urn.strip("<>").removeprefix("urn:page:").partition(":")
    return int(number) if number else None, digest


def deduplicate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, keep_id, revisit): the verdict of each record."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    groups = cut(heads.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND keep_id IS NOT NULL"), "payloads")
    held = split_join(rows, groups, ["digest"], "copies", ["page_id", "url"], keep_missing=True)
    return held.select("page_id", "url", "payload", "keep_id", (F.col("keep_id").isNotNull() & ~F.col("keep_id").eqNullSafe(F.col("page_id"))).alias("revisit"))


def write(records: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write what deduplicate() gives as archives; returns the stored table (content binary, records long)."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["content", "records"])
        for batch in batches:
            for page_id, url, payload, keep_id, revisit in zip(*(c for c in batch.columns), strict=True):
                body = payload.as_py().encode()
                raw = record(page_id.as_py(), url.as_py(), body, sha1_base32(body), keep_id.as_py(), revisit.as_py(), date)
                zipped = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                held.append(zipped.compress(raw) + zipped.flush())
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return cut(records.select("page_id", "url", "payload", "keep_id", "revisit").mapInArrow(run, "content binary, records long"), "warc")


def heads(archives: DataFrame) -> DataFrame:
    """HEADS of every record of stored archives; payload_bytes is null for revisits, and a digest that doesn't fit fails."""
    ship(archives.sparkSession)

    def one(raw: bytes) -> tuple:
        headers, block = parse(raw)
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        page, _ = page_of(headers["warc-record-id"])
        url = headers.get("warc-target-uri")
        if headers["warc-type"] == "revisit":
            return page, url, None, digest, "revisit", page_of(headers["warc-refers-to"])[0]
        payload = block.partition(b"\r\n\r\n")[2]
        if sha1_base32(payload) != digest:
            raise ValueError(f"payload digest of page {page} does not fit")
        return page, url, len(payload), digest, "response", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            for content in batch.column(0):
                rows = [one(x) for x in members(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    return archives.select("content").mapInArrow(run, HEADS)


def resolve(found: DataFrame) -> DataFrame:
    """Headers with the payload length of each revisit's original response, joined on id and digest. found is read several times: store it."""
    keys = ["refers_to", "payload_digest"]
    originals = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    revisits = found.where("record_type = 'revisit'")
    wanted = cut(revisits.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).join(originals, keys), "originals")
    joined = split_join(revisits, wanted, keys, "copies", ["page_id", "url"], keep_missing=True).withColumn("payload_bytes", F.col("original_bytes"))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(columns).unionByName(joined.select(columns))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Segments of .warc.gz files, one row a file."""
    return spark.read.format("binaryFile").load(path).select("content")
