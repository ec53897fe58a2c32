"""File sources: Markdown and JSONL as rows, front matter, line locators, manifests. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import fingerprint, lines_between, parsed_locator

MANIFEST = "version int, sources map<string, struct<output_path: string, source_hash: string, importer_version: int, ingest_status: string, curation_status: string, provider: string, duplicate_of: string, fork_parent_source_id: string>>"


def relative(root: str):
    return F.regexp_replace(F.col("path"), "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.rstrip("/")) + "/", "")


def markdown(spark: SparkSession, root: str, includes: Sequence[str] | None = None, glob: str = "*.md") -> DataFrame:
    """(path, text, sha256) of the Markdown files under root, without hidden ones; includes lists relative paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256")).withColumn("path", relative(root))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    return rows.where(F.col("path").isin(*includes)) if includes is not None else rows


def jsonl_lines(spark: SparkSession, root: str, exclude_subagents: bool = False) -> DataFrame:
    """(path, line, content) of the JSONL files under root, blank lines left out, numbered from 1.

    Files are split: lines are numbered within each block that a task reads, and blocks by the sums of those before.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("content"))
    if exclude_subagents:
        rows = rows.where(~F.col("path").contains("/subagents/"))
    sizes = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("path", "block").orderBy("at"))
    lines = rows.withColumn("own", own).join(starts, ["path", "block"]).withColumn("path", relative(root))
    return lines.select("path", (F.col("own") + F.col("before")).cast("int").alias("line"), "content").where(F.trim("content") != "")


def parsed_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, invalid counts): JSON objects with path, line and record; other lines are counted by path."""
    tried = lines.withColumn("value", F.try_parse_json("content"))
    is_object = F.col("value").isNotNull() & F.schema_of_variant("value").startswith("OBJECT")
    records = tried.where(is_object).select("path", "line", F.from_json("content", schema).alias("record"))
    invalid = tried.where("value IS NULL").groupBy("path").agg(F.count(F.lit(1)).alias("invalid"))
    return records, invalid


def front_matter(text):
    """struct(metadata map, body) of a document; scalars only, as `key: value` lines. A document without front matter has an empty map.

    A front matter that isn't closed, or that holds a line without a key, gives null: such a document is rejected.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "^\\x{FEFF}", ""), "\r\n?", "\n")
    opened = plain.rlike(r"\A---\n")
    head = F.regexp_extract(plain, r"(?s)\A---\n(.*?)(?:\A|(?<=\n))---(?:\n|\z)", 1)
    closed = plain.rlike(r"(?s)\A---\n(?:.*?\n)?---(?:\n|\z)")
    pairs = F.filter(F.split(head, "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    keyed = F.forall(pairs, lambda x: x.rlike(r"^[^\s:][^:]*:(?: .*)?$"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    entries = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), value(x).alias("value")))))
    body = F.regexp_replace(plain, r"(?s)\A---\n(?:.*?\n)?---(?:\n|\z)", "")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(~opened, F.struct(none.alias("metadata"), plain.alias("body"))).when(closed & keyed, F.struct(entries.alias("metadata"), body.alias("body")))


def article_metadata(metadata):
    """The fields of an article; blanks are "unknown"."""
    field = lambda k: F.coalesce(F.nullif(F.trim(F.try_element_at(metadata, F.lit(k))), F.lit("")), F.lit("unknown")).alias(k)
    return F.struct(*(field(k) for k in ("title", "source", "author", "published", "created", "description")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a source of a manifest file."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("sources").alias("source_id", "record")).select("source_id", "record.*")


def standardised(rows: DataFrame) -> DataFrame:
    """rows with metadata, body and fingerprint; rows with broken front matter have null ones."""
    parsed = rows.withColumn("parsed", front_matter(F.col("text")))
    return parsed.withColumn("metadata", F.col("parsed.metadata")).withColumn("body", F.col("parsed.body")).withColumn("fingerprint", fingerprint(F.col("body"))).drop("parsed")


def read_ranges(files: DataFrame, locators: DataFrame) -> DataFrame:
    """(locator, lines) of path@Lx-Ly locators; null where the path isn't there or the range is beyond its lines."""
    wanted = locators.select("locator", parsed_locator(F.col("locator")).alias("x")).select("locator", "x.*")
    found = wanted.join(files.select("path", "text"), "path", "left")
    inside = F.col("last") <= F.size(F.split("text", "\n"))
    return found.select("locator", F.when(inside, lines_between(F.col("text"), F.col("first"), F.col("last"))).alias("lines"))


def located(messages: DataFrame, locators: DataFrame) -> DataFrame:
    """Semantic locators, with or without @Lx-Ly, read from parsed sources: (requested, locator, kind, path, first, last, range_matches).

    messages: (locator, kind, path), where locator ends in its own lines. A locator that no message has gives nulls; whether a
    given range is the message's own is said, not demanded.
    """
    apart = lambda c: F.regexp_extract(c, r"(?s)\A(.*?)(?:@L[0-9]+-L[0-9]+)?\z", 1)
    own = messages.where(parsed_locator(F.col("locator")).isNotNull()).withColumn("name", apart(F.col("locator")))
    own = own.groupBy("name").agg(F.min(F.struct("locator", "kind", "path")).alias("m"))
    wanted = locators.select(F.col("locator").alias("requested")).withColumn("name", apart(F.col("requested")))
    at = parsed_locator(F.col("m.locator"))
    met = wanted.join(own, "name", "left").withColumn("at", at)
    same = (F.col("requested") == F.col("name")) | (F.col("requested") == F.col("m.locator"))
    return met.select("requested", F.col("m.locator").alias("locator"), F.col("m.kind").alias("kind"), F.col("m.path").alias("path"), F.col("at.first").alias("first"), F.col("at.last").alias("last"), F.when(F.col("m").isNotNull(), same).alias("range_matches"))
