"""Immutable, versioned indexes: postings with positions, lengths, items by bundle, and where each item is, as Parquet, found by the
digest of their content.

A version is a folder idx_<20 hex> with the tables and a manifest table; numbered small tables under `published`
name versions, the last one the current. A reader resolves `current` once and keeps to that version. Building what exists already is a no-op.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.analyzer import counted_terms
from quernstone.functions.text import spaced_cjk
from quernstone.operators.projection import bundle_key, invariant_violations
from quernstone.session import exists, versions

VERSIONS = {"item_schema": "1.3", "analyzer": "porter-fold-1", "projection": "item-projection-v1"}
TABLES = ("items", "seeds", "postings", "lengths")


class IndexFault(ValueError):
    """An index that may not be built or opened."""


def content_digest(items: DataFrame) -> str:
    """A digest of all columns of the items that their order doesn't change: sums of two 64-bit hashes of each row, and the count."""
    row = items.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(s), *sorted(items.columns)).cast("decimal(38,0)")).cast("string").alias(f"h{s}") for s in (1, 2))).first()
    return hashlib.sha256(f"{sorted(VERSIONS.items())}|{sorted(items.columns)}|{row['n']}|{row['h1']}|{row['h2']}".encode()).hexdigest()


def postings(items: DataFrame) -> DataFrame:
    """(term, item_id, field, tf, positions) of titles and bodies after the analyzer."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), spaced_cjk(F.col(c)).alias("text")) for f, c in (("title", "source_title"), ("body", "body")))))
    found = items.select("item_id", fields.alias("x")).select("item_id", "x.field", F.explode(counted_terms(F.col("x.text"))).alias("p"))
    return found.select("p.term", "item_id", "field", "p.tf", "p.positions")


def build(items: DataFrame, root: str, check: bool = True) -> str:
    """Write a version unless it is there already; returns its id."""
    spark = items.sparkSession
    if check:
        bad = invariant_violations(items).limit(5).collect()  # a few examples for the message
        if bad:
            raise IndexFault(f"items break rules: {[(r.item_id, r.rule) for r in bad]}")
    index_id = "idx_" + content_digest(items)[:20]
    home = f"{root}/{index_id}"
    if exists(spark, f"{home}/manifest/_SUCCESS"):
        return index_id
    keyed = items.withColumn("bundle_key", bundle_key(F.col("source_path"), F.col("session_id"), F.col("turn_index"), F.col("locator")))
    keyed.repartitionByRange("bundle_key").sortWithinPartitions("bundle_key").write.mode("overwrite").parquet(f"{home}/items")  # a bundle is one place
    spark.read.parquet(f"{home}/items").select("item_id", "bundle_key").repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(f"{home}/seeds")
    found = postings(items)
    found.repartitionByRange("term").sortWithinPartitions("term", "item_id").write.mode("overwrite").parquet(f"{home}/postings")  # row groups can be skipped by a term's range
    stored = spark.read.parquet(f"{home}/postings")
    sizes = stored.groupBy("item_id").agg(F.sum("tf").alias("n"))
    items.select("item_id", "scope").join(sizes, "item_id", "left").select("item_id", "scope", F.coalesce("n", F.lit(0)).alias("n")).write.mode("overwrite").parquet(f"{home}/lengths")
    counts = {t: spark.read.parquet(f"{home}/{t}").count() for t in TABLES}
    facts = {**VERSIONS, "index_id": index_id, **{f"{t}_rows": str(n) for t, n in counts.items()}}
    spark.createDataFrame(sorted(facts.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{home}/manifest")
    return index_id


def pointer(spark: SparkSession, root: str, name: str) -> str | None:
    """The id of the current version, or of the previous one."""
    numbers = versions(spark, f"{root}/published")
    back = {"current": 1, "previous": 2}[name]
    return spark.read.parquet(f"{root}/published/{numbers[-back]}").first()["index_id"] if len(numbers) >= back else None


def publish(spark: SparkSession, root: str, index_id: str) -> bool:
    """Make a valid version current and keep the one before; False if it is current already.

    A pointer is never overwritten: publishing adds the next number, which counts once its commit mark is there.
    """
    Index.open(spark, root, index_id)
    if pointer(spark, root, "current") == index_id:
        return False
    number = (versions(spark, f"{root}/published") or [0])[-1] + 1
    spark.createDataFrame([(index_id,)], "index_id string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/published/{number}")
    return True


def scope_counts(items: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """(scope, n) of the given scopes, also those without items."""
    named = items.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    return named.join(items.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "scope", "left").select("scope", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Index:
    """One pinned version."""

    spark: SparkSession
    home: str
    index_id: str
    facts: dict

    @classmethod
    def open(cls, spark: SparkSession, root: str, index_id: str | None = None) -> Index:
        index_id = index_id or pointer(spark, root, "current")
        if not index_id or not exists(spark, f"{root}/{index_id}/manifest/_SUCCESS"):
            raise IndexFault(f"no index {index_id}")
        home = f"{root}/{index_id}"
        facts = {r["name"]: r["value"] for r in spark.read.parquet(f"{home}/manifest").collect()}
        if facts.get("index_id") != index_id or any(facts.get(k) != v for k, v in VERSIONS.items()):
            raise IndexFault(f"{index_id} was made by other rules")
        for t in TABLES:
            if str(spark.read.parquet(f"{home}/{t}").count()) != facts[f"{t}_rows"]:
                raise IndexFault(f"table {t} of {index_id} is damaged")
        return cls(spark, home, index_id, facts)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}")

    def scope_counts(self, scopes: Sequence[str] = ("article", "conversation", "note")) -> dict[str, int]:
        return {r["scope"]: r["n"] for r in scope_counts(self.table("items"), scopes).collect()}
