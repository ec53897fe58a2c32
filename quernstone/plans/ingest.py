"""Batches of imports: everything is prepared and checked first, then the whole batch is committed or blocked.

planned: (provider, source_id, source_path, output_path, source_hash, text), one row an output. units: (provider, source_id, raw_path,
raw_locator, parse_status, skip_reason), one row for whatever a raw file holds. A state has the manifest (source_id, provider, source_path,
output_path, source_hash, ingest_status), the inventory (as units) and the outputs that exist (path).

States are numbered: a commit writes the next number's tables, and the manifest last; a state counts once its manifest does. So a lost
executor or driver leaves the state before, and of two batches that began on one state only the first commits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.batches import merged_inventory
from quernstone.operators.governance import provider_stats
from quernstone.session import versions

MANIFEST = "source_id string, provider string, source_path string, output_path string, source_hash string, ingest_status string"
UNITS = "provider string, source_id string, raw_path string, raw_locator string, parse_status string, skip_reason string"
#: Reasons that block a batch.
SAME_ID, SAME_OUTPUT = "source_id_collision_review", "output_path_collision_review"


class BatchFault(ValueError):
    """A batch that may not be committed; its message says why."""


@dataclass(frozen=True)
class State:
    manifest: DataFrame
    inventory: DataFrame
    outputs: DataFrame
    number: int = 0


@dataclass(frozen=True)
class Plan:
    """sources: what may be committed; units: with the reasons that were found; stats: a row a provider; blocked: a column of stats."""

    sources: DataFrame
    units: DataFrame
    stats: DataFrame


def empty(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], MANIFEST), spark.createDataFrame([], UNITS), spark.createDataFrame([], "path string"))


def current(spark: SparkSession, root: str) -> State:
    """The last committed state."""
    numbers = versions(spark, f"{root}/manifest")
    if not numbers:
        return empty(spark)
    n = numbers[-1]
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{n}")
    return State(manifest, spark.read.schema(UNITS).parquet(f"{root}/inventory/{n}"), manifest.where("output_path IS NOT NULL").select(F.col("output_path").alias("path")), n)


def repeated_ids(units: DataFrame, inventory: DataFrame) -> DataFrame:
    """(provider, source_id) that several raw files give, of this batch or of inputs that it doesn't touch."""
    own = units.where("source_id <> '' AND raw_path <> ''").select("provider", "source_id", "raw_path")
    others = inventory.where("source_id <> '' AND raw_path <> ''").select("provider", "source_id", "raw_path").join(own.select("raw_path").distinct(), "raw_path", "left_anti")
    paths = own.unionByName(others).groupBy("provider", "source_id").agg(F.count_distinct("raw_path").alias("paths"))
    return paths.where("paths > 1").select("provider", "source_id").join(own.select("provider", "source_id").distinct(), ["provider", "source_id"], "left_semi")


def target_conflicts(planned: DataFrame, manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """(source_id, reason): an id planned by several sources or registered for another raw file; an output that another plan or
    source has, or that exists unregistered."""
    ready = manifest.where("ingest_status = 'ready'")
    ids = planned.groupBy("source_id").agg((F.count_distinct("provider", "source_path") > 1).alias("several"), F.min("source_path").alias("path"))
    known = ready.groupBy("source_id").agg(F.min("source_path").alias("known_path"))
    same_id = ids.join(known, "source_id", "left").where(F.col("several") | (F.col("known_path") != F.col("path"))).select("source_id", F.lit(SAME_ID).alias("reason"))
    plans = planned.groupBy("output_path").agg((F.count_distinct("source_id") > 1).alias("several"), F.count(F.lit(1)).alias("rows"))
    owner = ready.where("output_path IS NOT NULL").groupBy("output_path").agg(F.min("source_id").alias("owner"))
    there = outputs.select(F.col("path").alias("output_path"), F.lit(True).alias("there")).distinct()
    rows = planned.select("source_id", "output_path").distinct().join(plans, "output_path").join(owner, "output_path", "left").join(there, "output_path", "left")
    same_output = rows.where(F.col("several") | (F.col("rows") > 1) | (F.col("owner") != F.col("source_id")) | (F.col("owner").isNull() & F.col("there"))).select("source_id", F.lit(SAME_OUTPUT).alias("reason"))
    return same_id.unionByName(same_output).groupBy("source_id").agg(F.max("reason").alias("reason"))  # the id's reason counts first


def prepare(planned: DataFrame, units: DataFrame, manifest: DataFrame, inventory: DataFrame, outputs: DataFrame) -> Plan:
    """All checks; nothing is written."""
    same = repeated_ids(units, inventory).withColumn("same", F.lit(SAME_ID))
    found = target_conflicts(planned.join(same, ["provider", "source_id"], "left_anti"), manifest, outputs)
    marked = units.join(same, ["provider", "source_id"], "left").join(found, "source_id", "left")
    reason = F.coalesce("same", F.when(F.col("skip_reason") == "", F.col("reason")))
    status = F.when(reason.isNotNull(), "review").otherwise(F.col("parse_status"))
    marked = marked.select(*(c for c in units.columns if c not in ("parse_status", "skip_reason")), status.alias("parse_status"), F.coalesce(reason, "skip_reason").alias("skip_reason"))
    sources = planned.join(same, ["provider", "source_id"], "left_anti").join(found, "source_id", "left_anti")
    counted = marked.select("provider", F.when(F.col("skip_reason") != "", "skipped").when(F.col("parse_status") == "imported", "unchanged").otherwise("imported").alias("status"), F.col("skip_reason").alias("reason"))
    blocked = marked.groupBy("provider").agg(F.coalesce(F.max(F.col("skip_reason").isin(SAME_ID, SAME_OUTPUT)), F.lit(False)).alias("blocked"))
    return Plan(sources, marked, provider_stats(counted).join(blocked, "provider"))


def execute(planned: DataFrame, units: DataFrame, snapshots: DataFrame, files: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Prepare a batch and commit or block it; returns the stats, of a blocked batch with `imported` 0 and what was put off in `deferred`.

    snapshots: (path, sha256) as they were read; files: (path, sha256) as they are now. A file that changed in between is an error, and
    so is a state that another batch committed meanwhile. A blocked batch writes its inventory and nothing else.
    """
    spark = planned.sparkSession
    state = current(spark, root)
    plan = prepare(planned, units, state.manifest, state.inventory, state.outputs)
    stats = plan.stats.withColumn("deferred", F.lit(0).cast("long"))
    if dry_run:
        return stats
    now = files.select("path", F.col("sha256").alias("now"))
    changed = snapshots.distinct().join(now, "path", "left").where("NOT sha256 <=> now").limit(5).collect()  # a few examples for the message
    if changed:
        raise BatchFault(f"sources changed during preparation: {[r.path for r in changed]}")
    merged = merged_inventory(state.inventory, plan.units, units.select("raw_path"))
    any_blocked = bool(plan.stats.where("blocked").limit(1).count())
    manifest = state.manifest
    if not any_blocked:
        new = plan.sources.select("source_id", "provider", "source_path", "output_path", "source_hash", F.lit("ready").alias("ingest_status"))
        kept = manifest.join(new.select("source_id").distinct(), "source_id", "left_anti").join(units.select(F.col("raw_path").alias("source_path")).distinct().withColumn("touched", F.lit(True)), "source_path", "left").where("ingest_status = 'ready' OR touched IS NULL").drop("touched")
        manifest = kept.unionByName(new)
    commit(spark, root, state.number, manifest, merged, None if any_blocked else plan.sources.select("output_path", "text"))
    if any_blocked:
        return plan.stats.select(*(c for c in plan.stats.columns if c not in ("imported", "blocked")), F.lit(0).cast("long").alias("imported"), F.lit(True).alias("blocked"), F.col("imported").alias("deferred"))
    return stats


def commit(spark: SparkSession, root: str, number: int, manifest: DataFrame, inventory: DataFrame, texts: DataFrame | None) -> None:
    """Write state number + 1: texts and inventory, then the manifest."""
    if (versions(spark, f"{root}/manifest") or [0])[-1] != number:
        raise BatchFault("another batch was committed during preparation")
    n = number + 1
    if texts is not None:
        texts.write.mode("overwrite").parquet(f"{root}/texts/{n}")
    inventory.write.mode("overwrite").parquet(f"{root}/inventory/{n}")
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest/{n}")
