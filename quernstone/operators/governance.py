"""Checks, inventories and reports over sources, as joins and conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_duplicates(rows: DataFrame, layer: str, fingerprint: Column, order: str) -> DataFrame:
    """rows with duplicate_of: the earliest row of the layer with the same fingerprint, null for that row itself.

    The least of each fingerprint comes from partial minima; only fingerprints that occur twice come back to the rows, and a join's
    rows of one hot fingerprint can be split.
    """
    marked = rows.withColumn("fingerprint", fingerprint)
    repeated = marked.groupBy(F.col(layer).alias("_layer"), F.col("fingerprint").alias("_fingerprint")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = marked.join(repeated, F.col(layer).eqNullSafe(F.col("_layer")) & F.col("fingerprint").eqNullSafe(F.col("_fingerprint")), "left")
    return met.withColumn("duplicate_of", F.when(F.col("first") != F.col(order), F.col("first"))).drop("first", "_layer", "_fingerprint")


def mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only; a set is equal to another if this is empty."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, name: x.join(y, key, "left_anti").withColumn("side", F.lit(name))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, left_value, right_value) of the fields in which two records differ."""
    a = left.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    b = right.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("left_value"), F.col(f"b_{f}").alias("right_value")) for f in fields)))
    return a.join(b, key).select(key, each.alias("x")).select(key, "x.*").where("NOT left_value <=> right_value")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, action) by the hashes before and after; unchanged paths give no row."""
    both = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """All reasons that hold, in order."""
    return F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds in reasons)), lambda x: x.isNotNull())


def collisions(rows: DataFrame, key: str, path: str) -> DataFrame:
    """(key, paths): keys that come from several paths."""
    return rows.groupBy(key).agg(F.count_distinct(path).alias("paths")).where("paths > 1")


def admitted(rows: DataFrame, order: str, changed: Column, n: int) -> DataFrame:
    """Unchanged rows, and the first n changed ones in order; a limit on new work, not on results."""
    first = rows.where(changed).orderBy(order).limit(n)
    return rows.where(~changed).unionByName(first)


def secret_findings(files: DataFrame) -> DataFrame:
    """(path, line, kind) of lines with a secret; a line that says "secret-scan: allow" is exempt. The value is never shown."""
    from quernstone.functions.text import ASSIGNED, AWS, BEARER

    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "content")).where(~F.col("content").contains("secret-scan: allow"))
    kind = F.when(F.col("content").rlike(AWS), "access_key").when(F.col("content").rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----"), "private_key").when(F.col("content").rlike(BEARER), "bearer").when(F.col("content").rlike(ASSIGNED), "assignment")
    return lines.select("path", (F.col("at") + 1).cast("long").alias("line"), kind.alias("kind")).where("kind IS NOT NULL")


def provider_stats(units: DataFrame) -> DataFrame:
    """One row a provider: discovered, imported, unchanged and skipped units, and the counts of skip reasons as a map."""
    reasons = units.where("status = 'skipped'").groupBy("provider", "reason").agg(F.count(F.lit(1)).alias("n")).groupBy("provider").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skip_reasons"))
    counts = units.groupBy("provider").agg(F.count(F.lit(1)).alias("discovered"), *(F.count_if(F.col("status") == s).alias(s) for s in ("imported", "unchanged", "skipped")))
    return counts.join(reasons, "provider", "left")


def removal_blockers(target: Column, sources: DataFrame) -> DataFrame:
    """Sources that depend on the target: as its duplicate or as its fork."""
    return sources.where((F.col("duplicate_of") == target) | (F.col("fork_parent_source_id") == target))


def removal_plan(target: str, sources: DataFrame, assets: DataFrame) -> DataFrame:
    """(action, path) of removing a source: its output, and those of its assets that no other source uses, are deleted; shared assets
    are kept. Empty if another source depends on it or it isn't there. assets: (source_id, path)."""
    free = removal_blockers(F.lit(target), sources).limit(1).select(F.lit(True).alias("blocked"))
    own = sources.where(F.col("source_id") == target).select(F.lit("delete").alias("action"), F.col("output_path").alias("path")).where("path IS NOT NULL")
    users = assets.groupBy("path").agg(F.max(F.col("source_id") == target).alias("own"), F.max(F.col("source_id") != target).alias("shared")).where("own")
    files = users.select(F.when(F.col("shared"), "keep").otherwise("delete").alias("action"), "path")
    there = sources.where(F.col("source_id") == target).limit(1).select(F.lit(True).alias("there"))
    return own.unionByName(files).join(F.broadcast(free), F.lit(True), "left_anti").join(F.broadcast(there), F.lit(True), "left_semi")  # one row at most each


def unprocessed(units: DataFrame) -> DataFrame:
    """Sources that no curation has read yet, in the order of date and id."""
    return units.where("curation_status = 'unprocessed' AND ingest_status = 'ready'").orderBy(F.coalesce("created", F.lit("unknown")), "source_id")


def with_status(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """manifest with the curation_status that changes (source_id, curation_status) give."""
    new = changes.select("source_id", F.col("curation_status").alias("_new"))
    return manifest.join(new, "source_id", "left").withColumn("curation_status", F.coalesce("_new", "curation_status")).drop("_new")


def reparsed_differences(manifest: DataFrame, parsed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(source_id, problem, left_value, right_value) between ready sources and what their raw files give now: not there any more, not
    registered, or a field that differs."""
    ready = manifest.where("ingest_status = 'ready'")
    sides = mismatch(ready, parsed, "source_id").select("source_id", F.when(F.col("side") == "left", "raw source is gone").otherwise("raw source isn't registered").alias("problem"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"))
    return sides.unionByName(field_differences(ready, parsed, "source_id", fields).withColumnRenamed("field", "problem"))


def log_differences(log: DataFrame, history: DataFrame) -> DataFrame:
    """(path, logged, committed) where what a log says of a path isn't what the version control's history says.

    Both are (path, action, sha256, at). A path's state before its first change and after its last one count, so changes that undo each
    other need no entry: added and deleted again is nothing.
    """

    def net(rows: DataFrame, name: str) -> DataFrame:
        ends = rows.groupBy("path").agg(F.min_by("action", "at").alias("first"), F.max_by(F.struct("action", "sha256"), "at").alias("last"))
        before, after = F.col("first") != "added", F.col("last.action") != "deleted"
        action = F.when(~before & after, "added").when(before & after, "updated").when(before & ~after, "deleted")
        return ends.select("path", action.alias("action"), F.col("last.sha256").alias("sha256")).where("action IS NOT NULL").select("path", F.concat_ws(" ", "action", "sha256").alias(name))

    return net(log, "logged").join(net(history, "committed"), "path", "full_outer").where("NOT logged <=> committed")


def asset_problems(assets: DataFrame, files: DataFrame, root: str = "sources/assets/") -> DataFrame:
    """(source_id, path, problem) of registered assets (source_id, path, sha256): outside the assets' folder, missing, or changed.
    files: (path, sha256) as they are."""
    inside = F.col("path").startswith(root) & ~F.col("path").rlike(r"\\|(\A|/)\.{0,2}(/|\z)")
    met = assets.join(files.select("path", F.col("sha256").alias("now")), "path", "left")
    problem = F.when(F.col("path").isNull() | F.col("sha256").isNull(), "invalid record").when(~inside, "outside").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return met.select("source_id", "path", problem.alias("problem")).where("problem IS NOT NULL")


def common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")
