"""The change log: appended JSON records, read in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version int, timestamp timestamp, importer string, changes array<struct<action: string, path: string, sha256: string>>"


#: Changes of one record; a larger batch is several records.
RECORD_CHANGES = 10_000


def append(changes: DataFrame, path: str, importer: str, timestamp: str) -> None:
    """Records of a batch's changes (path, action, sha256); the writer's commit makes them visible as a whole."""
    part = F.pmod(F.xxhash64("path"), F.lit(max(1, -(-changes.count() // RECORD_CHANGES))))
    entry = changes.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("action", "path", "sha256"))).alias("changes"))
    entry.select(F.lit(1).alias("version"), F.lit(timestamp).cast("timestamp").alias("timestamp"), F.lit(importer).alias("importer"), "changes").write.mode("append").json(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).json(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Changes as they are appended: (timestamp, importer, action, path, sha256)."""
    return flat(spark.readStream.schema(ENTRY).json(path))


def flat(log: DataFrame) -> DataFrame:
    return log.select("timestamp", "importer", F.explode("changes").alias("c")).select("timestamp", "importer", "c.*")


def activity(changes: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by importer, action and window; later records than `late` behind the newest are let go."""
    return changes.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "importer", "action").agg(F.count(F.lit(1)).alias("n"))


def latest_state(changes: DataFrame) -> DataFrame:
    """(path, action, sha256) of each path's last change."""
    last = F.max_by(F.struct("action", "sha256"), F.struct("timestamp", "action"))
    return changes.groupBy("path").agg(last.alias("x")).select("path", "x.*")


def invalid_entries(log: DataFrame) -> DataFrame:
    """Changes that break the format: unknown action, absolute or parent path, a digest that is no SHA-256 (none for deletions)."""
    digest = F.when(F.col("action") == "deleted", F.col("sha256").isNull()).otherwise(F.coalesce(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)))
    return flat(log).where(~F.col("action").isin("added", "updated", "deleted") | F.col("path").rlike(r"\A/|(\A|/)\.\.(/|\z)") | ~digest)
