"""URL filters with DataFrame functions only.

Each URL is expanded into its host suffixes and, for each, the path prefixes whose lengths some rule has. Every expression
is hashed with SHA-256; the first four bytes are the join key with the rules, the full digest confirms, and of the rules
that fit a URL the one with the longest expression wins (ties: the longer host, then the lower expression, then block).

The lengths of rule paths are gathered on the driver: distinct lengths of URL paths, a few hundred at most, whatever the
number of rules or pages. Each row is expanded, joined and reduced by its own key, so no group can grow with the data.

Edge cases: a null URL or one without "://" has an empty host and path and fits no rule; repeated pages stay separate
rows; a rule with an empty host fits nothing; an empty rule table gives the default verdict everywhere; further columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the registered query: (host and path, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, verdict) rows from literals."""
    quoted = ", ".join("('" + r.replace("\\", "\\\\").replace("'", "\\'") + f"', '{v}')" for r, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(rule, verdict)") if rules else spark.sql("SELECT '' AS rule, '' AS verdict WHERE false")


def short(digest: Column) -> Column:
    """The first four bytes of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; rules has columns rule (host, then path from the first "/") and verdict."""
    slash = F.locate("/", F.col("rule"))
    split = rules.select(
        "rule",
        F.col("verdict").alias("rule_verdict"),
        F.when(slash == 0, F.col("rule")).otherwise(F.substring(F.col("rule"), F.lit(1), slash - 1)).alias("rule_host"),
        F.when(slash == 0, F.lit("")).otherwise(F.substring(F.col("rule"), slash, F.length("rule"))).alias("rule_path"),
    ).where("rule_host <> ''")
    hashed = split.select("rule", "rule_verdict", F.length("rule").alias("rule_len"), F.length("rule_host").alias("host_len"), F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest")).withColumn("short", short(F.col("rule_digest")))
    # distinct lengths of the rules' paths: no more than the longest path has characters
    lengths = sorted(r[0] for r in split.select(F.length("rule_path")).distinct().collect())

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    row = rows.withColumn("row", F.monotonically_increasing_id())
    asked = row.withColumn("digest", F.explode_outer(F.when(F.col("host") != "", F.transform(expressions, lambda e: F.sha2(e, 256)))))
    found = asked.withColumn("short", short(F.col("digest"))).join(hashed, "short", "left")
    fits = F.col("rule_digest") == F.col("digest")
    best = F.max(F.when(fits, F.struct("rule_len", "host_len", F.col("rule"), "rule_verdict")))
    out = found.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
