"""Batches of imports: target conflicts, inventories, review queues, consistency checks, standardised documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import clean_message, redact, redaction_count


def unchanged(planned: DataFrame, manifest: DataFrame, version: int) -> DataFrame:
    """planned rows with `unchanged`: the same hash and importer version as registered, and an output."""
    known = manifest.select("source_id", F.col("source_hash").alias("known_hash"), F.col("importer_version").alias("known_version"), F.col("output_path").alias("known_output"))
    same = F.col("source_hash").eqNullSafe(F.col("known_hash")) & F.col("known_version").eqNullSafe(F.lit(version)) & F.col("known_output").isNotNull()
    return planned.join(known, "source_id", "left").withColumn("unchanged", F.coalesce(same, F.lit(False))).drop("known_hash", "known_version", "known_output")


def conflicts(planned: DataFrame, manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """(source_id, reason): two plans of one id or output, an output that another source has, or a file nobody registered."""
    ids = planned.groupBy("source_id").agg(F.count(F.lit(1)).alias("same_id"))
    outputs = planned.groupBy("output_path").agg(F.count(F.lit(1)).alias("same_output"))
    owners = manifest.where("output_path IS NOT NULL").groupBy("output_path").agg(F.min("source_id").alias("owner"))
    rows = planned.select("source_id", "output_path").distinct().join(ids, "source_id").join(outputs, "output_path").join(owners, "output_path", "left").join(existing.select(F.col("path").alias("output_path"), F.lit(True).alias("there")).distinct(), "output_path", "left")
    reason = (
        F.when(F.col("same_id") > 1, "repeated_id")
        .when(F.col("same_output") > 1, "repeated_output")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("source_id")), "output_of_another_source")
        .when(F.col("owner").isNull() & F.col("there"), "unregistered_file")
    )
    return rows.select("source_id", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def merged_inventory(kept: DataFrame, new: DataFrame, selected: DataFrame) -> DataFrame:
    """Units of other raw files as they were, and the new ones; one row for each (source_id, raw_path, raw_locator), new ones first."""
    others = kept.join(selected.select("raw_path").distinct(), "raw_path", "left_anti").withColumn("_order", F.lit(1))
    both = others.unionByName(new.withColumn("_order", F.lit(0)))
    first = F.row_number().over(W.partitionBy("source_id", "raw_path", "raw_locator").orderBy("_order"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_order")


def inventory_summary(units: DataFrame) -> DataFrame:
    """One row a provider: units, documents, threads, reasons, first and last known date."""
    known = F.when(F.col("created") != "unknown", F.col("created"))
    reasons = units.where("skip_reason <> ''").groupBy("provider", "skip_reason").agg(F.count(F.lit(1)).alias("n")).groupBy("provider").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("skip_reason", "n")))).alias("reasons"))
    counts = units.groupBy("provider").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("raw_path").alias("documents"), F.count_if(F.col("thread_kind") == "main").alias("main_threads"), F.min(known).alias("first"), F.max(known).alias("last"))
    return counts.join(reasons, "provider", "left")


def review_items(manifest: DataFrame, units: DataFrame) -> DataFrame:
    """Sources and units that wait for a person, in the order of date, id and raw path. A source whose raw file the inventory has is
    given by the inventory only.

    manifest: (source_id, title, provider, created, raw_path, ingest_status, reason); units: the same with parse_status.
    """
    columns = ["source_id", "title", "provider", "created", "raw_path", "reason"]
    from_manifest = manifest.where("ingest_status = 'review'").join(units.select("raw_path").distinct(), "raw_path", "left_anti").select(columns)
    from_units = units.where("parse_status = 'review' AND source_id <> ''").select(columns)
    rows = from_manifest.withColumn("_o", F.lit(0)).unionByName(from_units.withColumn("_o", F.lit(1)))
    last = F.row_number().over(W.partitionBy("source_id", "raw_path").orderBy(F.desc("_o")))
    rows = rows.withColumn("_n", last).where("_n = 1").drop("_n", "_o")
    return rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "source_id")).orderBy(F.coalesce("created", F.lit("unknown")), "source_id", F.coalesce("raw_path", F.lit("")))


def consistency(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, path, problem) between registered sources and standardised files (path, source_id, source_hash, type).

    Problems: missing file, orphan file, id, hash, repeated output, duplicate or fork parent that isn't there.
    """
    ready = manifest.where("output_path IS NOT NULL")
    f = files.select(F.col("path").alias("output_path"), F.col("source_id").alias("file_id"), F.col("source_hash").alias("file_hash"))
    both = ready.join(f, "output_path", "full_outer")
    problem = F.when(F.col("source_id").isNull(), "orphan file").when(F.col("file_id").isNull(), "missing file").when(F.col("file_id") != F.col("source_id"), "id").when(~F.col("file_hash").eqNullSafe(F.col("source_hash")), "hash")
    own = both.select(F.coalesce("source_id", "file_id").alias("source_id"), F.col("output_path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")
    repeated = ready.groupBy("output_path").agg(F.min("source_id").alias("source_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("source_id", F.col("output_path").alias("path"), F.lit("repeated output").alias("problem"))
    links = manifest.select("source_id", F.col("output_path").alias("path"), F.explode(F.array(F.struct(F.lit("duplicate").alias("k"), F.col("duplicate_of").alias("to")), F.struct(F.lit("fork parent").alias("k"), F.col("fork_parent_source_id").alias("to")))).alias("x")).where("x.to IS NOT NULL")
    gone = links.join(manifest.select(F.col("source_id").alias("there")), F.col("x.to") == F.col("there"), "left_anti").select("source_id", "path", F.concat("x.k", F.lit(" isn't there")).alias("problem"))
    return own.unionByName(repeated).unionByName(gone)


def scalar(value: Column) -> Column:
    """A string as it stands in front matter."""
    plain = value.rlike(r"\A[A-Za-z0-9_./@-][A-Za-z0-9_./@ -]*\z") & ~F.lower(value).isin("true", "false", "null", "yes", "no", "on", "off") & ~value.rlike(r"\A[-+.0-9][0-9._]*\z| \z")
    return F.when(plain, value).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"')))


def rendered(metadata: Column, body: Column) -> Column:
    """A standardised document: front matter with sorted keys, and the body."""
    lines = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), scalar(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), F.regexp_replace(body, r"\A\n+|\n+\z", ""), F.lit("\n"))


def rendered_sessions(exchanges: DataFrame) -> DataFrame:
    """(session, body): the text of a standardised conversation from (session, turn, user_text, assistant_text, user_locator, assistant_locator).

    Exchanges are gathered per session in order; a session is one document."""
    part = F.transform("x", lambda e, i: F.concat(
        F.lit("## Exchange "), (i + 1).cast("string"), F.lit("\n- **Turn**: "), e["turn"].cast("string"), F.lit("\n- **User locator**: `"), e["user_locator"], F.lit("`\n- **Assistant locator**: `"), e["assistant_locator"],
        F.lit("`\n\n### Human user\n\n"), e["user_text"], F.lit("\n\n### Assistant final\n\n"), e["assistant_text"], F.lit("\n"),
    ))
    ordered = exchanges.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "user_locator", "assistant_locator", "user_text", "assistant_text"))).alias("x"))
    return ordered.select("session", F.array_join(part, "\n").alias("body"), F.size("x").alias("exchange_count"))


def inventory_order(units: DataFrame) -> DataFrame:
    return units.orderBy("raw_path", "raw_locator", "source_id")


def repeated_outputs(manifest: DataFrame) -> DataFrame:
    """(output_path, sources): outputs of several sources."""
    return manifest.where("output_path IS NOT NULL").groupBy("output_path").agg(F.count(F.lit(1)).alias("sources")).where("sources > 1")


def session_pages(sessions: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(session, text): standardised pages of sessions (session, title, metadata map, notes array of paragraphs that stand before the
    exchanges, such as where it was forked and what a review left out).

    exchanges: (session, turn, user_text, assistant_text, user_locator, user_locators array of all its messages, assistant_locator,
    recovered). Texts are cleaned and secrets taken out; an exchange whose either side is empty then is left out; metadata gets the
    counts of exchanges and of what was taken out.
    """
    sides = ("user_text", "assistant_text")
    clean = {c: clean_message(F.col(c)) for c in sides}
    rows = exchanges.select("session", "turn", "user_locator", "user_locators", "assistant_locator", "recovered", *(redact(clean[c]).alias(c) for c in sides), (redaction_count(clean["user_text"]) + redaction_count(clean["assistant_text"])).alias("secrets")).where("user_text <> '' AND assistant_text <> ''")
    field = lambda name, value: F.concat(F.lit(f"- **{name}**: "), value, F.lit("\n"))
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    several = lambda e: F.when(F.size(e["user_locators"]) > 1, F.concat(field("User message count", F.size(e["user_locators"]).cast("string")), F.array_join(F.transform(e["user_locators"], lambda x, i: F.concat(F.lit("- **User message "), (i + 1).cast("string"), F.lit(" locator**: "), code(x), F.lit("\n"))), ""))).otherwise("")
    page = lambda e, i: F.concat(
        F.lit("## Exchange "), (i + 1).cast("string"), F.lit("\n\n"), field("Turn", e["turn"].cast("string")), field("User locator", code(e["user_locator"])), several(e),
        F.when(e["recovered"], F.lit("- **Recovered incomplete sequence**: true\n")).otherwise(""), field("Assistant locator", code(e["assistant_locator"])),
        F.lit("\n### Human user\n\n"), e["user_text"], F.lit("\n\n### Assistant final\n\n"), e["assistant_text"],
    )
    ordered = rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "user_locator", "user_locators", "assistant_locator", "recovered", *sides))).alias("x"), F.sum("secrets").alias("secrets"))
    met = sessions.join(ordered, "session", "left").withColumns({"x": F.coalesce("x", F.array()), "title": redact(F.col("title")), "secrets": F.coalesce("secrets", F.lit(0)) + redaction_count(F.col("title"))})
    counts = F.create_map(F.lit("exchange_count"), F.size("x").cast("string"), F.lit("redaction_count"), F.col("secrets").cast("string"), F.lit("title"), F.col("title"))
    kept = F.map_filter("metadata", lambda k, _: ~k.isin("exchange_count", "redaction_count", "title"))
    parts = F.concat(F.array(F.concat(F.lit("# "), F.col("title"))), F.transform("notes", lambda n: F.concat(F.lit("> "), n)), F.transform("x", page))
    return met.select("session", rendered(F.map_concat(kept, counts), F.array_join(parts, "\n\n")).alias("text"))
