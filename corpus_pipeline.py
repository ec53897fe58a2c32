"""The corpus pipeline: from raw documents to token ids, each stage over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The
near-duplicate and decontamination stages number the rows and judge each on its own, also where ids repeat or are null. SQL can't express the
stages; the tests hold them against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontaminate, minhash, pii, toxicity
from quernstone.llm.queries import vocabulary
from quernstone.session import cut, drop_cut, results_only, table


#: Column of the rows' own numbers.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row. Stored, so that the numbers stay."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine doesn't reject."""
    return toxicity.kept(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id, null ids last: five-word shingles, similarity 0.8."""
    rows = _numbered(docs)
    groups = minhash.near_duplicates(rows, k=5, percent=80, id_col=ROW).select(ROW, "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    kept = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    rows = _numbered(docs)
    found = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=ROW, free_ends=True)
    return rows.join(found.select(ROW), ROW, "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars, where there is one, counts the new text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of all documents."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read back. What a stage wrote on the way, and the result
    before it, are deleted once its own is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = results_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
