"""Notes and assets, batches, queues, consistency, rendered documents that project back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import batches
from quernstone.operators.projection import project, rejections
from quernstone.sources import files, notes, transcripts

BODY = """# Top
![a pic](img/a.png "t") and [to](#top) and [gone](#nowhere)
<img src="b.JPG" alt="b"> <a href='https://x.y/z'>x</a> https://bare.example/p.
```
![no](c.png)
```
![far](../../etc/d.png) ![doc](e.txt) ![lost](f.png)
"""


def test_references_and_assets(spark):
    sources = spark.createDataFrame([("n/note.md", BODY), ("n/none.md", None)], "path string, body string")
    found = notes.scan(sources)
    got = [(r.line, r.kind, r.target, r.status) for r in found.collect()]
    assert got == [
        (2, "image", "img/a.png", "local"), (2, "link", "#top", "anchor"), (2, "link", "#nowhere", "missing_anchor"), (3, "image", "b.JPG", "local"), (3, "link", "https://x.y/z", "remote"),
        (3, "link", "https://bare.example/p", "remote"), (7, "image", "../../etc/d.png", "escape"), (7, "image", "e.txt", "local"), (7, "image", "f.png", "local"),
    ]
    there = spark.createDataFrame([("n/img/a.png", "aa"), ("n/b.JPG", "bb"), ("n/e.txt", "ee")], "path string, sha256 string")
    stored = notes.assets(found, there)
    assert {r.target: (r.status, r.asset) for r in stored.collect()} == {"img/a.png": ("stored", "aa.png"), "b.JPG": ("stored", "bb.jpg"), "../../etc/d.png": ("escape", None), "e.txt": ("unsupported", None), "f.png": ("missing", None)}
    body = notes.rewritten(sources, stored).where("path = 'n/note.md'").first().body
    assert '(img/a.png "t")' in body and 'src="../assets/bb.jpg"' in body
    assert {r.asset: r.sources for r in notes.reference_counts(stored).collect()} == {"aa.png": 1, "bb.jpg": 1}


def test_batches(spark):
    manifest = spark.createDataFrame([("s1", "h1", 1, "o1"), ("s2", "h2", 1, "o2"), ("s9", "h", 1, "o9")], "source_id string, source_hash string, importer_version int, output_path string")
    planned = spark.createDataFrame([("s1", "h1", "o1"), ("s2", "new", "o2"), ("s3", "h", "o9"), ("s4", "h", "o4"), ("s5", "h", "o5"), ("s5", "h", "o6")], "source_id string, source_hash string, output_path string")
    assert {r.source_id for r in batches.unchanged(planned, manifest, 1).where("unchanged").collect()} == {"s1"}
    existing = spark.createDataFrame([("o1",), ("o4",)], "path string")
    assert {r.source_id: r.reason for r in batches.conflicts(planned, manifest, existing).collect()} == {"s3": "output_of_another_source", "s4": "unregistered_file", "s5": "repeated_id"}


def test_inventory_and_queue(spark):
    schema = "source_id string, raw_path string, raw_locator string, provider string, created string, thread_kind string, skip_reason string, parse_status string, title string, reason string"
    kept = spark.createDataFrame([("a", "r1", "l", "p", "unknown", "main", "", "ready", "A", ""), ("b", "r2", "l", "p", "2024-01-01", "main", "", "ready", "B", "")], schema)
    new = spark.createDataFrame([("b", "r2", "l", "p", "2024-02-01", "main", "trivial", "review", "", "odd"), ("b", "r2", "l", "p", "2024-02-01", "main", "trivial", "review", "", "odd")], schema)
    units = batches.merged_inventory(kept, new, new)
    assert sorted((r.source_id, r.created) for r in units.collect()) == [("a", "unknown"), ("b", "2024-02-01")]
    row = batches.inventory_summary(units).first()
    assert (row.units, row.documents, row.first, row["last"], row.reasons) == (2, 2, "2024-02-01", "2024-02-01", {"trivial": 1})
    manifest = spark.createDataFrame([("m", "M", "p", "2023", "r7", "review", "why"), ("n", "N", "p", "2023", "r2", "review", "hidden by the inventory"), ("o", "O", "p", "2023", "r8", "ready", "")], "source_id string, title string, provider string, created string, raw_path string, ingest_status string, reason string")
    assert [(r.source_id, r.title, r.reason) for r in batches.review_items(manifest, units).collect()] == [("m", "M", "why"), ("b", "b", "odd")]


def test_consistency(spark):
    manifest = spark.createDataFrame([("s1", "h1", "o1", None, None), ("s2", "h2", "o2", "s1", "gone"), ("s3", "h3", "o3", None, None), ("s4", "h4", "o1", None, None)], "source_id string, source_hash string, output_path string, duplicate_of string, fork_parent_source_id string")
    present = spark.createDataFrame([("o1", "s1", "h1"), ("o2", "s2", "other"), ("o5", "s5", "h5")], "path string, source_id string, source_hash string")
    got = {(r.source_id, r.problem) for r in batches.consistency(manifest, present).collect()}
    assert got == {("s2", "hash"), ("s3", "missing file"), ("s5", "orphan file"), ("s4", "id"), ("s1", "repeated output"), ("s2", "fork parent isn't there")}


def test_rendered_conversations_project_back(spark):
    text = "# you asked\nwhat is it?\n# chatgpt response\nan *answer*\n# you asked\nand then?\n# chatgpt response\nmore\n"
    pairs = transcripts.parse(spark.createDataFrame([("w.md", text)], "path string, text string"), "web").where("status = 'paired'")
    bodies = batches.rendered_sessions(pairs)
    meta = F.create_map(F.lit("provider"), F.lit("chatgpt"), F.lit("created"), F.lit("2024-01-01"), F.lit("exchange_count"), F.col("exchange_count").cast("string"), F.lit("title"), F.lit('say "x": y'))
    documents = bodies.select(F.lit("c/w.md").alias("path"), batches.rendered(meta, F.col("body")).alias("text"))
    back = files.standardised(documents)
    assert back.first().metadata["exchange_count"] == "2" and documents.first().text.startswith("---\ncreated: ")
    sources = back.select(F.col("path").alias("source_path"), F.lit("w").alias("source_id"), F.lit(None).cast("string").alias("source_title"), F.lit("conversation").alias("scope"), "metadata", "body", F.lit(8).alias("first_line"))
    assert rejections(sources).collect() == []
    assert [(r.role, r.body) for r in project(sources).orderBy("turn_index", F.desc("role")).collect()] == [("human", "what is it?"), ("assistant", "an *answer*"), ("human", "and then?"), ("assistant", "more")]
