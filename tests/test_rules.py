"""Rules of values: secrets, digests, chunks, queries, batches, removals, logs, ledgers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.functions import markdown, text
from quernstone.operators import governance, ledger
from quernstone.plans import index, ingest, query
from quernstone.sources import files, notes, rollouts, transcripts


def values(spark, column, given):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_whole_values_are_taken_out(spark):
    given = {
        "password=[redacted]abc": ("password=[REDACTED]", 1), "password=[REDACTED]": ("password=[REDACTED]", 0), "secret: 'masked'": ("secret: 'masked'", 0), "api_key=maskedx": ("api_key=[REDACTED]", 1),
        "密码=masked123": ("密码=[REDACTED]", 1), "密码：abc": ("密码：abc", 0), "口令 a1b2，x": ("口令 [REDACTED]，x", 1), 'token "auth-token": "a.b"': ('token "auth-token": "[REDACTED]"', 1),
        'password="open': ('password="open', 0), "passwd: x; secret=y": ("passwd: [REDACTED]; secret=[REDACTED]", 2), "": ("", 0), "redacted": ("redacted", 0), "Bearer abcdefghijkl": ("[REDACTED]", 1),
    }
    assert values(spark, text.redact, given) == [v for v, _ in given.values()]
    assert values(spark, text.redaction_count, given) == [n for _, n in given.values()]


def test_any_column_changes_an_index_digest(spark):
    df = spark.createDataFrame([("a", "title", "body"), ("b", None, "other")], "item_id string, source_title string, body string")
    same, other = df.orderBy(F.desc("item_id")), df.withColumn("source_title", F.lit("new"))
    assert index.content_digest(df) == index.content_digest(same) != index.content_digest(other)


def test_chunks():
    long = " ".join(f"word{i}" for i in range(120))  # about 290 tokens
    sentences = "".join(f"{long}{i}.\n" for i in range(4))
    parts = markdown.chunks(sentences.strip())
    assert len(parts) == 2 and "\n".join(parts) == sentences.strip()
    lines = [f"x{i} = {i}" for i in range(600)]
    code = markdown.chunks("\n".join(["```py", *lines, "```"]))
    assert code[0].startswith("```py\nx0 = 0") and code[-1].endswith("x599 = 599\n```") and sum(c.count("```") for c in code) == 2
    assert [x for c in code for x in c.split("\n") if "=" in x] == lines
    item = "- " + " ".join(f"word{i}" for i in range(270))
    assert 600 < markdown.tokens(item) <= 800
    assert markdown.chunks("\n".join([item] * 3)) == [item] * 3
    quote = "\n>\n".join("> " + long for _ in range(4))
    assert markdown.chunks(quote) == [f"> {long}\n>\n> {long}\n>", f"> {long}\n>\n> {long}"]
    table = ["| a | b |", "|---|---|", *(f"| {long} | {i} |" for i in range(4))]
    found = markdown.chunks("\n".join(table))
    assert found[0].split("\n")[:2] == table[:2] and [x for c in found for x in c.split("\n")] == table
    assert all(markdown.tokens(c) <= 800 for c in markdown.chunks("z" * 9000)) and "".join(markdown.chunks("z" * 9000)) == "z" * 9000


@pytest.mark.parametrize(("given", "reason"), [(7, "wrong_type"), ("x" * 257, "unicode_scalar_limit"), ("漢" * 250 + "\U00020000" * 6 + "x", "unicode_scalar_limit"), ("\ud800", "invalid_unicode_scalar"), ("\U00020000" * 256 + "", None), ("a\tb", "control_character"), ("a\nb", "control_character"), ("a\u202eb", "bidi_control"), ('"a"', "raw_fts_syntax"), ("a:b", "column_filter_separator"), ("a:::b", "column_filter_separator"), ("  ", "empty_query"), ("[a] a::b", None)])
def test_queries(given, reason):
    if reason is None:
        assert query.checked(given)
    else:
        with pytest.raises(query.QueryError) as e:
            query.checked(given)
        assert e.value.reason == reason


def test_links_of_a_line():
    line = "![a](x.png \"t\") [b]( <y z.md> ) [](no) [c](/p(q) ![](e.gif) [d [e](f) [g](h 'i'"
    assert [x[2:] for x in notes.inline(line)] == [("image", "x.png", "a"), ("link", "y z.md", "b"), ("link", "/p(q", "c"), ("image", "e.gif", ""), ("link", "f", "d [e")]
    assert notes.slug(" A `b`_c - D! é 漢 ") == "a-bc-d-é-漢"


def batch(spark, rows):
    planned = spark.createDataFrame([("p", s, raw, f"out/{s}", "h", "text " + s) for s, raw in rows], "provider string, source_id string, source_path string, output_path string, source_hash string, text string")
    units = spark.createDataFrame([("p", s, raw, "all", "ready", "") for s, raw in rows], ingest.UNITS)
    snapshots = spark.createDataFrame([(raw, "d") for _, raw in rows], "path string, sha256 string")
    return planned, units, snapshots


def test_batches_are_committed_or_blocked_as_a_whole(spark, tmp_path):
    root = str(tmp_path)
    planned, units, snapshots = batch(spark, [("a", "raw/a"), ("b", "raw/b")])
    stats = ingest.execute(planned, units, snapshots, snapshots, root, dry_run=True).first()
    assert (stats.imported, stats.blocked) == (2, False) and ingest.current(spark, root).number == 0
    with pytest.raises(ingest.BatchFault, match="changed"):
        ingest.execute(planned, units, snapshots, snapshots.withColumn("sha256", F.lit("e")), root)
    assert ingest.execute(planned, units, snapshots, snapshots, root).first().imported == 2
    assert {r.source_id for r in ingest.current(spark, root).manifest.collect()} == {"a", "b"}
    # one new source, and one whose id another raw file has
    planned, units, snapshots = batch(spark, [("c", "raw/c"), ("a", "raw/z")])
    stats = ingest.execute(planned, units, snapshots, snapshots, root).first()
    assert (stats.imported, stats.deferred, stats.skipped, stats.blocked, stats.skip_reasons) == (0, 1, 1, True, {ingest.SAME_ID: 1})
    state = ingest.current(spark, root)
    assert {r.source_id for r in state.manifest.collect()} == {"a", "b"} and state.number == 2
    assert {(r.raw_path, r.skip_reason) for r in state.inventory.collect()} == {("raw/a", ""), ("raw/b", ""), ("raw/c", ""), ("raw/z", ingest.SAME_ID)}
    # an update of its own output is no conflict; an unregistered file is
    planned, units, snapshots = batch(spark, [("b", "raw/b"), ("d", "raw/d")])
    there = spark.createDataFrame([("out/d",), ("out/b",)], "path string")
    plan = ingest.prepare(planned, units, state.manifest, state.inventory, there)
    assert [r.source_id for r in plan.sources.collect()] == ["b"] and {r.source_id: r.skip_reason for r in plan.units.collect()} == {"b": "", "d": ingest.SAME_OUTPUT}
    with pytest.raises(ingest.BatchFault, match="another batch"):
        ingest.commit(spark, root, 1, state.manifest, state.inventory, None)


def test_removal(spark):
    sources = spark.createDataFrame([("a", "out/a", None, None), ("b", "out/b", "a", None), ("c", "out/c", None, None)], "source_id string, output_path string, duplicate_of string, fork_parent_source_id string")
    assets = spark.createDataFrame([("b", "x"), ("b", "y"), ("c", "y")], "source_id string, path string")
    plan = lambda s: {tuple(r) for r in governance.removal_plan(s, sources, assets).collect()}
    assert plan("a") == set() and plan("b") == {("delete", "out/b"), ("delete", "x"), ("keep", "y")} and plan("nobody") == set()


def test_log_against_history(spark):
    schema = "path string, action string, sha256 string, at int"
    log = spark.createDataFrame([("a", "added", "1", 1), ("a", "updated", "2", 2), ("b", "added", "3", 1), ("b", "deleted", None, 2), ("c", "deleted", None, 1)], schema)
    history = spark.createDataFrame([("a", "added", "2", 5), ("c", "updated", "4", 1)], schema)
    assert [tuple(r) for r in governance.log_differences(log, history).collect()] == [("c", "deleted", "updated 4")]


def test_unprocessed_and_status(spark):
    rows = spark.createDataFrame([("b", "2024", "unprocessed", "ready"), ("a", None, "unprocessed", "ready"), ("c", "2023", "done", "ready"), ("d", "2020", "unprocessed", "review")], "source_id string, created string, curation_status string, ingest_status string")
    assert [r.source_id for r in governance.unprocessed(rows).collect()] == ["b", "a"]
    new = governance.with_status(rows, spark.createDataFrame([("b", "done")], "source_id string, curation_status string"))
    assert [r.source_id for r in governance.unprocessed(new).collect()] == ["a"]
    parsed = spark.createDataFrame([("b", "2025"), ("x", "2024")], "source_id string, created string")
    found = {(r.source_id, r.problem) for r in governance.reparsed_differences(rows, parsed, ["created"]).collect()}
    assert found == {("a", "raw source is gone"), ("c", "raw source is gone"), ("x", "raw source isn't registered"), ("b", "created")}


def test_ledger_reports(spark):
    rows = spark.createDataFrame([("t", "1", "search", "succeeded", None), ("t", "2", "read", "succeeded", "x"), ("t", "3", "read", "failed", "y")], "task_id string, call_id string, kind string, state string, seed string")
    cited = spark.createDataFrame([("t", "1", "x"), ("t", "1", "y"), ("t", "2", "x"), ("t", "3", "y")], "task_id string, call_id string, item_id string")
    assert {(r.item_id, r.searches, r.reads, r.was_read) for r in ledger.citations(rows, cited).collect()} == {("x", 1, 1, True), ("y", 1, 0, False)}


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f'{{"n": {i}}}' if i % 7 else "" for i in range(1, 3001)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("x\r\n\r\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.jsonl_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.content) for r in found if r.path.endswith("a.jsonl")) == [(i, x) for i, x in enumerate(lines, 1) if x]
    assert sorted((r.line, r.content) for r in found if r.path.endswith("b.jsonl")) == [(1, "x"), (3, "y")]


def test_thread_kinds_and_ids(spark):
    rows = [("subagent", None, "a/rollout-x.jsonl"), (None, '{"subagent": 1}', "rollout-2024-01234567-89ab-cdef-0123-456789abcdef.jsonl"), ("user", None, "b"), (None, "cli", "b.x.y"), (None, None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, p string").orderBy("i")
    out = df.select(rollouts.thread_kind(F.col("t"), F.col("s")), rollouts.id_of_path(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [("subagent", "x"), ("subagent", "01234567-89ab-cdef-0123-456789abcdef"), ("main", "b"), ("main", "b.x"), ("unknown", "")]


def test_export_messages(spark):
    body = ["# Session: talk", "## 👤 User (Turn 3)", "*now UTC*", "", "<system-reminder>x</system-reminder>", "what is it?", "## 🤖 Assistant", "> **Tool: run**", "> out", "", "hidden?", "## 🤖 Assistant", "<details><summary>💭 Thinking</summary>hm</details>", "the answer", "## User", transcripts.COMPACTION, "## User", "[Request interrupted by user]", "## User", "/clear", "## User", "again", "## Assistant", "> **⚠ Error:** no", "> more", "said"]
    rows = transcripts.export_messages(spark.createDataFrame([("f", "\n".join(body)), ("g", "# Session: hi\n## User\nx\n## Assistant\ny"), ("h", None), ("i", "plain")], "path string, text string"))
    counts = {r.path: r for r in transcripts.export_counts(rows).collect()}
    f = counts["f"]
    assert (f.skip_reason, f.users, f.human, f.compaction, f.interruption, f.runtime, f.tools, f.thoughts, f.errors) == ("", 5, 2, 1, 1, 1, 1, 1, 1)
    assert counts["g"].skip_reason == "trivial_session" and counts["h"].skip_reason == counts["i"].skip_reason == "incomplete_session"
    out = sorted((r.turn, r.user_text, r.assistant_text, r.status) for r in transcripts.export_exchanges(rows).collect())
    assert out == [(3, "what is it?", "", "unpaired"), (5, "again", "said", "paired")]


def test_metadata_projects_and_document_kinds(spark):
    df = spark.createDataFrame([({"Api_Key": "abc", "note": "password=x", "title": "t"}, "/a/-home-me-code-x-/f.jsonl", "my-notes/a.md", "x"), ({}, "f", "a.md", "# Project: p\n## Project Memory: m"), ({"a": None}, "/--/f", "01-prompt-history.md", "")], "m map<string,string>, p string, path string, text string")
    rows = df.select(text.redacted_map(F.col("m")).alias("m"), text.map_redaction_count(F.col("m")).alias("n"), text.project_of(F.col("p"), ("-home-me-", "-home-")).alias("project")).collect()
    assert [(r.m, r.n, r.project) for r in rows] == [({"Api_Key": "[REDACTED]", "note": "password=[REDACTED]", "title": "t"}, 2, "code-x"), ({}, 0, "global"), ({"a": None}, 0, "global")]
    assert [r.kind for r in transcripts.with_document_kind(df.select("path", "text")).collect()] == ["note", "instruction", "prompt-history"]
