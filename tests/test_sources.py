"""Importers, governance, ledger and log on small files and rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import governance
from quernstone.operators.ledger import Ledger, LedgerError, last_seen, summary
from quernstone.sources import files, rollouts, transcripts
from quernstone.streaming import log


def message(role, text, phase=None):
    kind = "input_text" if role == "user" else "output_text"
    return {"type": "response_item", "payload": {"type": "message", "role": role, "phase": phase, "content": [{"type": kind, "text": text}]}}


def event(kind):
    return {"type": "event_msg", "payload": {"type": kind}}


def answered(u, a):
    return [event("task_started"), message("user", u), message("assistant", "thinking", "commentary"), message("assistant", a, "final_answer"), event("task_complete")]


def test_rollouts(spark, tmp_path):
    lines = [{"type": "session_meta", "payload": {"id": "s1"}}, message("user", "before any task"), *answered("first question", "first answer")]
    lines += [event("task_started"), message("user", "<environment_context>x</environment_context>"), message("user", "# AGENTS.md instructions for /x\n\n<INSTRUCTIONS>y</INSTRUCTIONS>"), {"type": "turn_context", "payload": {}}, message("user", "stopped one"), message("user", "/compact now"), message("user", '<send_user_message_question_reply>[{"question": "which?", "answer": "that"}]</send_user_message_question_reply>'), event("turn_aborted")]
    lines += [event("task_started"), message("user", "again"), event("task_complete"), *answered("finally", "answer to all"), *answered("hi", "Hello! How can I help you?")]
    lines += [event("task_started"), message("user", "lost"), event("task_started"), message("user", "open")]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n[1]\n")
    records, invalid = files.parsed_lines(files.jsonl_lines(spark, str(tmp_path)), rollouts.RECORD)
    assert [tuple(r) for r in invalid.collect()] == [("a.jsonl", 1)]
    turns = rollouts.turns(rollouts.events(records))
    assert [r.terminal for r in turns.orderBy("turn").collect()] == ["complete", "aborted", "complete", "complete", "complete", "superseded", "active"]
    out = [tuple(r)[1:] for r in rollouts.exchanges(turns).orderBy("turn").collect()]
    assert out == [
        (1, 1, ["first question"], "first answer", False, False),
        (4, 2, ["stopped one", "助手问题：which?\n用户回答：that", "again", "finally"], "answer to all", True, False),
        (5, 5, ["hi"], "Hello! How can I help you?", False, True),
    ]


def test_forks(spark):
    rows = [("p", i, [f"q{i}"], f"a{i}") for i in (1, 2, 3)] + [("c", 1, ["q1"], "a1"), ("c", 2, ["q2"], "other"), ("c", 3, ["q3"], "a3"), ("c", 4, ["q4"], "a4")]
    sessions = spark.createDataFrame(rows, "path string, turn int, user_messages array<string>, assistant_text string")
    forks = spark.createDataFrame([("c", "p"), ("p", None)], "path string, parent string")
    assert sorted((r.path, r.turn) for r in rollouts.fork_delta(sessions, forks).collect()) == [("c", 2), ("c", 3), ("c", 4), ("p", 1), ("p", 2), ("p", 3)]
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "z"), ("z", "y")], "path string, parent string")
    found = {r.path: (r.depth, r.state) for r in rollouts.ancestors(chain).collect()}
    assert found["y"] == found["z"] == (None, "cycle")
    long = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(100)] + [("lost", "nobody"), ("after", "lost")], "path string, parent string")
    depths = {r.path: (r.depth, r.state) for r in rollouts.ancestors(long).collect()}
    assert all(depths[str(i)] == (i, "ok") for i in range(100)) and depths["lost"] == (1, "missing") and depths["after"] == (2, "missing")
    assert rollouts.ancestors(chain.limit(0)).collect() == []
    assert {k: v for k, v in found.items() if v[1] != "cycle"} == {"a": (0, "ok"), "b": (1, "ok"), "c": (2, "ok"), "x": (1, "missing")}
    assert {r.path for r in rollouts.ancestors(chain).where("state = 'cycle'").collect()} == {"y", "z"}


WEB = """> From: https://chatgpt.com/c/1
# you asked
message time: 2024-01-02 03:04:05
What?
```
# you asked
```
---
# chatgpt response
That.
# you asked
Nobody answers
# you asked
Two
# chatgpt response
one
# chatgpt response
two
"""

EXPORT = """# Project
# Session: one
## User (Turn 1)
*2024-01-01 UTC*
do it
## Assistant
working
> **Tool:** Bash
> ls
## Assistant
done
## User (Turn 2)
more
## Assistant
begun
## User
[Request interrupted by user]
# Session: two
## 👤 User
<command-name>x</command-name>
## 👤 User
hey there friend
## 🤖 Assistant
<details><summary>💭 Thinking</summary>
hm
</details>
yes
# Session: test
## User
test
## Assistant
ok
"""


def test_transcripts(spark):
    out = transcripts.parse(spark.createDataFrame([("w.md", WEB)], "path string, text string"), "web").orderBy("turn").collect()
    assert [(r.turn, r.status, r.assistant_text, r.user_time) for r in out] == [(1, "paired", "That.", "2024-01-02 03:04:05"), (2, "unpaired", "", ""), (3, "ambiguous", "", "")]
    assert out[0].user_locator == "w.md/Turn:1/User@L2-L8" and "# you asked" in out[0].user_text
    out = transcripts.parse(spark.createDataFrame([("e.md", EXPORT), ("none.md", None)], "path string, text string"), "export").orderBy("session", "turn").collect()
    assert [(r.session, r.turn, r.status, r.assistant_text) for r in out] == [("e.md#Session:1", 1, "paired", "done"), ("e.md#Session:1", 2, "unpaired", ""), ("e.md#Session:2", 2, "paired", "yes")]


def test_front_matter_and_ranges(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("---\ntitle: 'A b'\nauthor:\n---\nline 1\nline 2\nline 3\n")
    (tmp_path / "x" / "b.md").write_text("---\nnever closed\n")
    (tmp_path / ".hidden.md").write_text("no")
    rows = files.standardised(files.markdown(spark, str(tmp_path)))
    got = {r.path: r for r in rows.withColumn("article", files.article_metadata(F.col("metadata"))).collect()}
    assert got.keys() == {"x/a.md", "x/b.md"}
    assert got["x/a.md"].metadata == {"title": "A b", "author": ""} and got["x/a.md"].article.author == "unknown" and got["x/a.md"].body.startswith("line 1")
    assert got["x/b.md"].metadata is None and got["x/b.md"].body is None
    asked = spark.createDataFrame([("x/a.md@L5-L6",), ("x/a.md@L6-L99",), ("gone.md@L1-L1",), ("no locator",)], "locator string")
    read = {r.locator: r.lines for r in files.read_ranges(rows, asked).collect()}
    assert read["x/a.md@L5-L6"] == "line 1\nline 2" and read["x/a.md@L6-L99"] is None and read["gone.md@L1-L1"] is None


def test_governance(spark):
    a = spark.createDataFrame([("1", "x", None), ("2", "y", "v")], "id string, f string, g string")
    b = spark.createDataFrame([("1", "x", "w"), ("3", "y", "v")], "id string, f string, g string")
    assert [tuple(r) for r in governance.field_differences(a, b, "id", ["f", "g"]).collect()] == [("1", "g", None, "w")]
    rows = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "id int, same boolean")
    assert governance.admitted(rows, "id", ~F.col("same"), 2).where("NOT same").count() == 2
    units = spark.createDataFrame([("p", "imported", ""), ("p", "skipped", "r1"), ("p", "skipped", "r1"), ("q", "unchanged", "")], "provider string, status string, reason string")
    assert {r.provider: r.skip_reasons for r in governance.provider_stats(units).collect()} == {"p": {"r1": 2}, "q": None}
    deps = spark.createDataFrame([("s1", "t", None), ("s2", None, "t"), ("s3", "o", None)], "source_id string, duplicate_of string, fork_parent_source_id string")
    assert governance.removal_blockers(F.lit("t"), deps).count() == 2


def test_ledger(spark):
    book = Ledger(max_searches=2, max_reads=1, max_tokens=500, capacity=1)
    task = book.create("me", "idx")
    with pytest.raises(LedgerError, match="capacity"):
        book.create("me", "idx")
    call = book.admit_search(task, "me", "idx", ["a"], ["note"], 300)
    for code, f in (("task_busy", lambda: book.admit_search(task, "me", "idx", ["b"], ["note"], 1)), ("task_not_found", lambda: book.admit_search(task, "you", "idx", ["b"], ["note"], 1)), ("seed_not_found", lambda: book.admit_read(task, "me", "idx", "i1", 1))):
        with pytest.raises(LedgerError, match=code):
            f()
    book.settle(task, "me", call, "succeeded", 200, ["i1", "i2"])
    for code, f in (("duplicate_search", lambda: book.admit_search(task, "me", "idx", ["a"], ["note"], 1)), ("index_mismatch", lambda: book.admit_read(task, "me", "other", "i1", 1)), ("token_limit", lambda: book.admit_read(task, "me", "idx", "i1", 301)), ("call_not_pending", lambda: book.settle(task, "me", call, "failed"))):
        with pytest.raises(LedgerError, match=code):
            f()
    read = book.admit_read(task, "me", "idx", "i1", 100)
    book.settle(task, "me", read, "uncertain")
    with pytest.raises(LedgerError, match="read_limit"):
        book.admit_read(task, "me", "idx", "i2", 1)
    calls, cited = book.frames(spark)
    assert [tuple(r)[1:] for r in summary(calls).collect()] == [(1, 1, 0, 1, 300, 0)]
    assert sorted(tuple(r)[1:] for r in last_seen(cited).collect()) == [("i1", 1, 1), ("i2", 1, 1)]


def test_log_in_batches_and_as_a_stream(spark, tmp_path):
    path, good = str(tmp_path / "log"), "0" * 64
    put = lambda rows, t: log.append(spark.createDataFrame(rows, "path string, action string, sha256 string"), path, "notes", t)
    put([("a", "added", good), ("b", "added", good)], "2024-01-01 10:00:00")
    put([("a", "deleted", None)], "2024-01-01 12:00:00")
    put([("../c", "added", good), ("d", "updated", None)], "2024-01-01 15:30:00")
    put([], "2024-01-01 16:00:00")
    entries = log.entries(spark, path)
    assert entries.count() == 3
    assert {r.path: r.action for r in log.latest_state(log.flat(entries)).collect()}["a"] == "deleted"
    assert sorted(r.path for r in log.invalid_entries(entries).collect()) == ["../c", "d"]
    running = log.activity(log.stream(spark, path)).writeStream.outputMode("append").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sum(r.n for r in spark.table("activity").collect()) == 3
