"""The durable ledger, the task service, strict JSON, pages and counts of sessions."""

from __future__ import annotations

import json

import pytest

from quernstone.operators import batches, governance
from quernstone.operators.ledger import LedgerError
from quernstone.operators.projection import project_documents
from quernstone.plans import strict
from quernstone.plans.index import Index, build, publish
from quernstone.plans.retrieval import Retrieval, RetrievalError
from quernstone.plans.service import DurableLedger, TaskService, checked
from quernstone.sources import rollouts


def test_strict_json(tmp_path):
    assert strict.parse(b'{"a": ["x]]]]]]]]]]", {"b": 1.5}], "\\"": null}') == {"a": ["x]]]]]]]]]]", {"b": 1.5}], '"': None}
    for bad, over in ((b"[" * 9 + b"]" * 9, True), (b'{"a": 1, "a": 2}', False), (b"NaN", False), (b"1e999", False), (b'"\\u0000"', False), (b'"\\ud800"', False), (b"\xff", False), (b"{", False), (json.dumps([0] * 1025).encode(), True), (json.dumps({str(i): 0 for i in range(4097)}).encode(), True)):
        with pytest.raises(strict.StrictError) as e:
            strict.parse(bad)
        assert e.value.over_limit == over, bad[:20]
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text('{"a": 1}' + " " * 70_000)
    for name in "cd":
        with pytest.raises(strict.StrictError):
            strict.config(tmp_path / f"{name}.json")


def test_a_ledger_survives_its_process(tmp_path):
    path = tmp_path / "ledger"
    one = DurableLedger(path)
    task = one.create("me", "idx")
    first = one.admit("search", task, "me", "idx", ["q"], ["note"], 100)
    one.settle(task, "me", first, "succeeded", 40, ["itm"])
    one.admit("read", task, "me", "idx", "itm", 70)
    with pytest.raises(LedgerError, match="ledger_busy"):
        DurableLedger(path)
    one.close()
    with open(path, "ab") as f:
        f.write(b'["settled", "half a li')
    two = DurableLedger(path)
    calls = two.ledger.tasks[task].calls
    assert [(c.kind, c.state, c.used) for c in calls] == [("search", "succeeded", 40), ("read", "uncertain", 70)]
    with pytest.raises(LedgerError, match="duplicate_search"):
        two.admit("search", task, "me", "idx", ["q"], ["note"], 100)
    two.close_task(task, "me")
    assert two.health()["tasks"] == 1 and two.health()["open"] == 0
    two.close()
    three = DurableLedger(path, max_bytes=path.stat().st_size + 5)
    assert three.ledger.tasks[task].state == "closed" and not three.close()
    full = DurableLedger(path, max_bytes=path.stat().st_size + 5)
    with pytest.raises(LedgerError, match="capacity"):
        full.create("me", "idx")
    assert len(full.ledger.tasks) == 1
    full.close()


def test_tasks(spark, tmp_path):
    sources = spark.createDataFrame([("n/a", "Quokkas", "note", "# Sleep\nquokkas sleep by day"), ("n/b", "Wombats", "note", "# Dig\nwombats dig burrows")], "source_path string, source_title string, scope string, body string")
    root = f"{tmp_path}/index"
    publish(spark, root, build(project_documents(sources), root))
    service = TaskService(Retrieval(Index.open(spark, root)), DurableLedger(tmp_path / "ledger"))
    task = service.begin("me")
    found = service.search(task, "me", ["quokka"])
    seed = found["results"][0]["metadata"]["item_id"]
    with pytest.raises(LedgerError, match="duplicate_search"):
        service.search(task, "me", ["Quokka"])
    with pytest.raises(LedgerError, match="seed_not_found"):
        service.read(task, "me", "itm_other")
    with pytest.raises(RetrievalError):
        service.read(task, "me", seed, max_tokens=1)
    assert service.read(task, "me", seed)["bundle_status"] == "complete"
    details = service.details(task, "me")
    assert [(c["kind"], c["state"]) for c in details["calls"]] == [("read", "succeeded"), ("read", "failed"), ("search", "succeeded")]
    assert details["items"] == [{"item_id": seed, "last_sequence": 3}] and not details["is_truncated"]
    with pytest.raises(RetrievalError, match="ranks"):
        checked(found | {"results": [found["results"][0] | {"rank": 2}]})
    with pytest.raises(LedgerError, match="task_not_found"):
        service.details(task, "you")


def test_pages_of_sessions(spark):
    sessions = spark.createDataFrame([("s", "About password=abc", {"provider": "p", "exchange_count": "9"}, ["forked from x"]), ("e", "Empty", {"provider": "p"}, [])], "session string, title string, metadata map<string,string>, notes array<string>")
    rows = [("s", 3, "hi\r\nthere", "said", "u@L1-L2", ["u@L1-L1", "u@L2-L2"], "a@L3-L3", True), ("s", 1, "first", "token: t1", "u0", ["u0"], "a0", False), ("s", 2, "<system-reminder>x</system-reminder>", "dropped", "u", ["u"], "a", False)]
    exchanges = spark.createDataFrame(rows, "session string, turn int, user_text string, assistant_text string, user_locator string, user_locators array<string>, assistant_locator string, recovered boolean")
    out = {r.session: r.text for r in batches.session_pages(sessions, exchanges).collect()}
    assert out["s"] == """---
exchange_count: "2"
provider: p
redaction_count: "1"
title: "About password=[REDACTED]"
---

# About password=[REDACTED]

> forked from x

## Exchange 1

- **Turn**: 1
- **User locator**: `u0`
- **Assistant locator**: `a0`

### Human user

first

### Assistant final

token: t1

## Exchange 2

- **Turn**: 3
- **User locator**: `u@L1-L2`
- **User message count**: 2
- **User message 1 locator**: `u@L1-L1`
- **User message 2 locator**: `u@L2-L2`
- **Recovered incomplete sequence**: true
- **Assistant locator**: `a@L3-L3`

### Human user

hi
there

### Assistant final

said
"""
    assert 'exchange_count: "0"' in out["e"] and out["e"].endswith("# Empty\n")


def test_counts_and_skip_reasons_of_rollouts(spark):
    line = lambda kind, payload: {"type": kind, "payload": payload}
    said = lambda role, text, phase=None: line("response_item", {"type": "message", "role": role, "phase": phase, "content": [{"type": "input_text" if role != "assistant" else "output_text", "text": text}]})
    event = lambda kind: line("event_msg", {"type": kind})
    item = lambda kind: line("response_item", {"type": kind})
    lines = [said("developer", "d"), event("task_started"), line("turn_context", {}), said("user", "question"), said("user", "/clear"), item("reasoning"), item("function_call"), item("function_call_output"), said("assistant", "hm", "commentary"), said("assistant", "x"), said("assistant", "answer", "final_answer"), event("task_complete"), event("task_started"), line("turn_context", {}), said("user", "open"), line("compacted", {})]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines, 1)], "path string, line int, content string")
    records = df.selectExpr("path", "line", f"from_json(content, '{rollouts.RECORD}') AS record")
    counts = rollouts.line_counts(records, spark.createDataFrame([("g", 2)], "path string, invalid long")).collect()
    f = next(r for r in counts if r.path == "f")
    assert (f.developer, f.commentary, f.unphased, f.tool_calls, f.tool_results, f.reasoning, f.compactions, f.interrupted, f.runtime_users, f.invalid) == (1, 1, 1, 1, 1, 1, 1, 0, 1, 0)
    assert next(r for r in counts if r.path == "g").invalid == 2
    turns = rollouts.turns(rollouts.events(records))
    t = rollouts.turn_counts(turns, rollouts.exchanges(turns)).first()
    assert (t.users, t.active_open, t.superseded, t.exchanges, t.trivial, t.unpaired) == (2, 1, 0, 1, 0, 1)
    columns = "path string, thread_kind string, resolution string, invalid int, active_open int, superseded int, ambiguous_finals int, users int, exchanges int, trivial int"
    units = [("a", "subagent", "", 0, 0, 0, 0, 1, 1, 0), ("b", "unknown", "", 0, 0, 0, 0, 1, 1, 0), ("c", "main", "mismatch", 1, 0, 0, 0, 1, 1, 0), ("d", "main", "", 1, 0, 0, 0, 1, 1, 0), ("e", "main", "match", 1, 0, 2, 0, 1, 1, 0), ("f", "main", "", 0, 1, 1, 0, 1, 1, 0), ("g", "main", "", 0, 0, 1, 0, 1, 1, 0), ("h", "main", "", 0, 0, 0, 0, 0, 0, 0), ("i", "main", "", 0, 0, 0, 0, 2, 0, 2), ("j", "main", "", 0, 0, 0, 0, 2, 0, 1)]
    out = {r.path: r.skip_reason for r in rollouts.with_skip_reason(spark.createDataFrame(units, columns)).collect()}
    assert out == dict(zip("abcdefghij", ["subagent_excluded", "thread_kind_review", "review_resolution_mismatch_review", "invalid_jsonl_review", "", "active_session_deferred", "turn_boundary_review", "no_human_user", "trivial_session", "no_final_visible"], strict=True))


def test_assets(spark):
    assets = spark.createDataFrame([("a", "sources/assets/x.png", "1"), ("a", "sources/assets/../x", "1"), ("b", "/etc/x", "1"), ("b", "sources/assets/y", "2"), ("c", "sources/assets/z", "3"), ("c", None, "3"), ("d", "sources/assets/a\\b", "3")], "source_id string, path string, sha256 string")
    files = spark.createDataFrame([("sources/assets/x.png", "1"), ("sources/assets/y", "9")], "path string, sha256 string")
    found = {(r.source_id, r.problem) for r in governance.asset_problems(assets, files).collect()}
    assert found == {("a", "outside"), ("b", "outside"), ("b", "changed"), ("c", "missing"), ("c", "invalid record"), ("d", "outside")}
    assert [r.path for r in governance.common(assets, files, "path").orderBy("path").collect()] == ["sources/assets/x.png", "sources/assets/y"]
