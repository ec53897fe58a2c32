"""Index, ranking against SQLite's full-text search, bundles and budgets."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quernstone.functions.markdown import HARD, chunks, sections, tokens
from quernstone.functions.snippets import MAX_BYTES, MAX_TOKENS, snippet
from quernstone.operators import search
from quernstone.operators.projection import invariant_violations, item_id, project, project_documents, rejections
from quernstone.plans import query
from quernstone.plans.index import Index, IndexFault, build, pointer, publish
from quernstone.plans.retrieval import Retrieval, RetrievalError

NOTE = """root text

# Alpha
first body about running engines

### Deep
deep text

```
# no heading
```

## Beta
beta runs

# Alpha
second alpha
"""


def test_sections():
    out = [(s.heading_path, s.occurrence, s.first) for s in sections(NOTE)]
    assert out == [((), 1, 1), (("Alpha",), 1, 4), (("Alpha", "Deep"), 1, 7), (("Alpha", "Beta"), 1, 14), (("Alpha",), 2, 17)]


@pytest.mark.parametrize("text", ["```\nnever closed\n" + "x = 1\n" * 2000, "`" * 3 + "\n" + "y" * 1900 + "\n```", "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 900, "- item of a list\n" * 900, "> quoted words here\n" * 900, "A sentence of words. " * 900, "無" * 5000, "w" * 9000, ""])
def test_chunks_stay_under_the_limit(text):
    out = chunks(text)
    assert all(tokens(c) <= HARD for c in out)
    letters = lambda s: [c for c in s if c.isalnum()]
    if not text.startswith(("```", "|")):
        assert letters("".join(out)) == letters(text)


def test_queries():
    q = query.compiled("C++ naïve 漢字7.1")
    assert [(c.kind, c.value) for c in q.clauses] == [("prefix", "c"), ("prefix", "naïve"), ("phrase", "漢字"), ("prefix", "7"), ("prefix", "1")]
    assert query.dedupe_key(" A  b ") == "a b" and query.compiled("std::vector").clauses[1].value == "vector"
    for bad in ("", "a:b", 'x"y', "\x00", "a‮b", "x" * 257, "one two three four five six seven", "and", "!!", 5):
        with pytest.raises(query.QueryError):
            query.compiled(bad)
    for args in ((["a", "A"],), ([],), (["a"] * 7,), (["a"], ["note", "note"]), (["a"], ["web"]), (["a"], ["note"], True), (["a"], ["note"], 21)):
        with pytest.raises(query.QueryError):
            query.request(*args)


CONVERSATION = """## Exchange 1
- **Turn**: 3
- **User locator**: `raw/a.jsonl#Session:s/Turn:3/User@L4-L6`
- **Assistant locator**: `raw/a.jsonl#Session:s/Turn:3/AssistantFinal@L9-L9`

### Human user
how do quokkas sleep?

### Assistant final
Quokkas sleep by day.
"""


def test_conversations(spark, tmp_path):
    meta = {"provider": "codex", "created": "unknown", "provider_session_id": "s", "exchange_count": "1"}
    bad = CONVERSATION.replace("### Assistant final", "### Nobody")
    rows = [("c/1.md", "codex-s", None, "conversation", meta, CONVERSATION + "more words of quokkas. " * 300, 9), ("c/2.md", "x", None, "conversation", meta, bad, 9), ("c/3.md", "y", None, "conversation", {}, CONVERSATION, 9)]
    sources = spark.createDataFrame(rows, "source_path string, source_id string, source_title string, scope string, metadata map<string,string>, body string, first_line int")
    items = project(sources)
    found = {(r.role, r.part): r for r in items.collect()}
    human = found["human", 1]
    assert human.locator == "raw/a.jsonl#Session:s/Turn:3/User/part:1" and human.locator_with_lines == "raw/a.jsonl#Session:s/Turn:3/User/part:1@L4-L6"
    assert (human.evidence_role, human.turn_index, human.source_title) == ("user_statement", 3, "Codex 会话 · 日期未知")
    assert human.relations.counterpart_item_ids == [found["assistant", p].item_id for p in range(1, len(found))]
    assert {r.source_path: r.reason for r in rejections(sources).collect()} == {"c/2.md": "roles", "c/3.md": "provider and created"}
    root = str(tmp_path)
    index_id = build(items, root)
    out = Retrieval(Index.open(spark, root, index_id)).read_bundle(found["assistant", 2].item_id, index_id)
    assert out["bundle_status"] == "complete" and [x["metadata"]["role"] for x in out["items"]] == ["human"] + ["assistant"] * (len(found) - 1)


def test_section_items(spark):
    out = {r.locator: r for r in project_documents(sources(spark, [("n.md", "N", "note", NOTE)])).collect()}
    assert out.keys() == {"note:n.md/" + x + "/part:1" for x in ("root", "heading:alpha", "heading:alpha/deep", "heading:alpha/beta", "heading:alpha:occurrence:2")}
    assert out["note:n.md/heading:alpha/part:1"].body.startswith("# Alpha\nfirst") and out["note:n.md/heading:alpha/part:1"].locator_with_lines.endswith("@L3-L4")


def test_item_ids_are_stable():
    assert item_id("sources/notes/a.md", "note:a/root", "root", 1) == "itm_odp6ldsmbddcjesvd2phvrn2j3tlj6up"
    assert item_id("a/b.md", "section:root#1", "section", 1) == item_id("a/b.md", "section:root#1", "section", 1) != item_id("a/b.md", "section:root#1", "section", 2)
    assert len(item_id("", "", "", 1)) == 36


def test_snippets():
    body = "Nothing here.\n\n" + "Long filler sentence number one. " * 40 + "The needle and the thread. " + "More filler follows here. " * 40
    text, before, after = snippet(body, ("needle", "thread"))
    assert "needle and the thread" in text and before and after and tokens(text) <= MAX_TOKENS and len(text.encode()) <= MAX_BYTES
    assert snippet("short text", ("absent",)) == ("short text", False, False)


def sources(spark, rows):
    return spark.createDataFrame(rows, "source_path string, source_title string, scope string, body string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["run", "running", "runner", "alpha", "beta", "gamma", "engine", "ünder", "x1"]
    return [(f"notes/{i}.md", rng.choice(["Run title", "Beta", "Other"]), rng.choice(["note", "article"]), " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))) for i in range(80)]


@pytest.fixture(scope="module")
def retrieval(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    items = project_documents(sources(spark, [*rows, ("notes/long.md", "Long", "note", "# Head\n\n" + "zebra words in a long section. " * 400), ("notes/cjk.md", "CJK", "note", "前漢字後 and 漢 字")]))
    assert invariant_violations(items).count() == 0
    first = build(items, root)
    assert publish(spark, root, first) and not publish(spark, root, first)
    assert build(items, root) == first
    second = build(items.where("source_path <> 'notes/0.md'"), root)
    assert publish(spark, root, second) and pointer(spark, root, "previous") == first
    with pytest.raises(IndexFault):
        build(items.withColumn("body", F.lit("changed")), root)
    with pytest.raises(IndexFault):
        Index.open(spark, root, "idx_none")
    return Retrieval(Index.open(spark, root, first))


def test_bm25_equals_sqlite(retrieval):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, body, id UNINDEXED, tokenize='porter unicode61 remove_diacritics 2')")
    for r in retrieval.index.table("items").collect():
        text = "".join(f" {c} " if query.is_cjk(c) else c for c in r.body)
        db.execute("INSERT INTO t VALUES (?, ?, ?)", (r.source_title, text, r.item_id))
    for words in (["run"], ["alpha", "engine"], ["runn", "beta", "under"], ["x1"]):
        expected = {i: s for i, s in db.execute("SELECT id, bm25(t, 4.0, 1.0) FROM t WHERE t MATCH ?", (" AND ".join(f"{w}*" for w in words),))}
        got = {r.item_id: r.score for r in retrieval.scored([query.compiled(" ".join(words))]).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[i] - s) < 1e-9 for i, s in expected.items())


def test_phrases_and_scopes(retrieval):
    assert [r["metadata"]["source_path"] for r in retrieval.search(["漢字"])["results"]] == ["notes/cjk.md"]
    out = retrieval.search(["alpha", "engine beta"], ["note"], 5)
    assert 0 < len(out["results"]) <= 5 and {r["metadata"]["scope"] for r in out["results"]} == {"note"}
    assert [r["rank"] for r in out["results"]] == list(range(1, len(out["results"]) + 1))
    assert out["usage"]["estimated_evidence_tokens"] <= 8000
    small = retrieval.search(["alpha"], limit=20, max_tokens=600)
    assert small["is_truncated"] and small["usage"]["estimated_evidence_tokens"] <= 600
    assert retrieval.search(["absentword"])["results"] == []


def test_fusion_is_exact(spark):
    rows = [(q, f"i{k}", r) for q in range(6) for r, k in enumerate(random.Random(q).sample(range(25), 20), 1)]
    from fractions import Fraction

    out = search.fuse(spark.createDataFrame(rows, "query_ix int, item_id string, rank int"), 20).collect()
    score = {}
    for _, i, r in rows:
        score[i] = score.get(i, 0) + Fraction(1, 60 + r)
    first = {i: r for q, i, r in rows if q == 0}
    best = {}
    for _, i, r in rows:
        best[i] = min(best.get(i, 99), r)
    expected = sorted(score, key=lambda i: (-score[i], first.get(i, 21), best[i], i))[:20]
    assert [r.item_id for r in sorted(out, key=lambda r: r.final_rank)] == expected


def test_bundles(retrieval):
    parts = retrieval.index.table("items").where("source_path = 'notes/long.md'").orderBy("part").collect()
    assert len(parts) > 4
    seed = parts[2].item_id
    whole = retrieval.read_bundle(seed, retrieval.index.index_id)
    assert whole["bundle_status"] == "complete" and len(whole["items"]) == len(parts)
    some = retrieval.read_bundle(seed, retrieval.index.index_id, 2500)
    assert some["bundle_status"] == "partial_budget" and seed in {x["metadata"]["item_id"] for x in some["items"]}
    assert retrieval.read_item(seed, retrieval.index.index_id, 50)["is_truncated"]
    for args in ((seed, "idx_other"), ("itm_none", retrieval.index.index_id), (seed, retrieval.index.index_id, 10)):
        with pytest.raises(RetrievalError):
            retrieval.read_bundle(*args)
    assert retrieval.status()["items"] == retrieval.index.table("items").count()
