"""Steps whose Python is bounded by bytes of text, not by rows of a batch, and postings without a shuffle."""

from __future__ import annotations

import pyarrow as pa

from quernstone import session
from quernstone.functions import analyzer
from quernstone.operators import search
from quernstone.sources import transcripts


def test_parts_of_a_batch():
    texts = pa.array(["é" * session.PART, None, "a", "", "b" * (session.PART - 1), "c", "d"])
    assert [len(x) for x in session.parts(texts, texts)] == [1, 4, 2]
    assert [len(x) for x in session.parts(texts[:0], texts[:0])] == [0]


def test_counted_terms_in_parts(monkeypatch):
    monkeypatch.setattr(session, "PART", 100)
    texts = ["Running runs, the Éclair the", None, "", "x " * 90, *["one two one"] * 40]
    made = list(analyzer._counted(iter([pa.array(texts)])))
    assert len(made) > 4 and max(map(len, made)) <= 100 // len("one two one") + 2
    one = {"term": "on", "tf": 2, "positions": [0, 2]}
    first = [{"term": "eclair", "tf": 1, "positions": [3]}, {"term": "run", "tf": 2, "positions": [0, 1]}, {"term": "the", "tf": 2, "positions": [2, 4]}]
    found = [x for a in made for x in a.to_pylist()]
    assert found[:3] == [first, [], []] and found[3][0]["tf"] == 90
    assert found[4:] == [[one, {"term": "two", "tf": 1, "positions": [1]}]] * 40
    assert [x for a in analyzer._analyzed(iter([pa.array(texts)])) for x in a.to_pylist()] == [analyzer.analyze(t) for t in texts]


def test_exports_in_parts(monkeypatch):
    monkeypatch.setattr(session, "PART", 100)
    text = "# Session: a\n## User\nx\n## Assistant\ny"
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(30)], "text": [text] * 29 + [None]})
    made = list(transcripts._reader(transcripts.export_rows, transcripts.EXPORT)(iter([batch])))
    assert len(made) > 9 and max(x.num_rows for x in made) <= 9
    rows = [tuple(r.values()) for x in made for r in x.to_pylist()]
    assert rows == [r for i in range(30) for r in transcripts.export_rows(f"f{i}", text if i < 29 else "")]
    none = list(transcripts._reader(transcripts.web_exchanges, transcripts.EXCHANGES)(iter([batch])))
    assert sum(x.num_rows for x in none) == 0


def test_postings_without_shuffle(spark):
    items = lambda rows: spark.createDataFrame(rows, "item_id long, title string, body string")
    rows = [(1, "B a b", "x"), (2, None, None), (3, "", "z y z z")]
    found = search.postings(items(rows))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    once = [("a", 1, "title", 1), ("b", 1, "title", 2), ("x", 1, "body", 1), ("y", 3, "body", 1), ("z", 3, "body", 3)]
    assert sorted(map(tuple, found.collect())) == once
    again = search.postings(items([*rows, (1, "b", "c"), (None, "n", ""), (None, "n", "")]))
    assert sorted(map(tuple, again.collect()), key=str) == sorted([once[0], ("b", 1, "title", 3), ("c", 1, "body", 1), *once[2:], ("n", None, "title", 2)], key=str)
