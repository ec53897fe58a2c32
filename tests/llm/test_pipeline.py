"""The pipeline's stages take effect, one after another."""

from __future__ import annotations

import os
import random
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
from quernstone.llm import bpe, minhash, pii
from quernstone.llm.queries import vocabulary
from quernstone.session import lean


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "er", "th", "or", "lo", "mi", "ta", "es"]) for _ in range(rng.randint(1, 5)))
    text = lambda n: [word() for _ in range(n)]
    item = text(30)
    docs = {i: text(60) for i in range(100)}
    toxic = set(range(100, 140))
    docs |= {i: text(40) + ["stupid"] + text(5) for i in toxic}
    docs[200] = [*docs[5], "end"]
    docs[201] = text(20) + item + text(20)
    docs[202] = text(20) + ["mail", "a.b@example.com"]
    docs[203] = []
    rows = [(i, " ".join(w) if w else None, "en", "s", 7) for i, w in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item).upper())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in docs if i < 140], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, gone = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        rows = now.collect()
        gone[name] = before.keys() - {r.doc_id for r in rows}
        now = spark.createDataFrame(rows, now.schema)
    assert gone == {"toxicity": toxic, "near_duplicates": {200}, "decontamination": {201}, "pii": set()}
    kept = {r.doc_id: r for r in now.collect()}
    assert kept[202].text.endswith("mail [EMAIL]") and kept[202].n_chars == len(kept[202].text) and kept[203].text is None
    model = bpe.load(vocabulary())
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert last.keys() == kept.keys()
    assert all(r.n_tokens == len(r.ids) == len(model.encode(kept[i].text)) // 4 for i, r in last.items())


def test_rows_with_null_or_equal_ids(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    item, copied, other, *clean = (text() for _ in range(9))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, clean[0]), (4, f"so {item}"), (4, clean[1]), (5, clean[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    rows = [(None, copied), (None, f"{copied} end"), (9, copied), (7, copied), (7, copied), (7, clean[3]), (None, other), (None, other), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([(7, copied), (7, clean[3]), (None, other), (8, None), (8, None)], key=str)


def test_defaults():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    assert minhash.near_duplicates.__defaults__[:2] == (5, 80) and pii.KINDS == ("email", "ip", "card", "phone")


def test_tasks_leave_no_tables_in_workers(spark):
    def held(batches):
        from quernstone.llm import minhash

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(minhash._WORDS)] * batch.num_rows, pa.int64())], ["n"])

    rows = spark.createDataFrame([(i, f"w{i} x{i} y{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    assert len(minhash.signatures(rows, 2).collect()) == 400
    assert {r.n for r in rows.mapInArrow(held, "n long").collect()} == {0}


def test_freed_memory_goes_back():
    def run(batches):
        for batch in batches:
            held = [np.ones(8000) for _ in range(4000)]  # 256 MB in parts that the C library keeps
            last = np.ones(8000)
            del held
            yield last

    def mb():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    before = mb()
    kept = list(lean(run)(iter([None])))
    assert len(kept) == 1 and mb() - before < 100
