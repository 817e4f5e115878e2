"""What a task of the decontamination holds at once doesn't grow with the documents it reads."""

import random
import tracemalloc

import pyarrow as pa

from panelspan.llm import decontaminate


def test_a_task_holds_few_words_at_once(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(500)]
    items = spark.createDataFrame([(k, " ".join(rng.choices(words, k=100))) for k in range(20)], "item_id long, text string")
    item = items.first().text
    # Every word is one of the vocabulary's, so all of them are indexed.
    texts = [f"{' '.join(rng.choices(words, k=4000))} {item} {' '.join(rng.choices(words, k=4000))}" for _ in range(200)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    runs, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema, *a, **b: runs.append(run) or spark.createDataFrame([], schema))
    decontaminate.scan(docs, items, cut=True)
    rows = pa.RecordBatch.from_pydict({"row": pa.array([{"doc_id": k} for k in range(len(texts))]), "text": pa.array(texts)})
    tracemalloc.start()
    found = [x for out in runs[0](iter([rows])) for x in out["n_hit"].to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and min(found) >= 100
    assert peak < 120e6, f"{peak / 1e6:.0f} MB"
